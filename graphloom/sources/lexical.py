"""Lexical frontends for TypeScript and Rust: items are found by their first words and by matching brackets.

What is read is text whose comments and strings are blanked, so positions stay. Precision is that of
names: references are words, linked by `python_code.link` to what a file can see. Declarations and edges
have the columns of the Python frontend's.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.sources.python_code import DECLS, NAMES

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_TS_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
# Words that aren't references.
KEYWORDS = set(
    "as async await break case catch class const continue crate default delete do dyn else enum export extends extern false finally fn for from function if impl import in instanceof interface let loop match mod move mut new null of private protected public pub readonly ref return self Self static struct super switch this throw trait true try type typeof undefined unsafe use var void where while yield number string boolean any unknown never".split()
)


def blank(text: str, single: bool = False) -> str:
    """Comments and strings as spaces; newlines stay."""
    gap = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = _BLANK.sub(gap, text)
    return _TS_STRING.sub(gap, text) if single else text


def close(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(text)):
        depth += text[i] in "([{"
        depth -= text[i] in ")]}"
        if depth == 0:
            return i + 1
    return len(text)


@dataclass
class Item:
    name: str
    kind: str
    exported: bool
    start: int
    end: int
    params: str = ""
    result: str = ""
    test: bool = False
    fn: bool = False
    drop_self: bool = False


def _statement_end(t: str, at: int) -> int:
    """The end of what starts at `at`: a closed block, or a semicolon or line outside of brackets."""
    i = at
    while i < len(t):
        if t[i] in "([{":
            block = t[i] == "{"
            i = close(t, i)
            if block:
                return i + (t[i : i + 1] == ";")
        elif t[i] == ";":
            return i + 1
        elif t[i] == "\n" and not re.match(r"\s*[.?:=|&]", t[i:]):
            return i
        else:
            i += 1
    return i


_TS = re.compile(r"^(export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:async\s+)?(function)\*?\s+(\w+)|(?:abstract\s+)?(class)\s+(\w+)|(interface|enum|type)\s+(\w+)|(const|let|var)\s+(\w+))", re.M)
_TS_MEMBER = re.compile(r"^[ \t]+((?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*)(#?\w+)\s*(?:<[^>\n]*>)?\(", re.M)


def typescript(raw: str, t: str) -> Iterator[Item]:
    named = set(re.findall(r"\w+", " ".join(re.findall(r"^export\s*\{([^}]*)\}", t, re.M))))
    for m in _TS.finditer(t):
        name = m[3] or m[5] or m[7] or m[9]
        exported = bool(m[1]) or name in named
        body = t.find("{", m.end())
        if m[2]:
            at = t.find("(", m.end())
            stop = close(t, at)
            brace = t.find("{", stop)
            yield Item(name, "func", exported, m.start(), close(t, brace), raw[at:stop], raw[stop:brace].strip(), fn=True)
        elif m[4]:
            end = close(t, body)
            yield Item(name, "type", exported, m.start(), end)
            inner, depth, at = t[body + 1 : end - 1], 0, 0
            for x in _TS_MEMBER.finditer(inner):
                depth += sum((c == "{") - (c == "}") for c in inner[at : x.start()])
                at = x.start()
                par = body + 1 + x.end() - 1
                stop = close(t, par)
                brace = re.compile(r"[^;{}\n]*\{").match(t, stop)
                if depth == 0 and brace and x[2] not in KEYWORDS:
                    first = body + 1 + x.start()
                    yield Item(f"{name}.{x[2]}", "method", exported and not re.search("private|protected", x[1]) and x[2][0] != "#", first + len(x.group()) - len(x.group().lstrip()), close(t, brace.end() - 1), raw[par:stop], raw[stop : brace.end() - 1].strip(), fn=True)
        elif m[6]:
            yield Item(name, "type", exported, m.start(), close(t, body) if m[6] != "type" and body >= 0 else _statement_end(t, m.end()))
        else:
            end = _statement_end(t, m.end())
            arrow = re.match(r"\s*(?::[^=]*)?=\s*(?:async\s*)?(\()", t[m.end() : end])
            after = close(t, m.end() + arrow.start(1)) if arrow else 0
            if arrow and re.match(r"\s*(?::[^=]*)?=>", t[after:end]):
                yield Item(name, "func", exported, m.start(), end, raw[m.end() + arrow.start(1) : after], fn=True)
            else:
                yield Item(name, "const" if m[8] == "const" else "var", exported, m.start(), end)


_RS = re.compile(r"^([ \t]*)(pub(?:\([^)]*\))?\s+)?(?:(?:unsafe|async|const|extern)\s+)*(?:(fn)\s+(\w+)|(struct|enum|trait|type|union)\s+(\w+)|(const|static)\s+(?:mut\s+)?(\w+)\s*:|(impl)\b([^{;]*)|(mod)\s+(\w+)\s*\{)", re.M)


def rust(raw: str, t: str, start: int = 0, stop: int | None = None, owner: str = "", test: bool = False, trait: bool = False) -> Iterator[Item]:
    at, stop = start, len(t) if stop is None else stop
    while m := _RS.search(t, at, stop):
        exported, first = bool(m[2]) or trait, m.start() + len(m[1])
        if m[3]:
            par = t.find("(", m.end())
            after = close(t, par)
            body = re.compile(r"[^;{]*").match(t, after).end()
            end = close(t, body) if t[body : body + 1] == "{" else body + 1
            lead = t[max(0, t.rfind("}", 0, first), t.rfind(";", 0, first)) : first]
            yield Item(f"{owner}.{m[4]}" if owner else m[4], "method" if owner else "func", exported, first, end, raw[par:after], raw[after:body].strip(), test or "#[test]" in lead, True, True)
        elif m[5]:
            end = _statement_end(t, m.end())
            yield Item(m[6], "type", exported, first, end, test=test)
        elif m[7]:
            end = t.find(";", m.end()) + 1 or len(t)
            yield Item(m[8], "const", exported, first, end, test=test)
        else:
            body = t.find("{", m.start())
            end = close(t, body)
            if m[9]:
                head = re.sub(r"<[^<>]*>", "", m[10]).split(" for ")
                names = re.findall(r"\w+", head[-1])
                yield from rust(raw, t, body + 1, end - 1, names[-1] if names else "", test, len(head) > 1)
            else:
                lead = t[max(0, t.rfind("}", 0, first), t.rfind(";", 0, first)) : first]
                yield from rust(raw, t, body + 1, end - 1, "", test or "cfg(test)" in lead)
        at = max(end, m.end())


def _params(text: str, drop_self: bool) -> int:
    parts, depth, last = [], 0, 1
    for i, c in enumerate(text):
        depth += c in "([{<"
        depth -= c in ")]}>" and text[i - 1 : i + 1] not in ("=>", "->")
        if c == "," and depth == 1 or i == len(text) - 1:
            parts.append(text[last:i].strip())
            last = i + 1
    parts = [p for p in parts if p]
    return len(parts) - bool(drop_self and parts and re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self(?:\s*:.*)?", parts[0]))


def _nesting(t: str, words: re.Pattern[str]) -> int:
    """The deepest chain of branching blocks; an else continues its if."""
    stack, deepest, head = [], 0, 0
    for i, c in enumerate(t):
        if c == "{":
            stack.append(bool(words.search(t[head:i])))
            deepest = max(deepest, sum(stack))
        elif c == "}" and stack:
            stack.pop()
        if c in "{};":
            head = i + 1
    return deepest


_TS_BRANCH = re.compile(r"\b(?:if|for|while|switch|catch)\b|&&|\|\||\?\?|(?<![?.])\?(?![?.:])")
_RS_BRANCH = re.compile(r"\b(?:if|for|while|loop|match)\b|&&|\|\||\?(?=[;.)\s])")
_TS_NEST = re.compile(r"\b(?:if|else|for|while|switch|try)\b")
_RS_NEST = re.compile(r"\b(?:if|else|for|while|loop|match)\b")


def _lead(lines: list[str], first: int) -> int:
    """The line where the comments and attributes right above line `first` (from 0) start."""
    while first and (re.match(r"\s*(?://|/\*|\*|#\[|@\w)", lines[first - 1])):
        first -= 1
    return first


def _typescript_imports(raw: str, path: str) -> list[str]:
    found = re.findall(r"^\s*(?:import|export)\b[^;\n]*?[\"']([^\"']+)[\"']", raw, re.M)
    return [posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.[jt]sx?$", "", x))) if x.startswith(".") else x for x in found]


def _rust_imports(raw: str, own: str) -> list[str]:
    out = []
    for x in re.findall(r"^\s*(?:pub\s+)?use\s+([^;]+);", raw, re.M):
        head = re.split(r"[{*\s]", x)[0].rstrip(":")
        parts = head.split("::")
        if parts[0] == "super":
            parts = [*own.split("::")[:-1], *parts[1:]]
        elif parts[0] == "self":
            parts = [*own.split("::"), *parts[1:]]
        out += ["::".join(parts[:k]) for k in range(2, len(parts) + 1)]
    return out + [f"{own}::{x}" for x in re.findall(r"^\s*(?:pub\s+)?mod\s+(\w+);", raw, re.M)]


@dataclass(frozen=True)
class Language:
    items: Callable[[str, str], Iterator[Item]]
    branch: re.Pattern[str]
    nest: re.Pattern[str]
    single: bool
    package: Callable[[str, str], str]
    test: Callable[[str], bool]
    imports: Callable[[str, str, str], list[str]]
    mods: Callable[[str, str], list[str]]


def _rust_package(path: str, module: str) -> str:
    parts = [p for p in re.sub(r"\.rs$", "", path).split("/") if p]
    parts = parts[1:] if parts[:1] == ["src"] else parts
    parts = parts[:-1] if parts[-1:] in (["lib"], ["main"], ["mod"]) else parts
    return "::".join(["crate", *parts])


def _typescript_package(path: str, module: str) -> str:
    folder = posixpath.dirname(path)
    return f"{module}/{folder}" if folder else module


#: Paths of TypeScript's tests.
TESTS = r"\.(?:test|spec)\.[cm]?[jt]sx?$|(?:^|/)__tests__(?:/|$)"
LANGUAGES = {
    "typescript": Language(typescript, _TS_BRANCH, _TS_NEST, True, _typescript_package, lambda p: bool(re.search(TESTS, p)), lambda raw, path, own: _typescript_imports(raw, path), lambda path, own: [re.sub(r"(?:/index)?\.[jt]sx?$", "", path)]),
    "rust": Language(rust, _RS_BRANCH, _RS_NEST, False, _rust_package, lambda p: p.startswith("tests/"), lambda raw, path, own: _rust_imports(raw, own), lambda path, own: [own]),
}


def rows(path: str, raw: str, module: str, lang: Language) -> Iterator[tuple]:
    t = blank(raw, lang.single)
    own, lines, plain = lang.package(path, module), raw.split("\n"), t.split("\n")
    imports, mods = lang.imports(raw, path, own), lang.mods(path, own)
    found = list(lang.items(raw, t))
    for k, i in enumerate(found):
        first, last = t.count("\n", 0, i.start), t.count("\n", 0, max(i.start, i.end - 1))
        start = _lead(lines, first)
        body = t[i.start : i.end]
        inner = body if i.fn or i.kind != "type" else re.sub(r"\{.*\}", "", body, flags=re.S) if any(x.kind == "method" and x.start >= i.start and x.end <= i.end for x in found) else body
        short = i.name.rpartition(".")[2]
        after_colon = {m.group(1) for m in re.finditer(r"(?::|->|extends|implements)\s*&?(?:mut\s+)?([A-Za-z_]\w*)", inner)}
        words = dict.fromkeys(w for w in _WORD.findall(inner) if w not in KEYWORDS and w != short)
        refs = [{"name": w, "kind": "user" if w in after_colon and not re.search(rf"\b{re.escape(w)}\s*\(", inner) else "caller"} for w in words]
        note = "\n".join(lines[start:first + 1])
        yield (
            path, own, i.name, short, i.kind, i.test or lang.test(path), i.exported, start + 1, last + 1, sum(bool(x.strip()) for x in plain[first : last + 1]), 1 + len(lang.branch.findall(body)) if i.fn else 0,
            _nesting(body, lang.nest) if i.fn else 0, _params(i.params, i.drop_self) if i.fn else 0, re.sub(r"\s+", " ", i.params + i.result).strip(), hashlib.sha256(" ".join(_TOKEN.findall(body)).encode()).hexdigest()[:16], "deprecated" in note, k, refs, imports, mods, "",
        )


_TOKEN = re.compile(r"\w+|[^\w\s]")


def extract(files: DataFrame, module: str, language: str) -> DataFrame:
    """Declarations with raw references of rows (path, text)."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in data:
            yield pd.DataFrame([r for p, raw in zip(x["path"], x["text"], strict=True) for r in rows(p, raw or "", module, LANGUAGES[language])], columns=NAMES)

    return files.select("path", "text").mapInPandas(run, DECLS)
