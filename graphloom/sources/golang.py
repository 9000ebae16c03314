"""A lexical frontend for Go: declarations from tokens, references linked by names and import paths.

A reference is a name of the own package, a name behind an import's (`pkg.Name`), or a member (`x.Name`),
which is linked where just one method that the file can see has that name. Types aren't checked, so what only
a type tells (which method a member is among several, whether a field decorates) stays open.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.python_code import DECLS, NAMES

SITES = "array<struct<to:string,name:string,member:boolean,call:boolean,args:array<string>>>"
MORE = f"pkg_name string, generated boolean, data boolean, forwards string, delegates string, arg_names array<string>, variadic boolean, sites {SITES}, file_lines bigint"
GO = f"{DECLS}, {MORE}"
COLUMNS = [*NAMES, "pkg_name", "generated", "data", "forwards", "delegates", "arg_names", "variadic", "sites", "file_lines"]

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|\"(?:\\.|[^\"\\\n])*\")|(?P<rune>'(?:\\.|[^'\\\n])+')|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>&&|\|\||<-|:=|\.\.\.|\+\+|--|==|!=|<=|>=|<<=?|>>=?|&\^=?|[-+*/%&|^]=|[^\s\w])|(?P<line>\n)",
    re.S,
)
# Words of the language, and names that every file has.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
UNIVERSE = frozenset("any append bool byte cap clear close comparable complex complex64 complex128 copy delete error false float32 float64 imag int int8 int16 int32 int64 iota len make max min new nil panic print println real recover rune string true uint uint8 uint16 uint32 uint64 uintptr".split())
GENERATED = re.compile(r"^// Code generated .* DO NOT EDIT\.$", re.M)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    last: int
    at: int


def tokens(text: str) -> tuple[list[Token], list[Token]]:
    """Tokens, with a semicolon where a line ends that may end a statement, and comments."""
    out: list[Token] = []
    comments: list[Token] = []
    line = 1
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        last = line + s.count("\n")
        t = Token(kind, s, line, line if kind == "line" else last, m.start())
        ends = bool(out) and out[-1].text != ";" and (out[-1].kind in ("string", "rune", "number") or out[-1].text in (")", "]", "}", "++", "--", "return", "break", "continue", "fallthrough") or (out[-1].kind == "name" and out[-1].text not in KEYWORDS))
        if kind == "comment":
            comments.append(t)
            if "\n" in s and ends:
                out.append(Token("op", ";", line, line, m.start()))
        elif kind == "line":
            if ends:
                out.append(Token("op", ";", line, line, m.start()))
        else:
            out.append(t)
        line = last
    return out, comments


def closing(ts: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == "op":
            depth += ts[j].text in _OPEN
            depth -= ts[j].text in _CLOSE
            if not depth:
                return j
    return len(ts) - 1


def parts(ts: list[Token]) -> list[list[Token]]:
    """What commas separate outside of brackets."""
    out, depth = [[]], 0
    for t in ts:
        if t.kind == "op":
            depth += t.text in _OPEN
            depth -= t.text in _CLOSE
        if t.text == "," and not depth:
            out.append([])
        elif t.text != ";" or depth:
            out[-1].append(t)
    return [p for p in out if p]


def spelled(ts: list[Token]) -> str:
    out = ""
    for a, t in enumerate(ts):
        out += (" " if a and t.kind == "name" and ts[a - 1].kind == "name" else "") + t.text
    return out


def complexity(body: list[Token]) -> int:
    """One and each if, for, && and ||; a switch or select counts once if it has a case."""
    n = 1
    for i, t in enumerate(body):
        n += t.text in ("if", "for", "&&", "||")
        if t.text in ("switch", "select"):
            brace, depth = i + 1, 0
            while brace < len(body) and (depth or body[brace].text != "{"):
                depth += body[brace].text in ("(", "[")
                depth -= body[brace].text in (")", "]")
                brace += 1
            depth = 0
            for u in body[brace : closing(body, brace) + 1] if brace < len(body) else ():
                depth += u.text == "{"
                depth -= u.text == "}"
                if u.text == "case" and depth == 1:
                    n += 1
                    break
    return n


def nesting(body: list[Token]) -> int:
    """The deepest chain of blocks of if, for, switch and select."""
    blocks: list[bool] = []
    waiting, depth, deepest = False, 0, 0
    for t in body:
        if t.text in ("if", "for", "switch", "select"):
            waiting, depth = True, 0
        elif t.text in ("(", "["):
            depth += 1
        elif t.text in (")", "]"):
            depth -= 1
        elif t.text == "{":
            blocks.append(waiting and depth == 0)
            deepest = max(deepest, sum(blocks))
            if blocks[-1]:
                waiting = False
        elif t.text == "}" and blocks:
            blocks.pop()
    return deepest


@dataclass
class Decl:
    kind: str
    name: str
    start: int
    end: int
    tokens: list[Token]
    signature: str = ""
    exported: bool = False
    params: list[list[Token]] = field(default_factory=list)
    body: list[Token] = field(default_factory=list)
    receiver: str = ""
    data: bool = False
    deprecated: bool = False


def _names(params: list[list[Token]]) -> list[str]:
    """A name for each parameter; empty ones where only types are listed."""
    named = any(len(p) > 1 and p[0].kind == "name" and p[1].text not in (".", "[") or len(p) > 1 and p[1].text == "[" and p[-1].text != "]" for p in params)
    return [p[0].text if named and p[0].kind == "name" else "" for p in params]


def _surface(ts: list[Token]) -> str:
    """A type as others see it: of a struct, the exported and embedded fields."""
    if not ts or ts[0].text != "struct":
        return spelled(ts)
    fields, one = [], []
    for t in ts[2:-1]:
        if t.text == ";" and sum((u.text in _OPEN) - (u.text in _CLOSE) for u in one) == 0:
            fields.append(one)
            one = []
        else:
            one.append(t)
    out = []
    for f in [*fields, one]:
        f = f[:-1] if len(f) > 1 and f[-1].kind == "string" else f
        if not f:
            continue
        embedded = len(f) == 1 or f[0].text == "*" or (f[1].text == "." and len(f) == 3)
        if embedded:
            out.append(spelled(f))
            continue
        names = [f[0].text]
        at = 1
        while at + 1 < len(f) and f[at].text == ",":
            names.append(f[at + 1].text)
            at += 2
        out += [f"{n} {spelled(f[at:])}" for n in names if n[0].isupper()]
    return "struct{" + "; ".join(out) + "}"


def _data(values: list[Token]) -> bool:
    """Whether a value is text over several lines: string literals, joined or converted."""
    strings = [t for t in values if t.kind == "string"]
    rest = [t.text for t in values if t.kind != "string" and t.text not in ("+", "(", ")", ".", "[", "]", "byte")]
    return bool(strings) and all(re.fullmatch(r"\w+", x) for x in rest) and len(rest) <= 2 and values[0].line < values[-1].last


def declarations(ts: list[Token], comments: list[Token]) -> Iterator[Decl]:
    ends = {c.last: c for c in comments}

    def lead(line: int) -> tuple[int, str]:
        """Where the comments right above a line start, and what they say."""
        said = ""
        while line - 1 in ends:
            said = ends[line - 1].text + "\n" + said
            line = ends[line - 1].line
        return line, said

    i = 0
    while i < len(ts):
        t = ts[i]
        if t.text == "func":
            start, doc = lead(t.line)
            j, receiver = i + 1, ""
            if ts[j].text == "(":
                stop = closing(ts, j)
                names = [u.text for u in ts[j + 1 : stop] if u.kind == "name"]
                own = ts[j + 1 : stop]
                generic = next((k for k, u in enumerate(own) if u.text == "["), len(own))
                typed = [u.text for u in own[:generic] if u.kind == "name"]
                receiver, variable = typed[-1] if typed else "", typed[0] if len(typed) > 1 else ""
                j = stop + 1
            else:
                names, variable = [], ""
            name = ts[j].text
            j += 1
            if ts[j].text == "[":
                j = closing(ts, j) + 1
            stop = closing(ts, j)
            params = parts(ts[j + 1 : stop])
            k = stop + 1
            while k < len(ts) and ts[k].text not in ("{", ";"):  # results, which may hold a struct or interface
                k = closing(ts, k) + 1 if ts[k].text in _OPEN else k + 1
                if ts[k - 1].text in ("struct", "interface") and k < len(ts) and ts[k].text == "{":
                    k = closing(ts, k) + 1
            end = closing(ts, k) if k < len(ts) and ts[k].text == "{" else max(k - 1, i)
            body = ts[k + 1 : end] if k < len(ts) and ts[k].text == "{" else []
            exported = name[:1].isupper() and (not receiver or receiver[:1].isupper())
            yield Decl("method" if receiver else "func", f"{receiver}.{name}" if receiver else name, start, ts[end].last, ts[i : end + 1], "func" + spelled(ts[j:k]), exported, params, body, variable, deprecated="Deprecated:" in doc)
            i = end + 1
        elif t.text in ("type", "const", "var"):
            grouped = ts[i + 1].text == "("
            stop = closing(ts, i + 1) if grouped else None
            j = i + 2 if grouped else i + 1
            while j < (stop if grouped else len(ts)):
                if ts[j].text == ";":
                    j += 1
                    continue
                k = j
                while k < len(ts) and ts[k].text != ";" and k != stop:
                    k = closing(ts, k) + 1 if ts[k].text in _OPEN else k + 1
                spec = ts[j:k]
                name = spec[0].text
                start, doc = lead(spec[0].line if grouped else t.line)
                if name != "_":
                    equals = next((x for x, u in enumerate(spec) if u.text == "="), len(spec))
                    if t.text == "type":
                        at = closing(spec, 1) + 1 if len(spec) > 3 and spec[1].text == "[" and spec[2].kind == "name" and spec[3].text != "]" else 1
                        signature = _surface(spec[at + (at < len(spec) and spec[at].text == "=") :])
                    else:
                        at = 1
                        while at + 1 < equals and spec[at].text == ",":
                            at += 2
                        signature = spelled(spec[at:equals]) or {"string": "untyped string", "number": "untyped number", "rune": "untyped rune"}.get(spec[equals + 1].kind if equals + 1 < len(spec) else "", "")
                    values = spec[equals + 1 :]
                    yield Decl({"type": "type", "const": "const", "var": "var"}[t.text], name, start, spec[-1].last, spec, signature, name[:1].isupper(), data=t.text != "type" and _data(values), deprecated="Deprecated:" in doc)
                j = k + 1
                if not grouped:
                    break
            i = stop + 1 if grouped else j
        else:
            i = closing(ts, i) + 1 if t.text in _OPEN else i + 1


def imports(ts: list[Token]) -> dict[str, str]:
    """Import paths by the name that the file uses."""
    out: dict[str, str] = {}
    i = 0
    while i < len(ts):
        if ts[i].text == "import":
            stop = closing(ts, i + 1) if ts[i + 1].text == "(" else next((k for k in range(i, len(ts)) if ts[k].text == ";"), len(ts))
            for k in range(i + 1, stop):
                if ts[k].kind == "string":
                    path = ts[k].text[1:-1]
                    alias = ts[k - 1].text if ts[k - 1].kind == "name" and ts[k - 1].text != "import" else ""
                    last = path.split("/")[-1]
                    out[alias or (path.split("/")[-2] if re.fullmatch(r"v\d+", last) and "/" in path else last)] = path
            i = stop
        elif ts[i].text in ("func", "type", "const", "var"):
            break
        i += 1
    return out


def _constant(arg: list[Token]) -> str:
    """The source of an argument that is a literal, nil, true or false, with a sign perhaps; empty for others."""
    rest = arg[1:] if arg and arg[0].text in ("-", "+", "!") else arg
    return spelled(arg) if len(rest) == 1 and (rest[0].kind in ("string", "rune", "number") or rest[0].text in ("nil", "true", "false")) else ""


def sites(d: Decl, own: str, known: dict[str, str]) -> list[dict]:
    """References in a declaration: to a package (its own, or one behind an import's name) or as a member."""
    ts, out = d.tokens, []
    locals_ = set(_names(d.params)) | {d.receiver}
    short = d.name.rpartition(".")[2]
    skip = {id(t) for t in [t for t in ts[:16] if t.text == short][:1]}  # the name that is declared
    for i, t in enumerate(ts):
        if t.text == ":=":
            j = i - 1
            while j >= 0 and (ts[j].kind == "name" and ts[j].text not in KEYWORDS or ts[j].text == ","):
                locals_.add(ts[j].text)
                j -= 1
    for i, t in enumerate(ts):
        if t.kind != "name" or t.text in KEYWORDS or id(t) in skip:
            continue
        before, after = ts[i - 1].text if i else "", ts[i + 1].text if i + 1 < len(ts) else ""
        if before == ".":
            owner = ts[i - 2] if i > 1 else None
            of_import = owner is not None and owner.kind == "name" and owner.text in known and owner.text not in locals_ and (i < 3 or ts[i - 3].text != ".")
            to, member = (known[owner.text], False) if of_import else ("", True)
        elif t.text in UNIVERSE or t.text in locals_ or (t.text in known and after == ".") or after == ":":
            continue
        else:
            to, member = own, False
        call = after == "("
        args = [_constant(p) for p in parts(ts[i + 2 : closing(ts, i + 1)])] if call else []
        out.append({"to": to, "name": t.text, "member": member, "call": call, "args": args})
    return out


def only_call(d: Decl) -> tuple[list[Token], bool] | None:
    """The callee of a function that does nothing but pass its parameters on, in order, and whether it returns what comes back."""
    body = [t for t in d.body if not (t.text == ";" and t is d.body[-1])]
    returned = bool(body) and body[0].text == "return"
    call = body[1:] if returned else body
    names = _names(d.params)
    if not call or call[-1].text != ")" or any(t.text == ";" for t in call) or not all(names) and names:
        return None
    at = next((i for i, t in enumerate(call) if t.text == "("), 0)
    if not at or closing(call, at) != len(call) - 1 or any(t.kind != "name" and t.text != "." for t in call[:at]):
        return None
    args = parts(call[at + 1 : -1])
    variadic = bool(d.params) and any(t.text == "..." for t in d.params[-1])
    if len(args) != len(names):
        return None
    for k, (a, n) in enumerate(zip(args, names, strict=True)):
        spread = variadic and k == len(args) - 1
        if [t.text for t in a] != ([n, "..."] if spread else [n]):
            return None
    return call[:at], returned


def rows(path: str, text: str, module: str) -> Iterator[tuple]:
    ts, comments = tokens(text)
    head = next((i for i, t in enumerate(ts) if t.text == "package"), None)
    folder = posixpath.dirname(path)
    own = f"{module}/{folder}" if folder else module
    if head is None or head + 1 >= len(ts):
        yield (path, own, "", "", "", path.endswith("_test.go"), False, 0, 0, 0, 0, 0, 0, "", "", False, 0, [], [], [], "no package clause", "", False, False, "", "", [], False, [], 0)
        return
    name, test = ts[head + 1].text, path.endswith("_test.go")
    if test and name.endswith("_test"):
        own += "_test"
    known = imports(ts)
    code = {line for t in ts if t.text != ";" or text[t.at : t.at + 1] == ";" for line in range(t.line, t.last + 1)}
    found = list(declarations(ts[head + 2 :], comments))
    for d in found:
        if d.data:  # text counts as one line of code
            code -= set(sorted(x for x in code if d.start <= x <= d.end)[1:])
    generated = bool(GENERATED.search(text[: ts[head].at]))
    for k, d in enumerate(found):
        fn = d.kind in ("func", "method")
        all_sites = sites(d, own, known)
        refs = [{"name": s["name"], "kind": "caller"} for s in all_sites]
        callee, delegates = "", ""
        if fn and not d.deprecated and (only := only_call(d)):
            spelled_callee = [t.text for t in only[0]]
            callee = "".join(spelled_callee)
            short = d.name.rpartition(".")[2]
            if d.receiver and len(spelled_callee) == 5 and spelled_callee[0] == d.receiver and spelled_callee[4] == short and only[1]:
                delegates = spelled_callee[2]
        shape = hashlib.sha256(" ".join(t.text for t in d.tokens if t.text != ";").encode()).hexdigest()[:16]
        yield (
            path, own, d.name, d.name.rpartition(".")[2], d.kind, test, d.exported, d.start, d.end, sum(d.start <= x <= d.end for x in code), complexity(d.body) if fn else 0, nesting(d.body) if fn else 0, len(d.params), d.signature, shape,
            d.deprecated, k, refs, sorted(set(known.values())), [own], "", name, generated, d.data, callee, delegates, _names(d.params), bool(d.params) and any(t.text == "..." for t in d.params[-1]), all_sites, len(code),
        )


def extract(files: DataFrame, module: str) -> DataFrame:
    """Declarations with raw references of rows (path, text)."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in data:
            yield pd.DataFrame([r for p, x in zip(t["path"], t["text"], strict=True) for r in rows(p, x or "", module)], columns=COLUMNS)

    return files.select("path", "text").mapInPandas(run, GO)


def link(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decls with calls, escapes, fixed_param and fixed_value; edges; imports."""
    same = Window.partitionBy("pkg", "name").orderBy("path", "ord")
    d = found.where("error = ''").withColumn("n", F.row_number().over(same))
    d = d.withColumn("id", F.concat("pkg", F.lit("."), "name", F.when(F.col("n") > 1, F.concat(F.lit("#"), "n")).otherwise(""))).drop("n")
    site = d.select(F.col("id").alias("src"), "pkg", "test", "imports", "start_line", F.posexplode("sites").alias("at", "s")).select("src", "pkg", "test", "imports", "start_line", "at", "s.*")
    target = d.select(F.col("id").alias("dst"), F.col("pkg").alias("to"), "short", "kind", "arg_names", "variadic")
    plain = site.where("not member").join(target.where("kind <> 'method'").withColumnRenamed("short", "name"), ["to", "name"])
    # a member is linked where one method alone that the file can see has its name
    methods = target.where("kind = 'method'").withColumnsRenamed({"short": "name", "to": "home"})
    seen = site.where("member").drop("to").join(methods, "name").where((F.col("home") == F.col("pkg")) | F.array_contains("imports", F.col("home")))
    lone = F.count(F.lit(1)).over(Window.partitionBy("src", "at"))
    member = seen.withColumn("choices", lone).where("choices = 1").withColumn("to", F.col("home"))
    columns = ["src", "dst", "pkg", "to", "kind", "test", "start_line", "at", "call", "args", "arg_names", "variadic"]
    hits = plain.select(columns).unionByName(member.select(columns)).where("src <> dst")
    edges = hits.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst", F.lit("caller").alias("kind"), "n")
    calls = hits.where("kind in ('func', 'method')")
    facts = calls.groupBy("dst").agg(F.count_if(F.col("call") & ~F.col("test")).alias("calls"), F.bool_or(~F.col("call")).alias("escapes"))
    each = calls.where("call and not test").select("dst", "src", "at", "variadic", F.posexplode("arg_names").alias("i", "param"), "args", F.size("arg_names").alias("params"))
    each = each.withColumn("value", F.coalesce(F.get("args", F.col("i")), F.lit(""))).where(~(F.col("variadic") & (F.col("i") == F.col("params") - 1)))
    fixed = each.groupBy("dst", "i", "param").agg(F.countDistinct("value").alias("kinds"), F.min(F.struct("src", "at", "value")).alias("first")).where((F.col("kinds") == 1) & (F.col("first.value") != ""))
    named = F.when(F.col("param").isin("", "_"), F.concat(F.lit("argument "), F.col("i") + 1)).otherwise(F.col("param"))
    fixed = fixed.groupBy("dst").agg(F.min(F.struct("i", named.alias("param"), F.col("first.value").alias("value"))).alias("x")).select("dst", F.col("x.param").alias("fixed_param"), F.col("x.value").alias("fixed_value"))
    d = d.join(facts.withColumnRenamed("dst", "id"), "id", "left").join(fixed.withColumnRenamed("dst", "id"), "id", "left").na.fill(0, ["calls"]).na.fill(False, ["escapes"]).na.fill("", ["fixed_param", "fixed_value"])
    packages = d.select(F.col("pkg").alias("dst")).distinct()
    imported = d.where("not test").select(F.col("pkg").alias("src"), F.explode("imports").alias("dst")).distinct().join(packages, "dst").where("src <> dst").select("src", "dst")
    return d, edges, imported
