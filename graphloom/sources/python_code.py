"""A frontend for Python sources: the standard `ast` module in Arrow batches, linked by joins.

`extract` turns rows (path, text) into declarations and raw references; `link` resolves references by
short name among declarations that they can see. A file that doesn't parse gives nothing but an error row.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import linking

BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match)
NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match)
DECLS = (
    "path string, pkg string, name string, short string, kind string, test boolean, exported boolean, start_line bigint, end_line bigint, lines bigint, complexity bigint, nesting bigint, "
    "params bigint, signature string, shape string, deprecated boolean, ord bigint, refs array<struct<name:string,kind:string>>, imports array<string>, mods array<string>, error string"
)

NAMES = [x.split(" ")[0] for x in re.split(r", (?=\w+ (?:string|boolean|bigint|array))", DECLS)]


def is_test(path: str) -> bool:
    *dirs, base = path.split("/")
    return base.startswith("test_") or base.endswith("_test.py") or base == "conftest.py" or any(d in ("tests", "test") for d in dirs)


def dotted(path: str) -> str:
    parts = path.split("/")[:-1]
    if parts[:1] == ["src"]:
        parts = parts[1:]
    return ".".join(parts)


def package(path: str, module: str) -> str:
    return dotted(path) or module


def complexity(fn: ast.AST) -> int:
    n = 1
    for x in ast.walk(fn):
        n += isinstance(x, BRANCH)
        if isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        if isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
    return n


def nesting(node: ast.AST, depth: int = 0) -> int:
    deepest = depth
    for name, value in ast.iter_fields(node):
        for c in value if isinstance(value, list) else [value]:
            if isinstance(c, ast.AST):
                chained = name == "orelse" and isinstance(node, ast.If) and isinstance(c, ast.If) and len(node.orelse) == 1
                deepest = max(deepest, nesting(c, depth + (isinstance(c, NEST) and not chained)))
    return deepest


def code_lines(lines: list[str], start: int, end: int) -> int:
    return sum(1 for t in lines[start - 1 : end] if t.strip() and not t.strip().startswith("#"))


def references(node: ast.AST, own: str) -> list[tuple[str, str]]:
    """Names that a declaration uses: users are those of annotations, callers all others."""
    typed: set[int] = set()
    for x in ast.walk(node):
        for a in (getattr(x, "annotation", None), getattr(x, "returns", None)):
            if a is not None:
                typed.update(id(y) for y in ast.walk(a))
    found: dict[tuple[str, str], None] = {}
    for x in ast.walk(node):
        name = x.id if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) else x.attr if isinstance(x, ast.Attribute) else None
        if name and name != own:
            found[name, "user" if id(x) in typed else "caller"] = None
    return list(found)


def imports_of(tree: ast.Module, path: str) -> list[str]:
    out = []
    for x in tree.body:
        if isinstance(x, ast.Import):
            out += [a.name for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            mod = x.module or ""
            if x.level:
                base = [p for p in dotted(path).split(".") if p]
                base = base[: len(base) - (x.level - 1)] if x.level > 1 else base
                mod = ".".join([*base, *([mod] if mod else [])])
            out += [mod, *(f"{mod}.{a.name}" if mod else a.name for a in x.names)]
    return out


@dataclass
class _Found:
    name: str
    kind: str
    exported: bool
    node: ast.AST


def declarations(tree: ast.Module) -> Iterator[_Found]:
    for x in tree.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield _Found(x.name, "func", not x.name.startswith("_"), x)
        elif isinstance(x, ast.ClassDef):
            open_ = not x.name.startswith("_")
            yield _Found(x.name, "type", open_, x)
            for m in x.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield _Found(f"{x.name}.{m.name}", "method", open_ and not m.name.startswith("_"), m)
        elif isinstance(x, (ast.Assign, ast.AnnAssign)):
            target = x.targets[0] if isinstance(x, ast.Assign) else x.target
            if isinstance(target, ast.Name) and re.search("[A-Z]", target.id) and target.id == target.id.upper():
                yield _Found(target.id, "const", not target.id.startswith("_"), x)


def _rows(path: str, text: str, module: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield path, package(path, module), "", "", "", is_test(path), False, 0, 0, 0, 0, 0, 0, "", "", False, 0, [], [], [], str(e)
        return
    lines, imports = text.splitlines(), imports_of(tree, path)
    mods = [package(path, module), re.sub(r"(^src/|\.py$)", "", path).replace("/", ".")]
    for k, d in enumerate(declarations(tree)):
        node, decorators = d.node, getattr(d.node, "decorator_list", [])
        start = min([node.lineno, *(x.lineno for x in decorators)])
        short = d.name.rpartition(".")[2]
        fn = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(a for a in (node.args.vararg, node.args.kwarg) if a)] if fn else []
        n = len(args) - bool(d.kind == "method" and args and args[0].arg in ("self", "cls"))
        signature = ast.unparse(node.args) + (f" -> {ast.unparse(node.returns)}" if node.returns else "") if fn else ""
        plain = [x for x in node.body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))] if isinstance(node, ast.ClassDef) else [node]
        refs = list(dict.fromkeys(r for x in plain for r in references(x, short)))
        shape = hashlib.sha256(ast.dump(node).encode()).hexdigest()[:16]
        old = any("deprecated" in ast.unparse(x).lower() for x in decorators)
        yield (
            path, package(path, module), d.name, short, d.kind, is_test(path), d.exported, start, node.end_lineno, code_lines(lines, start, node.end_lineno), complexity(node) if fn else 0, nesting(node) if fn else 0,
            n, signature, shape, old, k, [{"name": a, "kind": b} for a, b in refs], imports, mods, "",
        )


def extract(files: DataFrame, module: str) -> DataFrame:
    """Declarations with raw references of rows (path, text)."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in data:
            yield pd.DataFrame([r for p, x in zip(t["path"], t["text"], strict=True) for r in _rows(p, x or "", module)], columns=NAMES)

    return files.select("path", "text").mapInPandas(run, DECLS)


def identified(decls: DataFrame) -> DataFrame:
    """Declarations with ids: package and name, and a number where several have both."""
    d = decls.withColumn("n", F.row_number().over(Window.partitionBy("pkg", "name").orderBy("path", "ord")))
    return d.withColumn("id", F.concat("pkg", F.lit("."), "name", F.when(F.col("n") > 1, F.concat(F.lit("#"), "n")).otherwise("")))


def link(found: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decls, edges and imports: references meet declarations of their short name in the same or an imported package.

    `seen` (path, pkg, to, test) tells which packages files import, where that isn't by the modules that rows name.
    """
    d = identified(found.where("error = ''"))
    if seen is None:
        modules = d.select("pkg", F.explode("mods").alias("mod")).distinct()
        seen = d.select("path", "pkg", F.explode("imports").alias("mod")).distinct().join(modules.withColumnRenamed("pkg", "to"), "mod").select("path", "pkg", "to").distinct()
        seen = seen.join(d.groupBy("path").agg(F.bool_and("test").alias("test")), "path")
    refs = d.select(F.col("id").alias("src"), F.col("short").alias("own"), (F.col("kind") == "method").alias("own_member"), "path", "pkg", F.explode("refs").alias("r")).select("src", "own", "own_member", "path", "pkg", F.col("r.name").alias("short"), F.col("r.kind").alias("kind"))
    target = d.select("short", F.col("id").alias("dst"), F.col("pkg").alias("to"), F.col("path").alias("at"), "exported", (F.col("kind") == "method").alias("member"))
    edges = linking.named(refs, target, seen.select("path", "to")).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    imports = seen.where(~F.col("test") & (F.col("pkg") != F.col("to"))).select(F.col("pkg").alias("src"), F.col("to").alias("dst")).distinct()
    return d, edges, imports


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """path (below the root) and text of every file of a pattern under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    at = F.instr("path", root.rstrip("/") + "/") + len(root.rstrip("/")) + 1
    return files.select(F.substr("path", at).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
