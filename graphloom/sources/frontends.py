"""Projects of a folder: which frontend reads which root, and snapshots made of their sources.

A root is a folder with a project file; the first frontend in FRONTENDS whose file is there reads it. Julia's
snapshots come in as JSON (`store.snapshot_json`), as only Julia itself reads Julia.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.checkpoints import stored
from graphloom.sources import golang, lexical, modules, python_code
from graphloom.sources.binding import Graph


class NoProject(ValueError):
    """No frontend finds a project in a folder."""


@dataclass(frozen=True)
class Frontend:
    lang: str
    projects: tuple[str, ...]
    unless: tuple[str, ...]
    extensions: tuple[str, ...]


# Frontends in the order that they are asked, their project files and sources.
FRONTENDS = (
    Frontend("go", ("go.mod",), (), (".go",)),
    Frontend("julia", ("Project.toml",), ("go.mod",), (".jl",)),
    Frontend("typescript", ("package.json", "tsconfig.json"), (), (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")),
    Frontend("python", ("pyproject.toml", "setup.py"), (), (".py",)),
    Frontend("rust", ("Cargo.toml",), (), (".rs",)),
)
SKIPPED = ("testdata", "vendor", "node_modules")
#: Generated sources say so in the first five of their first 512 bytes.
GENERATED = "(?i)@generated|code generated|do not edit|auto-?generated"


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """The folder of a path; "." for files at the top."""
    cut = F.length(path) - F.length(base(path)) - F.lit(1)
    return F.when(cut > 0, F.substr(path, F.lit(1), cut)).otherwise(F.lit("."))


def open_path(path: Column) -> Column:
    """Whether no folder of a path is hidden, begins with an underscore, or is one of SKIPPED."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - F.lit(1))
    return ~F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | F.startswith(d, F.lit("_")) | d.isin(*SKIPPED))


# Files that name dependencies, and folders whose files aren't watched besides hidden ones.
PROJECT_FILES = ("go.mod", "go.sum", "Project.toml", "Manifest.toml", "package.json", "tsconfig.json", "pyproject.toml", "setup.py", "Cargo.toml", "Cargo.lock")


def watched(path: Column) -> Column:
    """Whether an edit of a file changes the analysis: a source or a file that names dependencies, in no folder that is hidden or one of SKIPPED."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - F.lit(1))
    known = base(path).isin(*PROJECT_FILES)
    for f in FRONTENDS:
        for e in f.extensions:
            known = known | F.endswith(path, F.lit(e))
    return known & ~F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(*SKIPPED))


def roots(files: DataFrame) -> DataFrame:
    """dir and lang of every project among the paths of a tree, by dir and the order of frontends."""
    names = sorted({p for f in FRONTENDS for p in f.projects})
    known = files.where(base(F.col("path")).isin(*names) & open_path(F.col("path"))).groupBy(folder(F.col("path")).alias("dir")).agg(F.collect_set(base(F.col("path"))).alias("names"))
    has = lambda options: F.arrays_overlap("names", F.array(*map(F.lit, options))) if options else F.lit(False)
    found = F.array_compact(F.array(*(F.when(has(f.projects) & ~has(f.unless), F.struct(F.lit(i).alias("rank"), F.lit(f.lang).alias("lang"))) for i, f in enumerate(FRONTENDS))))
    return known.select("dir", F.explode(found).alias("x")).select("dir", "x.rank", "x.lang").orderBy("dir", "rank").select("dir", "lang")


def detect(names: set[str]) -> str:
    """The language of a folder with files of these names; "" where none is a project file."""
    return next((f.lang for f in FRONTENDS if names & set(f.projects) and not names & set(f.unless)), "")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and text of every file that can be read as a source or a project file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = F.instr("path", root.rstrip("/") + "/") + len(root.rstrip("/")) + 1
    return files.select(F.substr("path", start).alias("path"), F.col("content"))


def below(files: DataFrame, dir: str) -> DataFrame:
    """Files of a root, with paths below it; those of roots within it are left out by their own project files."""
    if dir in ("", "."):
        return files
    return files.where(F.startswith("path", F.lit(dir + "/"))).withColumn("path", F.substr("path", F.lit(len(dir) + 2)))


def module_of(lang: str, project: str, name: str) -> str:
    """The module's name by its project file; `name` where that doesn't say."""
    if lang == "go":
        found = re.search(r"^module\s+\"?([^\s\"]+)", project, re.M)
        return found.group(1) if found else name
    if lang == "typescript":
        try:
            return json.loads(project).get("name") or name
        except (ValueError, AttributeError):
            return name
    found = re.search(r"^name\s*=\s*[\"']([^\"']+)", project, re.M)
    return found.group(1) if found else name


def load(files: DataFrame, name: str = "module", lang: str = "", churn: DataFrame | None = None) -> Graph:
    """The snapshot of a root: files are (path, content) below it; churn is (path, churn). NoProject if no frontend reads it."""
    spark = files.sparkSession
    names = {p for f in FRONTENDS for p in f.projects}
    top = {r.path: bytes(r.content).decode(errors="replace") for r in files.where(F.col("path").isin(*names)).collect()}  # a few small files
    lang = lang or detect(set(top))
    front = next((f for f in FRONTENDS if f.lang == lang), None)
    if not front or lang == "julia":
        raise NoProject(f"no project that can be read in {name}")
    module = module_of(lang, next((top[p] for p in front.projects if p in top), ""), name)
    sources = files.where(F.array_contains(F.array(*map(F.lit, front.extensions)), F.regexp_extract(base(F.col("path")), r"\.[^.]+$", 0)) & open_path(F.col("path")) & ~F.col("path").rlike(r"\.d\.[cm]?ts$"))
    if lang == "go":  # folders with a go.mod of their own are other modules
        others = files.where((base(F.col("path")) == "go.mod") & (F.col("path") != "go.mod")).select(F.concat(folder(F.col("path")), F.lit("/")).alias("other"))
        ahead = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - F.lit(1)), lambda d, i: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i + 1), "/"), F.lit("/")))
        inner = sources.select("path", F.explode(ahead).alias("other")).join(others, "other", "left_semi").select("path").distinct()
        sources = sources.join(inner, "path", "left_anti")
    texts = stored(sources.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    if lang == "go":
        found = stored(golang.extract(texts, module))
        decls, edges, imports = golang.link(found)
    else:
        found = stored(python_code.extract(texts, module) if lang == "python" else lexical.extract(texts, module, lang))
        decls, edges, imports = python_code.link(found, _typescript_seen(files, texts, module) if lang == "typescript" else None)
        decls = completed(decls.join(texts.select("path", generated(F.col("text")).alias("generated")), "path"))
    return snapshot(spark, module, lang, texts, decls, edges, imports, churn)


def generated(text: Column) -> Column:
    """Whether the head of a source says that it is generated."""
    return F.substring_index(F.substring(text.cast("binary"), 1, 512).cast("string"), "\n", 5).rlike(GENERATED)


def full_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("bigint")


def completed(decls: DataFrame) -> DataFrame:
    """Declarations with the columns that only typed frontends tell, and their package's name."""
    return decls.withColumns({"pkg_name": F.regexp_extract("pkg", r"[^./:]+$", 0), "data": F.lit(False), "forwards": F.lit(""), "delegates": F.lit(""), "calls": F.lit(0), "escapes": F.lit(True), "fixed_param": F.lit(""), "fixed_value": F.lit("")})


def relative(pkg: Column, module: str) -> Column:
    """A package's path below the module's."""
    return F.when(F.startswith(pkg, F.lit(module + "/")), F.substr(pkg, F.lit(len(module) + 2))).otherwise(pkg)


def _typescript_seen(files: DataFrame, texts: DataFrame, module: str) -> DataFrame:
    """path, pkg, test, and each package that a source imports, itself or through what it imports."""
    project = files.where(base(F.col("path")).isin("package.json", "tsconfig.json") & open_path(F.col("path"))).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    pkg = lambda path: F.when(folder(path) == ".", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), folder(path)))
    return stored(modules.resolve(project, texts).select("path", pkg(F.col("path")).alias("pkg"), pkg(F.col("file")).alias("to"), F.col("path").rlike(lexical.TESTS).alias("test")).distinct())


COLUMNS = "k, b, id, name, kind, pkg, pkg_name, path, test, generated, exported, data, start_line, end_line, lines, complexity, nesting, params, signature, shape, forwards, delegates, deprecated, calls, escapes, fixed_param, fixed_value, ord"


def snapshot(spark: SparkSession, module: str, lang: str, texts: DataFrame, decls: DataFrame, edges: DataFrame, imports: DataFrame, churn: DataFrame | None = None) -> Graph:
    """A graph of linked declarations, stored; files without a declaration are files still."""
    kinds = {"calls": "bigint", "params": "bigint"}
    d = decls.withColumns({"k": F.col("ord"), "b": F.lit(0)})
    g = Graph(spark, None, module=module, lang=lang)
    g.given["decls"] = stored(d.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in COLUMNS.split(", "))))
    g.given["edges"] = stored(edges.select("src", "dst", "kind", "n"))
    g.given["imports"] = stored(imports.select("src", "dst").distinct())
    lines = texts.select("path", full_lines(F.col("text")).alias("whole"))
    per = g.decls.groupBy("path").agg(F.min("pkg").alias("pkg"), F.bool_and("test").alias("test"), F.bool_or("generated").alias("generated"))
    if lang == "go":
        per = per.join(decls.groupBy("path").agg(F.max("file_lines").alias("code")), "path", "left")
    else:
        per = per.withColumn("code", F.lit(None).cast("bigint"))
    files = lines.join(per, "path")
    files = files.join(churn, "path", "left") if churn is not None else files.withColumn("churn", F.lit(0))
    g.given["files"] = stored(files.select("pkg", "path", "test", "generated", F.coalesce("code", "whole").alias("lines"), F.coalesce("churn", F.lit(0)).cast("bigint").alias("churn")))
    g.given["packages"] = stored(g.decls.groupBy("pkg").agg(F.max("pkg_name").alias("name")).select("pkg", "name", relative(F.col("pkg"), module).alias("rel")))
    return g


#: Columns of tables that may have no rows in a project.
SCHEMAS = {"edges": "src string, dst string, kind string, n bigint", "imports": "src string, dst string", "files": "pkg string, path string, test boolean, generated boolean, lines bigint, churn bigint", "packages": "pkg string, name string, rel string"}


def empty(other: Graph) -> Graph:
    """A snapshot without declarations: how a side of a comparison reads that lacks a root."""
    g = Graph(other.spark, None, module=other.module, lang=other.lang)
    for n in ("decls", "edges", "files", "packages", "imports", "refs"):
        g.given[n] = getattr(other, n).limit(0)
    return g
