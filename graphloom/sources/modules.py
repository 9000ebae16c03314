"""Which files a TypeScript import names: relative, by tsconfig's paths and baseUrl, or as a package of the project; and what barrels hand on.

All of it are equi-joins on tables of a project: files (path), imports (path, spec, handed), path patterns, packages and their
exports. A pattern with a wildcard is met on its fixed part, cut from the specifier at the lengths that patterns have; a package's
name at a specifier's slashes; a file by its path with and without extension. What a specifier may name is ranked, the first that is there counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ordered import prefixes
from graphloom.plans.checkpoints import Rounds, cut

# Extensions in the order that they are tried, folders of what is built, declarations' endings, package.json's entries.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
BUILT = ("dist", "lib", "build", "out", "esm", "cjs")
DECLARED = (".d.mts", ".d.cts", ".d.ts")
ENTRIES = ("source", "module", "main", "types")

IMPORT = r"""(?m)^[ \t]*(import|export)\b(?:[^;"'`]*?\bfrom)?\s*["'`]([^"'`\n]+)["'`]"""
_COMMENT = r"""("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"""
_TRAILING = r"""("(?:\\.|[^"\\])*")|,(?=\s*[}\]])"""


def specifiers(texts: DataFrame) -> DataFrame:
    """path, spec and handed (it is a re-export) of every import of sources (path, text)."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1)).alias("w"), F.regexp_extract_all("text", F.lit(IMPORT), F.lit(2)).alias("spec"))
    return texts.select("path", F.explode(found).alias("x")).groupBy("path", F.col("x.spec").alias("spec")).agg(F.bool_or(F.col("x.w") == "export").alias("handed"))


def clean(path: Column) -> Column:
    """A path without empty parts, `.` and the parts that `..` takes back; "." where nothing is left."""
    step = lambda done, x: (
        F.when((x == "") | (x == "."), done).when((x == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def join(a: Column, b: Column) -> Column:
    return clean(F.concat(a, F.lit("/"), b))


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def above(dir: Column) -> Column:
    """A folder and all that it lies in, "." at last."""
    own = F.concat(prefixes(F.concat(dir, F.lit("/x"))), F.array(F.lit(".")))
    return F.when(dir == ".", F.array(F.lit("."))).otherwise(own)


def _cut_star(pattern: Column) -> tuple[Column, Column, Column]:
    """What stands before a pattern's first wildcard, after it, and whether it has one."""
    at = F.instr(pattern, "*")
    return F.when(at > 0, F.substr(pattern, F.lit(1), at - 1)).otherwise(pattern), F.when(at > 0, F.substr(pattern, at + 1)).otherwise(F.lit("")), at > 0


def configs(files: DataFrame) -> DataFrame:
    """dir, base, has_base, pattern, pre, suf, wild, targets of every tsconfig.json that maps anything, of files (path, text); no pattern: one row with a null."""
    shape = "compilerOptions struct<baseUrl:string, paths:map<string,array<string>>>"
    text = F.regexp_replace(F.regexp_replace("text", _COMMENT, "$1\n"), _TRAILING, "$1")
    rows = files.where((F.col("path") == "tsconfig.json") | F.endswith("path", F.lit("/tsconfig.json"))).select(folder(F.col("path")).alias("dir"), F.from_json(text, shape)["compilerOptions"].alias("o"))
    has_base = F.coalesce(F.col("o.baseUrl"), F.lit("")) != ""
    rows = rows.where(has_base | (F.coalesce(F.size("o.paths"), F.lit(0)) > 0))
    rows = rows.select("dir", join(F.col("dir"), F.coalesce(F.col("o.baseUrl"), F.lit(""))).alias("base"), has_base.alias("has_base"), F.explode_outer("o.paths").alias("pattern", "targets"))
    pre, suf, wild = _cut_star(F.col("pattern"))
    return rows.select("dir", "base", "has_base", "pattern", pre.alias("pre"), suf.alias("suf"), wild.alias("wild"), "targets")


def _leaves(value: object) -> Iterator[str]:
    """Texts of a target, or of a tree of conditions, by the order of their names."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from _leaves(x)
    elif isinstance(value, dict):
        for _, x in sorted(value.items()):
            yield from _leaves(x)


def _package(dir: str, text: str) -> Iterator[tuple]:
    try:
        read = json.loads(text)
    except ValueError:
        return
    if not isinstance(read, dict) or not isinstance(read.get("name"), str) or not read["name"]:
        return
    exports = read.get("exports")
    keyed = isinstance(exports, dict) and any(k.startswith(".") for k in exports)
    entries = [read[e] for e in ENTRIES if isinstance(read.get(e), str) and read[e]]
    yield read["name"], dir, entries, None, []
    for key, value in (exports.items() if keyed else [(".", exports)]):
        yield read["name"], dir, entries, key, list(_leaves(value))


def packages(files: DataFrame) -> DataFrame:
    """name, dir, entries, key, pre, suf, wild, leaves of every package.json's exports, of files (path, text); each package also has a row with a null key.

    Of packages of one name, that in the first folder counts.
    """

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in data:
            yield pd.DataFrame([r for d, x in zip(t["dir"], t["text"], strict=True) for r in _package(d, x or "")], columns=["name", "dir", "entries", "key", "leaves"])

    own = files.where((F.col("path") == "package.json") | F.endswith("path", F.lit("/package.json"))).select(folder(F.col("path")).alias("dir"), "text")
    rows = own.mapInPandas(run, "name string, dir string, entries array<string>, key string, leaves array<string>")
    first = rows.groupBy("name").agg(F.min("dir").alias("dir"))
    pre, suf, wild = _cut_star(F.col("key"))
    return rows.join(first, ["name", "dir"]).select("name", "dir", "entries", "key", pre.alias("pre"), suf.alias("suf"), wild.alias("wild"), "leaves")


def _filled(text: Column, star: Column, every: bool = False) -> Column:
    """`star` in place of a target's first wildcard, or of all."""
    if every:
        return F.replace(text, F.lit("*"), star)
    at = F.instr(text, "*")
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), star, F.substr(text, at + 1))).otherwise(text)


def _matches(asked: DataFrame, patterns: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """`asked` (key, text) with the patterns that fit: equal ones, and those with a wildcard by their fixed parts. `star` is what the wildcard stands for."""
    lengths = patterns.where("wild").groupBy(key).agg(F.collect_set(F.length("pre")).alias("lengths"))  # as many as a config has lengths
    equal = asked.join(patterns.where("not wild").withColumnRenamed(name, text), [key, text]).withColumns({"star": F.lit(""), "exact": F.lit(True), name: F.col(text)})
    heads = asked.join(lengths, key).withColumn("n", F.explode("lengths")).drop("lengths").where(F.length(text) >= F.col("n")).withColumn("pre", F.substr(text, F.lit(1), F.col("n"))).drop("n")
    fits = heads.join(patterns.where("wild"), [key, "pre"]).where(F.endswith(text, F.col("suf")) & (F.length(text) >= F.length("pre") + F.length("suf")))
    star = F.substr(text, F.length("pre") + 1, F.length(text) - F.length("pre") - F.length("suf"))
    return equal.unionByName(fits.withColumns({"star": star, "exact": F.lit(False)}))


def _by_config(bare: DataFrame, config: DataFrame) -> DataFrame:
    """dir, spec and targets by the nearest config above the importer: those of the best pattern, then the path from baseUrl."""
    where = config.select(F.col("dir").alias("config"), "base", "has_base").distinct()
    nearest = bare.select("dir", F.explode(above(F.col("dir"))).alias("config")).distinct().join(where, "config")
    nearest = nearest.groupBy("dir").agg(F.max_by(F.struct("config", "base", "has_base"), F.when(F.col("config") == ".", 0).otherwise(F.length("config"))).alias("c"))
    asked = bare.join(nearest, "dir").select("dir", "spec", "c.*")
    found = _matches(asked.select("config", "spec").distinct(), config.where("pattern is not null").select(F.col("dir").alias("config"), "pattern", "pre", "suf", "wild", "targets"), "config", "pattern", "spec")
    best = found.groupBy("config", "spec").agg(F.min(F.struct(F.when(F.col("exact"), -1 - F.length("spec")).otherwise(-F.length("pre")).alias("rank"), "pattern", "star", "targets")).alias("m"))
    joined = asked.join(best, ["config", "spec"], "left")
    mapped = F.transform(F.coalesce(F.col("m.targets"), F.array().cast("array<string>")), lambda t: join(F.col("base"), _filled(t, F.col("m.star"))))
    own = F.when(F.col("has_base"), F.array(join(F.col("base"), F.col("spec")))).otherwise(F.array().cast("array<string>"))
    return joined.select("dir", "spec", F.concat(mapped, own).alias("targets"))


def _sources_of(leaf: Column, dir: Column) -> Column:
    """Where the source of an exported file may be: without its extension, and under src for what is built."""
    rest = F.regexp_replace(leaf, r"^\./", "")
    for e in DECLARED:
        rest = F.regexp_replace(rest, e.replace(".", r"\.") + "$", "")
    rest = F.regexp_replace(rest, r"\.[^./]*$", "")
    top = F.substring_index(rest, "/", 1)
    built = F.contains(rest, F.lit("/")) & top.isin(*BUILT)
    return F.when(built, F.array(join(dir, rest), join(dir, F.concat(F.lit("src/"), F.substr(rest, F.length(top) + 2))))).otherwise(F.array(join(dir, rest)))


def _by_package(bare: DataFrame, package: DataFrame) -> DataFrame:
    """dir, spec and targets in the package with the longest name that the specifier starts with."""
    names = package.select("name", F.col("dir").alias("home"), "entries").distinct()
    specs = bare.select("spec").distinct()
    heads = specs.select("spec", F.explode(F.concat(prefixes(F.col("spec")), F.array("spec"))).alias("name"))
    own = heads.join(names, "name").groupBy("spec").agg(F.max_by(F.struct("name", "home", "entries"), F.length("name")).alias("p"))
    own = own.select("spec", "p.*").withColumn("sub", F.concat(F.lit("."), F.substr("spec", F.length("name") + 1)))
    keys = package.where("key is not null").select("name", "key", "pre", "suf", "wild", "leaves")
    found = _matches(own.select("name", "sub").distinct(), keys, "name", "key", "sub")
    first = found.groupBy("name", "sub").agg(F.min(F.struct(F.when(F.col("exact"), 0).otherwise(1).alias("rank"), "key", "star", "leaves")).alias("m"))
    joined = own.join(first, ["name", "sub"], "left")
    none = F.array().cast("array<string>")
    leaves = F.transform(F.coalesce(F.col("m.leaves"), none), lambda x: _filled(x, F.col("m.star"), every=True))
    top = F.col("sub") == "."
    all_leaves = F.concat(leaves, F.when(top, F.col("entries")).otherwise(none))
    plain = F.when(top, F.array(join(F.col("home"), F.lit("src/index")), join(F.col("home"), F.lit("index")))).otherwise(F.array(join(F.col("home"), F.col("sub")), join(F.col("home"), F.concat(F.lit("src/"), F.col("sub")))))
    targets = joined.select("spec", F.concat(F.flatten(F.transform(all_leaves, lambda x: _sources_of(x, F.col("home")))), plain).alias("targets"))
    return bare.join(targets, "spec").select("dir", "spec", "targets")


def resolved(files: DataFrame, imports: DataFrame, config: DataFrame, package: DataFrame) -> DataFrame:
    """path, spec, handed and file: what each import names, where that is a file of the project."""
    asked = imports.select(folder(F.col("path")).alias("dir"), "spec").distinct()
    near = asked.where(F.startswith("spec", F.lit("."))).select("dir", "spec", F.array(join(F.col("dir"), F.col("spec"))).alias("targets"))
    bare = asked.where(~F.startswith("spec", F.lit(".")))
    ranked = near.withColumn("way", F.lit(0)).unionByName(_by_config(bare, config).withColumn("way", F.lit(1))).unionByName(_by_package(bare, package).withColumn("way", F.lit(2)))
    each = ranked.select("dir", "spec", "way", F.posexplode("targets").alias("rank", "target"))
    stem = F.regexp_replace("target", r"\.[^./]*$", "")
    each = each.select("dir", "spec", "way", "rank", F.posexplode(F.array("target", join(F.col("target"), F.lit("index")), stem)).alias("form", "named"))
    # a file is known by its path, and by it without an extension
    end = F.regexp_extract("path", r"\.[^./]*$", 0)
    by_end = F.array_position(F.array(*map(F.lit, EXTENSIONS)), end).cast("int")
    known = files.select("path", F.explode(F.array(F.struct(F.col("path").alias("named"), F.lit(0).alias("ext")), F.struct(F.substr("path", F.lit(1), F.length("path") - F.length(end)).alias("named"), F.when(by_end > 0, by_end).alias("ext")))).alias("x"))
    known = known.select(F.col("path").alias("file"), "x.*").where("ext is not null")
    found = each.join(known, "named").groupBy("dir", "spec").agg(F.min(F.struct("way", "rank", "form", "ext", "file")).alias("best"))
    return imports.withColumn("dir", folder(F.col("path"))).join(found, ["dir", "spec"]).select("path", "spec", "handed", F.col("best.file").alias("file"))


def reached(named: DataFrame) -> DataFrame:
    """path and every file that its imports reach: those that they name, and what these hand on, through any number of barrels and around cycles.

    Only files that something imports are started from; a round follows one more re-export of what the last one found.
    """
    named = cut(named)
    hands = cut(named.where("handed").select(F.col("path").alias("file"), F.col("file").alias("next")).distinct())
    starts = named.select(F.col("file").alias("start")).distinct().withColumn("file", F.col("start"))
    seen = Rounds(starts)
    while not seen.last.isEmpty():
        further = seen.last.join(hands, "file").select("start", F.col("next").alias("file")).distinct()
        seen.add(further.join(seen.all(), ["start", "file"], "left_anti"))
    return named.select("path", F.col("file").alias("start")).distinct().join(seen.all(), "start").select("path", "file").distinct()


def resolve(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path and file of a project's imports, re-exports followed; files are (path, text) of project files, texts of sources."""
    return reached(resolved(texts.select("path"), specifiers(texts), cut(configs(files)), cut(packages(files))))
