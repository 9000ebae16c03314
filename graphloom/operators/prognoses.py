"""Prognoses: what findings and measures mean for a code base, in four lenses, with a level from 1 to 3."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import band, plural, rel_of
from graphloom.operators import smells
from graphloom.sources.binding import Graph

# Thresholds of the prognoses.
REACH_CALLERS, DOMINANT_SHARE, DOMINANT_LINES, CLUSTER, WIDE_SHARE, WIDE_MIN, RELATED = 50, 50, 1000, 3, 60, 8, 8
HOT = (smells.COMPLEX_FUNC[0] + smells.COMPLEX_FUNC[1]) // 2
UNTESTED_LINES = 200
COLUMNS = ("key", "lens", "level", "target", "name", "file", "line", "title", "summary")
LEVEL_WORD = {3: "fix first", 2: "fix soon", 1: "when convenient"}


def _values(*values: Column | str | int) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = {"level": "bigint", "line": "bigint"}
    return [lit(v).cast(kinds.get(n, "string")).alias(n) for n, v in zip(COLUMNS, values, strict=True)]


def _row(df: DataFrame, *values: Column | str | int) -> DataFrame:
    return df.select(*_values(*values))


def hot_churn(g: Graph) -> DataFrame:
    """hot: the churn that makes a file busy, the nearest rank at three quarters of those that changed, 2 at least."""
    f = g.files.where("not test and churn > 0")
    # one row per file of a snapshot is ranked by counts of equal churn, so no task holds all files
    per = f.groupBy("churn").agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("churn").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("upto", F.sum("n").over(up)).withColumn("of", F.sum("n").over(Window.partitionBy()))
    at = ranked.where(F.col("upto") > F.floor(F.col("of") * 3 / 4)).agg(F.min("churn").alias("c"))
    return at.select(F.greatest(F.coalesce("c", F.lit(2)), F.lit(2)).cast("bigint").alias("hot"))


def callers(g: Graph) -> DataFrame:
    """id of a called declaration, and how many production and test declarations call it."""
    c = g.edges.where("kind = 'caller'").select("src", F.col("dst").alias("id")).join(g.decls.select(F.col("id").alias("src"), "test"), "src")
    return c.groupBy("id").agg(F.count_if("test").alias("tests"), F.count_if(~F.col("test")).alias("prod"))


def measured(g: Graph) -> DataFrame:
    """Declarations outside tests with their file's churn, callers and whether the file is busy."""
    d = g.decls.where("not test").join(g.files.select("pkg", "path", "churn"), ["pkg", "path"]).join(callers(g), "id", "left").na.fill(0, ["tests", "prod"])
    return d.crossJoin(F.broadcast(hot_churn(g))).withColumn("busy", F.col("churn") >= F.col("hot"))  # one row


def _of_decl(kind: str, lens: str, level: Column | int, title: str, summary: Column) -> Column:
    return F.struct(*_values(F.concat(F.lit(f"{kind}:"), "id"), lens, level, F.col("id"), F.col("name"), F.col("path"), F.col("start_line"), title, summary))


def complex_kinds(g: Graph, kinds: Sequence[str]) -> DataFrame:
    """Prognoses of declarations with many paths, which are read once: hotspot, complex and untested."""
    cx = F.col("complexity")
    keeps = F.concat(F.format_string("%s has %d paths through it and its file changed in ", "name", cx), plural(F.col("churn"), "commit"), F.lit(" lately."))
    made = {
        "hotspot": (F.col("busy"), _of_decl("hotspot", "health", 1 + (cx > HOT).cast("int") + (cx > smells.COMPLEX_FUNC[1]).cast("int"), "Hard to follow, and it keeps changing", keeps)),
        "complex": (~F.col("busy"), _of_decl("complex", "health", 1, "Hard to follow", F.format_string(f"%s has %d paths through it, past the limit of {smells.COMPLEX_FUNC[0]}.", "name", cx))),
        "untested": (F.col("tests") == 0, _of_decl("untested", "tests", 1 + (F.col("busy") & (cx > HOT)).cast("int"), "Complex, and no test calls it", F.format_string("%s has %d paths and no test calls it directly.", "name", cx))),
    }
    found = F.array_compact(F.array(*(F.when(made[k][0], made[k][1]) for k in kinds)))
    return measured(g).where(cx > smells.COMPLEX_FUNC[0]).select(F.explode(found).alias("p")).select("p.*")


def hotspot(g: Graph) -> DataFrame:
    return complex_kinds(g, ["hotspot"])


def complex_(g: Graph) -> DataFrame:
    return complex_kinds(g, ["complex"])


def untested(g: Graph) -> DataFrame:
    return complex_kinds(g, ["untested"])


def calling_packages(g: Graph) -> DataFrame:
    """id, package and number of production callers in it."""
    c = g.edges.where("kind = 'caller'").join(g.decls.where("not test").select(F.col("id").alias("src"), F.col("pkg").alias("from")), "src")
    return c.groupBy(F.col("dst").alias("id"), "from").agg(F.count(F.lit(1)).alias("n"))


def reach(g: Graph, least: int = REACH_CALLERS) -> DataFrame:
    c = calling_packages(g).groupBy("id").agg(F.sum("n").alias("callers"), F.count(F.lit(1)).alias("pkgs")).where(F.col("callers") >= least)
    d = g.decls.where("not test").join(c, "id")
    text = F.concat(F.col("name"), F.lit(" is used by "), plural(F.col("callers"), "declaration"), F.lit(" in "), plural(F.col("pkgs"), "package"), F.lit("."))
    return _row(d, F.concat(F.lit("reach:"), "id"), "reach", 1, F.col("id"), F.col("name"), F.col("path"), F.col("start_line"), "Many places depend on this", text)


def reach_related(g: Graph, least: int = REACH_CALLERS) -> DataFrame:
    """The first eight packages that call a declaration of wide reach, most callers first."""
    per = calling_packages(g)
    wide = per.groupBy("id").agg(F.sum("n").alias("callers")).where(F.col("callers") >= least).join(g.decls.where("not test").select("id"), "id", "left_semi").select("id")
    pos = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "from"))
    return per.join(wide, "id").withColumn("pos", pos.cast("bigint")).where(F.col("pos") <= RELATED).select("id", "pos", F.col("from").alias("package"), "n")


def package_lines(g: Graph) -> DataFrame:
    return g.files.groupBy("pkg").agg(F.sum(F.when(~F.col("test"), F.col("lines")).otherwise(0)).alias("lines"), F.count_if(~F.col("test")).alias("n_files"))


def dominating(packages: DataFrame, share: int = DOMINANT_SHARE, least: int = DOMINANT_LINES) -> DataFrame:
    """Packages that hold so much of the module's lines (`all`)."""
    of_all = packages.crossJoin(F.broadcast(packages.agg(F.sum("lines").alias("all"))))  # one row
    return of_all.where((F.col("all") >= least) & (F.col("lines") * 100 >= F.col("all") * share))


def dominant(g: Graph, share: int = DOMINANT_SHARE, least: int = DOMINANT_LINES) -> DataFrame:
    p = dominating(package_lines(g), share, least)
    text = F.concat(F.format_string("%s holds %d%% of the module's code, in ", rel_of(F.col("pkg"), g.module), F.floor(F.col("lines") * 100 / F.col("all"))), plural(F.col("n_files"), "file"), F.lit("."))
    return _row(p, F.concat(F.lit("dominant:"), "pkg"), "structure", 2, F.col("pkg"), rel_of(F.col("pkg"), g.module), "", 0, "One package holds most of the code", text)


def surface(g: Graph) -> DataFrame:
    """Declarations of files that aren't tests, by the file and not the declaration."""
    return g.decls.join(g.files.where("not test").select("pkg", "path"), ["pkg", "path"], "left_semi")


def surfaces(g: Graph) -> DataFrame:
    """Imported packages that export most of what they hold: pkg, n declarations and exp of them exported."""
    s = surface(g).groupBy("pkg").agg(F.count(F.lit(1)).alias("n"), F.count_if("exported").alias("exp"))
    return s.join(g.imports.select(F.col("dst").alias("pkg")), "pkg", "left_semi").where((F.col("n") >= WIDE_MIN) & (F.col("exp") * 100 > F.col("n") * WIDE_SHARE))


def wide(g: Graph) -> DataFrame:
    s = surfaces(g)
    text = F.format_string("%s exports %d of its %d declarations.", rel_of(F.col("pkg"), g.module), "exp", "n")
    return _row(s, F.concat(F.lit("wide:"), "pkg"), "structure", 1, F.col("pkg"), rel_of(F.col("pkg"), g.module), "", 0, "Exports most of what it holds", text)


def outside_calls(g: Graph) -> DataFrame:
    """id and production callers in other packages."""
    ends = g.decls.select(F.col("id").alias("dst"), F.col("pkg").alias("home"))
    return calling_packages(g).join(ends, F.col("id") == F.col("dst")).where(F.col("from") != F.col("home")).groupBy("id").agg(F.sum("n").alias("n"))


def unstable(g: Graph) -> DataFrame:
    f = smells.unstable_dep(g)
    text = F.format_string("%s imports %s, which is less stable.", rel_of(F.col("package"), g.module), rel_of(F.col("target"), g.module))
    return _row(f, F.concat(F.lit("unstable:"), "package", F.lit(">"), "target"), "structure", 2, F.col("package"), rel_of(F.col("package"), g.module), "", 0, "Depends on something that changes more than it does", text)


def crowded(g: Graph) -> DataFrame:
    """Functions with many parameters, numbered (`pos`) in their package, which has `n` of them."""
    d = smells.funcs(g).where(F.col("params") > smells.MANY_PARAMS)
    in_pkg = Window.partitionBy("pkg")
    return d.withColumn("n", F.count(F.lit(1)).over(in_pkg)).withColumn("pos", F.row_number().over(in_pkg.orderBy(F.desc("params"), "id")))


def params(g: Graph) -> DataFrame:
    """One prognosis for three or more functions of a package with many parameters, else one for each."""
    d = crowded(g).where((F.col("n") < CLUSTER) | (F.col("pos") == 1))
    many = F.col("n") >= CLUSTER
    text = F.when(many, F.format_string(f"%d functions in %s take more than {smells.MANY_PARAMS} parameters, up to %d in %s.", "n", rel_of(F.col("pkg"), g.module), "params", "name")).otherwise(F.format_string("%s takes %d parameters.", "name", "params"))
    out = _row(d, F.concat(F.lit("params:"), F.when(many, F.col("pkg")).otherwise(F.col("id"))), "tests", F.when(many, 2).otherwise(1), F.col("id"), F.col("name"), F.col("path"), F.col("start_line"), "", text)
    return out.withColumn("title", F.when(F.col("level") == 2, "The same data passed around by hand").otherwise("Too many parameters"))


def large_file(g: Graph) -> DataFrame:
    f = smells.large_file(g).join(g.files.select(F.col("pkg").alias("package"), F.col("path").alias("file"), "churn"), ["package", "file"]).crossJoin(F.broadcast(hot_churn(g)))
    base = F.element_at(F.split("file", "/"), -1)
    level = 1 + ((F.col("severity") == smells.HIGH) | (F.col("churn") >= F.col("hot"))).cast("int")
    return _row(f, F.concat(F.lit("large-file:"), "file"), "tests", level, F.col("file"), base, F.col("file"), 0, "A file doing too many things", F.format_string("%s has %d lines of code, past %d.", base, "measure", "limit_value"))


def untested_package(g: Graph) -> DataFrame:
    f = smells.untested_package(g).withColumnRenamed("package", "pkg").join(package_lines(g), "pkg")
    return _row(f, F.concat(F.lit("untested-pkg:"), "pkg"), "tests", 1 + (F.col("lines") >= UNTESTED_LINES).cast("int"), F.col("pkg"), rel_of(F.col("pkg"), g.module), "", 0, "No tests at all", F.format_string("Nothing tests %s (%d lines).", rel_of(F.col("pkg"), g.module), "lines"))


KINDS = (hotspot, complex_, untested, reach, dominant, wide, unstable, params, large_file, untested_package)


def union(g: Graph) -> DataFrame:
    return reduce(DataFrame.unionByName, (k(g) for k in KINDS if k not in (hotspot, complex_, untested)), complex_kinds(g, ["hotspot", "complex", "untested"]))


def find(g: Graph) -> DataFrame:
    """All prognoses, the highest level first, then by lens and key."""
    return union(g).orderBy(F.desc("level"), "lens", "key")


def lines(p: DataFrame) -> DataFrame:
    """What a command line shows of each: key, level, title and place, by tabs."""
    where = F.when((F.col("file") == "") | (F.col("file") == F.col("name")), F.col("name")).when(F.col("line") == 0, F.format_string("%s (%s)", "name", "file")).otherwise(F.format_string("%s (%s:%d)", "name", "file", "line"))
    word = F.when(F.col("level") == 3, LEVEL_WORD[3]).when(F.col("level") == 2, LEVEL_WORD[2]).otherwise(LEVEL_WORD[1])
    return p.select("key", F.concat_ws("\t", "key", word, "title", where).alias("text"))


def heats(g: Graph) -> DataFrame:
    """0 to 5 for each declaration in the lenses health, reach, structure and tests."""
    d = g.decls.join(g.files.select("pkg", "path", "churn"), ["pkg", "path"]).join(callers(g), "id", "left").na.fill(0, ["tests", "prod"])
    d = d.join(smells.instability(g).select("pkg", "i"), "pkg").crossJoin(F.broadcast(hot_churn(g)))  # one row
    cx = F.when(F.col("kind").isin("func", "method"), band(F.col("complexity"), 3, 6, 10, 20)).otherwise(F.lit(0))
    health = F.when((cx > 0) & (F.col("churn") >= F.col("hot")), F.least(cx + 1, F.lit(5))).otherwise(cx)
    untested = F.when((cx > 0) & (F.col("tests") == 0), cx).otherwise(F.lit(0))
    tests = F.when(F.col("params") > smells.MANY_PARAMS, F.greatest(untested, F.lit(3))).otherwise(untested)
    made = (("health", health), ("reach", band(F.col("prod"), 1, 3, 10, 30, 100)), ("structure", 1 + F.round(F.col("i") * 4)), ("tests", tests))
    return d.select("id", *(c.cast("bigint").alias(n) for n, c in made))


def listed(df: DataFrame, key: Column, *facts: tuple[str, Column, Column | int]) -> DataFrame:
    """key, pos, label, value and limit_value of measures that stand in columns."""
    limit_of = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint").alias("limit_value")
    each = F.array(*(F.struct(F.lit(label).alias("label"), value.cast("bigint").alias("value"), limit_of(limit)) for label, value, limit in facts))
    return df.select(key.alias("key"), F.posexplode(each).alias("pos", "f")).select("key", F.col("pos").cast("bigint").alias("pos"), "f.*")


def facts(g: Graph, least: int = REACH_CALLERS) -> DataFrame:
    """key, pos, label, value and limit_value (0 where there is none): the measures behind prognoses of hard, widely used and unstable code; `evidence.facts` has all."""
    m = measured(g).where(F.col("complexity") > smells.COMPLEX_FUNC[0])
    keys = F.array_compact(F.array(F.concat(F.when(F.col("busy"), "hotspot:").otherwise("complex:"), F.col("id")), F.when(F.col("tests") == 0, F.concat(F.lit("untested:"), "id"))))
    hard = listed(m.withColumn("key", F.explode(keys)), F.col("key"), ("paths through it (complexity)", F.col("complexity"), smells.COMPLEX_FUNC[0]), ("commits to its file lately", F.col("churn"), 0), ("lines", F.col("lines"), smells.LONG_FUNC[0]), ("tests that call it", F.col("tests"), 0))
    c = calling_packages(g).groupBy("id").agg(F.sum("n").alias("users"), F.count(F.lit(1)).alias("pkgs")).where(F.col("users") >= least)
    c = c.join(g.decls.where("not test").select("id"), "id", "left_semi").join(callers(g).select("id", "tests"), "id", "left").na.fill(0, ["tests"])
    wide_ = listed(c, F.concat(F.lit("reach:"), "id"), ("declarations that use it", F.col("users"), REACH_CALLERS), ("packages that use it", F.col("pkgs"), 0), ("tests that call it", F.col("tests"), 0))
    u = smells.unstable_dep(g)
    less = listed(u, F.concat(F.lit("unstable:"), "package", F.lit(">"), "target"), ("instability of the imported package, %", F.col("measure"), 0), ("instability of this package, %", F.col("limit_value"), 0))
    return hard.unionByName(wide_).unionByName(less)
