"""What stands behind each prognosis: its measures with their limits, and the places that it speaks of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import plural, rel_of
from graphloom.operators import prognoses as p
from graphloom.operators import smells
from graphloom.sources.binding import Graph

# Why a place is shown beside a prognosis.
REACHED = "calls it, so a change in behaviour reaches it"
INDIRECT = "calls it; its own tests may reach it indirectly"
RESIGNED = "calls it, and would change with its parameters"
LESS_STABLE = "the less stable package it imports"
UNCALLED = "no caller in other packages of the module"


def label(id: Column, pkg: Column, name: Column) -> Column:
    """A declaration's name in a list, with the argument types that an id ends in."""
    rest = F.substr(id, F.length(pkg) + F.length(name) + 2)
    typed = F.startswith(id, F.concat(pkg, F.lit("."), name, F.lit("(")))
    return F.when(typed, F.concat(name, rest)).otherwise(name)


def _share(part: str, of: str) -> Column:
    return F.floor(F.col(part) * 100 / F.col(of))


def facts(g: Graph, least: int = p.REACH_CALLERS, share: int = p.DOMINANT_SHARE) -> DataFrame:
    """key, pos, label, value and limit_value (0 where there is none) of the measures behind every prognosis."""
    packages, names = p.package_lines(g), F.col("pkg")
    most = p.dominating(packages, share)
    wide = p.surfaces(g)
    crowd = p.crowded(g).where("pos = 1 or n < %d" % p.CLUSTER)
    many = F.col("n") >= p.CLUSTER
    large = smells.large_file(g).join(g.files.select(F.col("pkg").alias("package"), F.col("path").alias("file"), "churn"), ["package", "file"])
    bare = smells.untested_package(g).select(F.col("package").alias("pkg")).join(packages, "pkg")
    parts = [
        p.facts(g, least),
        p.listed(most, F.concat(F.lit("dominant:"), names), ("share of the module's lines, %", _share("lines", "all"), p.DOMINANT_SHARE), ("lines", F.col("lines"), 0), ("files", F.col("n_files"), 0)),
        p.listed(wide, F.concat(F.lit("wide:"), names), ("declarations exported, %", _share("exp", "n"), p.WIDE_SHARE), ("exported", F.col("exp"), 0), ("declarations", F.col("n"), 0)),
        p.listed(crowd.where(many), F.concat(F.lit("params:"), names), ("functions with too many parameters", F.col("n"), p.CLUSTER), ("most parameters in one", F.col("params"), smells.MANY_PARAMS)),
        p.listed(crowd.where(~many), F.concat(F.lit("params:"), "id"), ("parameters", F.col("params"), smells.MANY_PARAMS)),
        p.listed(large, F.concat(F.lit("large-file:"), "file"), ("lines of code", F.col("measure"), F.col("limit_value")), ("commits lately", F.col("churn"), 0)),
        p.listed(bare, F.concat(F.lit("untested-pkg:"), names), ("lines", F.col("lines"), 0), ("test files", F.lit(0), 0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _places(df: DataFrame, key: Column, by: Column, then: Column, at: Column, id: Column, name: Column, why: Column) -> DataFrame:
    return df.select(key.alias("key"), by.cast("bigint").alias("by"), then.alias("then"), at.cast("bigint").alias("at"), id.alias("id"), name.alias("name"), why.alias("why"))


def related(g: Graph, least: int = p.REACH_CALLERS, share: int = p.DOMINANT_SHARE) -> DataFrame:
    """key, pos (from 1), id, name and why of the first eight places of each prognosis.

    Callers go by id, packages that call by how many of theirs do, files and declarations by their lines, exports by their
    calls from outside, the fewest first. All kinds are ranked together, and no task holds more than the first of a key.
    """
    none, empty = F.lit(0), F.lit("")
    named = label(F.col("id"), F.col("pkg"), F.col("name"))
    hard = p.measured(g).where(F.col("complexity") > smells.COMPLEX_FUNC[0])
    crowd = p.crowded(g)
    why = lambda kind, text: F.struct(F.concat(F.lit(kind), "id").alias("key"), F.lit(text).alias("why"))
    asks = F.array_compact(F.array(F.when(F.col("busy"), why("hotspot:", REACHED)).otherwise(why("complex:", REACHED)), F.when(F.col("tests") == 0, why("untested:", INDIRECT))))
    called = hard.select("id", F.explode(asks).alias("a")).unionByName(crowd.where(F.col("n") < p.CLUSTER).select("id", why("params:", RESIGNED).alias("a")))
    callers = g.edges.where("kind = 'caller'").select("src", F.col("dst").alias("id")).join(called, "id").select("a.*", F.col("src").alias("id")).join(g.decls.where("not test"), "id")

    per = p.calling_packages(g)
    reached = per.groupBy("id").agg(F.sum("n").alias("callers")).where(F.col("callers") >= least).join(g.decls.where("not test").select("id"), "id", "left_semi").select("id")
    calling = per.join(reached, "id")
    holding = p.dominating(p.package_lines(g), share).select("pkg").join(g.files.where("not test"), "pkg")
    exports = p.surface(g).where("exported").join(p.surfaces(g).select("pkg"), "pkg").join(p.outside_calls(g).withColumnRenamed("n", "outside"), "id", "left").na.fill(0, ["outside"])
    less = smells.unstable_dep(g)
    large = smells.large_file(g).select(F.col("package").alias("pkg"), F.col("file").alias("path")).join(g.decls, ["pkg", "path"])
    n, lines, pkg = F.col("n"), F.col("lines"), F.col("pkg")
    parts = [
        _places(callers, F.col("key"), none, F.col("id"), none, F.col("id"), named, F.col("why")),
        _places(calling, F.concat(F.lit("reach:"), "id"), -n, F.col("from"), none, F.col("from"), rel_of(F.col("from"), g.module), F.concat(plural(n, "declaration"), F.lit(" here call it"))),
        _places(holding, F.concat(F.lit("dominant:"), "pkg"), -lines, F.col("path"), none, F.col("path"), F.element_at(F.split("path", "/"), -1), F.concat(lines.cast("string"), F.lit(" lines, "), plural(F.col("churn"), "commit"), F.lit(" lately"))),
        _places(exports, F.concat(F.lit("wide:"), "pkg"), F.col("outside"), F.col("path"), F.col("start_line"), F.col("id"), named, F.when(F.col("outside") > 0, F.concat(F.lit("used "), plural(F.col("outside"), "time"), F.lit(" from other packages"))).otherwise(UNCALLED)),
        _places(less, F.concat(F.lit("unstable:"), "package", F.lit(">"), "target"), none, empty, none, F.col("target"), rel_of(F.col("target"), g.module), F.lit(LESS_STABLE)),
        _places(crowd.where((n >= p.CLUSTER) & (F.col("pos") > 1)), F.concat(F.lit("params:"), pkg), -F.col("params"), F.col("id"), none, F.col("id"), named, F.format_string("takes %d parameters", "params")),
        _places(large, F.concat(F.lit("large-file:"), "path"), -lines, empty, F.col("start_line"), F.col("id"), named, F.concat(lines.cast("string"), F.lit(" lines"))),
    ]
    pos = F.row_number().over(Window.partitionBy("key").orderBy("by", "then", "at", "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("pos", pos.cast("bigint")).where(F.col("pos") <= p.RELATED).select("key", "pos", "id", "name", "why")
