"""Walks over the graph: who uses a declaration, paths of such steps, rings of callers, and layers of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import strong
from graphloom.plans.checkpoints import Rounds, cut
from graphloom.sources.binding import Graph


def next_steps(g: Graph, paths: DataFrame) -> DataFrame:
    """Candidates after each path (thread, ids array): users of its last declaration that aren't on it.

    A caller counts as such even where it is a user as well. Tests come last, then by their own callers.
    """
    last = paths.select("thread", "ids", F.element_at("ids", -1).alias("dst"))
    kind = F.min("kind").alias("via")  # caller before user
    found = last.join(g.edges, "dst").where(~F.array_contains("ids", F.col("src"))).groupBy("thread", "src").agg(kind)
    many = g.edges.where("kind = 'caller'").groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("callers"))
    out = found.join(g.decls.select(F.col("id").alias("src"), "test"), "src").join(many, "src", "left").na.fill(0, ["callers"])
    pos = F.row_number().over(Window.partitionBy("thread").orderBy("test", F.desc("callers"), "src"))
    return out.select("thread", pos.cast("bigint").alias("pos"), F.col("src").alias("id"), "via", "test", "callers")


def resolve(steps: DataFrame, g: Graph, moved: DataFrame) -> DataFrame:
    """Status of each step (thread, pos, id): current, moved (with its new id) or gone."""
    s = steps.join(g.decls.select("id", F.lit(True).alias("here")), "id", "left").join(moved.select(F.col("from_id").alias("id"), "to_id"), "id", "left")
    status = F.when(F.col("here"), "current").when(F.col("to_id").isNotNull(), "moved").otherwise("gone")
    return s.select("thread", "pos", "id", status.alias("status"), F.when(F.col("here"), F.col("id")).otherwise(F.coalesce("to_id", F.lit(""))).alias("now"))


def replay(steps: DataFrame, g: Graph) -> DataFrame:
    """The part of each path up to the first step that no edge to the step before allows, or that repeats one."""
    w = Window.partitionBy("thread").orderBy("pos")
    s = steps.withColumn("before", F.lag("id").over(w)).withColumn("again", F.row_number().over(Window.partitionBy("thread", "id").orderBy("pos")) > 1)
    e = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("before")).distinct().withColumn("linked", F.lit(True))
    s = s.join(e, ["id", "before"], "left").join(g.decls.select("id", F.lit(True).alias("here")), "id", "left")
    good = F.coalesce("here", F.lit(False)) & ~F.col("again") & (F.col("before").isNull() | F.coalesce("linked", F.lit(False)))
    return s.withColumn("ok", F.min(good).over(w)).where("ok").select("thread", "pos", "id")


def ring(g: Graph, starts: DataFrame, hops: int = 3) -> DataFrame:
    """start, id and the least number of caller steps to it, up to `hops`; each hop is a join and a distinct."""
    callers = g.edges.where("kind = 'caller'").select("src", "dst")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("bigint").alias("hop"))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(callers, F.col("id") == F.col("dst")).select("start", F.col("src").alias("id")).distinct()
        front = front.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(k).cast("bigint"))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def closure(g: Graph) -> DataFrame:
    """src and each dst that it imports, itself or through others; a round joins one more import until nothing new comes."""
    imports = cut(g.imports.select("src", "dst").distinct())
    seen = Rounds(imports)
    while not seen.last.isEmpty():
        far = seen.last.join(imports.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        seen.add(far.where("src <> dst").distinct().join(seen.all(), ["src", "dst"], "left_anti"))
    return seen.all()


def layers(g: Graph) -> DataFrame:
    """pkg and its layer: 0 without imports, else one more than the highest that it imports.

    A round settles packages whose imports are all settled, so there are as many as layers. Packages on
    a cycle, or above one, never settle: their layers depend on the order of a walk, which is followed a component at a time.
    """
    known = g.packages.select(F.col("pkg").alias("dst"))
    every = cut(g.imports.select("src", "dst").distinct().join(known.withColumn("here", F.lit(True)), "dst", "left"))
    # a package that isn't known counts as one of layer 0
    outside = every.where("here is null").select(F.col("dst").alias("pkg")).distinct()
    own = g.packages.select("pkg").join(every.select(F.col("src").alias("pkg")), "pkg", "left_anti")
    settled = Rounds(own.unionByName(outside).withColumn("layer", F.lit(0).cast("bigint")))
    layer = 0
    while not settled.last.isEmpty():
        layer += 1
        left = every.join(settled.all().select(F.col("pkg").alias("src")), "src", "left_anti")
        ready = left.join(settled.all().select(F.col("pkg").alias("dst"), F.lit(True).alias("done")), "dst", "left").groupBy(F.col("src").alias("pkg")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all")).where("all")
        settled.add(ready.select("pkg", F.lit(layer).cast("bigint").alias("layer")))
    nodes = cut(every.join(settled.all().select(F.col("pkg").alias("src")), "src", "left_anti").select(F.col("src").alias("node")).distinct())
    found = settled.all().join(outside, "pkg", "left_anti")
    return found if nodes.isEmpty() else found.unionByName(strong.layers(every, nodes, settled.all()))
