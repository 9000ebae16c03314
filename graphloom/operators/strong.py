"""Strongly connected components of a table of edges, and layers of a walk in the order of names over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoints import Rounds, cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (its least member) of every node, by edges (src, dst) between them.

    First, nodes that nothing leads to or from any more are components of their own, until none is left. Then the least label spreads along edges; the
    members of a label's component are those that lead back to its node within what it has reached. What is left begins again. All steps are
    joins on nodes, each as large as what is left.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    left = cut(nodes.select("node").distinct())
    done = Rounds(left.limit(0).withColumn("component", F.col("node")))
    while not left.isEmpty():
        heads, tails = e.select(F.col("dst").alias("node")).distinct(), e.select(F.col("src").alias("node")).distinct()
        inner = cut(left.join(heads, "node", "left_semi").join(tails, "node", "left_semi"))
        alone = done.add(left.join(inner, "node", "left_anti").withColumn("component", F.col("node")))
        if alone.isEmpty():
            found = done.add(_around(left, e))
            left = cut(left.join(found.select("node"), "node", "left_anti"))
        else:
            left = inner
        e = cut(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done.all()


def _around(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """Components of the nodes that no lesser one leads to."""
    label = cut(nodes.select("node", F.col("node").alias("label"), F.lit(True).alias("new")))
    while not label.where("new").isEmpty():
        led = label.where("new").join(e.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("least"))
        lesser = F.coalesce(F.col("least") < F.col("label"), F.lit(False))
        label = cut(label.join(led, "node", "left").select("node", F.when(lesser, F.col("least")).otherwise(F.col("label")).alias("label"), lesser.alias("new")))
    src, dst = label.select(F.col("node").alias("src"), "label"), label.select(F.col("node").alias("dst"), "label")
    within = cut(e.join(src, "src").join(dst, ["dst", "label"]).select("src", "dst"))
    back = Rounds(label.where("node = label").select("node", F.col("label").alias("component")))
    while not back.last.isEmpty():
        more = back.last.join(within, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "component").distinct()
        back.add(more.join(back.all().select("node"), "node", "left_anti"))
    return back.all()


def _traversal(imports: dict[str, list[str]], entry: str) -> Iterator[tuple[str, str]]:
    """Edges of one component in the order that a walk from its entry meets them."""
    walked, stack = {entry}, [(entry, iter(imports[entry]))]
    while stack:
        pkg, further = stack[-1]
        to = next(further, None)
        if to is None:
            stack.pop()
            continue
        yield pkg, to
        if to in imports and to not in walked:
            walked.add(to)
            stack.append((to, iter(imports[to])))


def _met(t: pa.Table) -> pa.Table:
    """Rows (src, dst, entry) of a component to (src, dst, place), places in the order of the walk."""
    imports: dict[str, list[str]] = {}
    for a, b in sorted(zip(t["src"].to_pylist(), t["dst"].to_pylist(), strict=True)):
        imports.setdefault(a, []).append(b)
    found = list(_traversal(imports, t["entry"][0].as_py()))
    return pa.table({"src": pa.array([a for a, _ in found], pa.string()), "dst": pa.array([b for _, b in found], pa.string()), "place": pa.array(range(len(found)), pa.int64())})


def _layered(t: pa.Table) -> pa.Table:
    """Rows (src, dst, entry, layer) of a component, layer null within it, to (pkg, layer).

    What is met again while it is being walked counts as 0, and a layer once found stays.
    """
    imports: dict[str, list[tuple[str, int | None]]] = {}
    for a, b, k in sorted(zip(t["src"].to_pylist(), t["dst"].to_pylist(), t["layer"].to_pylist(), strict=True), key=lambda x: x[:2]):
        imports.setdefault(a, []).append((b, k))
    layer: dict[str, int] = {}
    entry = t["entry"][0].as_py()
    walked, stack = {entry}, [[entry, 0, 0]]
    while stack:
        pkg, at, high = stack[-1]
        if at == len(imports[pkg]):
            layer[pkg] = high
            stack.pop()
            if stack:
                stack[-1][2] = max(stack[-1][2], high + 1)
            continue
        stack[-1][1] += 1
        to, known = imports[pkg][at]
        if known is not None or to in walked:
            stack[-1][2] = max(high, (known if known is not None else layer.get(to, 0)) + 1)
        else:
            walked.add(to)
            stack.append([to, 0, 0])
    return pa.table({"pkg": pa.array(layer, pa.string()), "layer": pa.array(list(layer.values()), pa.int64())})


def entries(edges: DataFrame, of: DataFrame) -> DataFrame:
    """component and entry: the member that a walk over all nodes, in the order of their names, comes to first.

    A walk meets edges in the order of what led it there: the name it began with, then the place of each edge in the component
    that it left by. So the first of a component's edges in is the least of these keys, and components can be settled from the top, all of a
    round at once; the walk within one begins where it is entered.
    """
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("from")), of.select(F.col("node").alias("dst"), F.col("component").alias("into"))
    e = cut(edges.join(a, "src").join(b, "dst"))
    across = cut(e.where(F.col("from") != F.col("into")).select("from", "into").distinct())
    none = F.array().cast("array<bigint>")
    # every component may be where a walk begins, at its least member
    begun = of.groupBy("component").agg(F.min("node").alias("entry")).select("component", "entry", F.struct(F.col("entry").alias("root"), none.alias("way")).alias("key"))
    ways = Rounds(begun)
    size = cut(of.groupBy("component").agg((F.count(F.lit(1)) == 1).alias("single")))
    settled = Rounds(begun.join(size, "component").limit(0))
    while True:
        waiting = size.join(settled.all().select("component"), "component", "left_anti")
        held = across.join(waiting.select(F.col("component").alias("from")), "from", "left_semi").select(F.col("into").alias("component")).distinct()
        ready = waiting.join(held, "component", "left_anti")
        first = settled.add(ways.all().join(ready, "component").groupBy("component", "single").agg(F.min(F.struct("key", "entry")).alias("x")).select("component", "x.entry", "x.key", "single"))
        if first.isEmpty():
            return settled.all().select("component", "entry")
        out = e.join(first.select(F.col("component").alias("from"), "entry", "key", "single"), "from")
        inner = out.where("not single").groupBy("from").applyInArrow(lambda t: _met(t.select(["src", "dst", "entry"])), "src string, dst string, place bigint")
        lone = out.where("single").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("d")).select("src", F.posexplode("d").alias("place", "dst")).select("src", "dst", F.col("place").cast("bigint").alias("place"))
        met = out.where(F.col("from") != F.col("into")).join(inner.unionByName(lone), ["src", "dst"])
        ways.add(met.groupBy(F.col("into").alias("component")).agg(F.min(F.struct(F.struct(F.col("key.root").alias("root"), F.concat("key.way", F.array("place")).alias("way")).alias("key"), F.col("dst").alias("entry"))).alias("x")).select("component", "x.entry", "x.key"))


def layers(edges: DataFrame, nodes: DataFrame, below: DataFrame) -> DataFrame:
    """pkg and layer of nodes (node) on cycles or above them; edges (src, dst) are all of theirs, below (pkg, layer) what is settled.

    No task holds more than a component: they are walked one by one, from the bottom, each from where a walk over all enters it.
    """
    mine = cut(edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").distinct())
    within = mine.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    of = cut(components(nodes, within))
    first = cut(entries(within, of))
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("from")), of.select(F.col("node").alias("dst"), F.col("component").alias("into"))
    e = cut(mine.join(a, "src").join(b, "dst", "left").join(first.withColumnRenamed("component", "from"), "from"))
    size = e.select("from", "src").distinct().groupBy("from").agg((F.count(F.lit(1)) == 1).alias("single"))
    looped = e.where("src = dst").select("from").distinct().withColumn("loop", F.lit(True))
    e = cut(e.join(size, "from").join(looped, "from", "left").withColumn("single", F.col("single") & F.col("loop").isNull()).drop("loop"))
    known = Rounds(below.select("pkg", "layer"))
    while True:
        waiting = e.join(known.all().select(F.col("pkg").alias("src")), "src", "left_anti")
        at = waiting.join(known.all().select(F.col("pkg").alias("dst"), "layer"), "dst", "left")
        held = at.where(F.col("layer").isNull() & ~F.col("from").eqNullSafe(F.col("into"))).select("from").distinct()
        ready = cut(at.join(held, "from", "left_anti"))
        if ready.isEmpty():
            break
        plain = ready.where("single").groupBy(F.col("src").alias("pkg")).agg((F.max("layer") + 1).alias("layer"))
        walked = ready.where("not single").groupBy("from").applyInArrow(lambda t: _layered(t.select(["src", "dst", "entry", "layer"])), "pkg string, layer bigint")
        known.add(plain.unionByName(walked))
    return known.all().join(nodes.withColumnRenamed("node", "pkg"), "pkg", "left_semi")
