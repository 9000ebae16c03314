"""Near-duplicates by bottom-k sketches of one hash function, with links confirmed on full sets.

A document's set is its distinct word shingles; two documents are linked where the Jaccard similarity
of their sets is at least `percent`. Documents of equal sets form one class and go on as one node.

1. Each node's sketch is the K least hashes of its set. Two sketches of linked sets share at least T
   values: exactly so where sets fit in the sketch, and otherwise T lies seven standard deviations
   below what similarity `percent` gives (a chance of about 1e-9 for a pair just at the threshold).
2. Values are ordered by how many sketches retain them, rare ones first. Two sketches that share T of
   their values share one among the first m - T + 1 of either, so only those make inverted lists. A
   passage that many documents share is frequent, and so outside of that prefix unless it makes up
   most of a document.
3. Lists of a value with at most SMALL sketches give all their pairs, larger ones the pairs with their
   first member. The sketch of the union estimates a pair's similarity; pairs below T go.
4. The rest is verified on full sets, and components of verified links are found.
5. Large lists that now hold several components are finished exactly: their nodes form families (by
   shared lists), families fall into bands of sizes within which links are possible, bands into
   blocks of at most BLOCK nodes, and pairs of blocks are compared on full sets inside a task, which
   emits no more links than its nodes need. No pair is left out and no list is cut.

Defined cases: null, empty and blank texts have an empty set, link with nothing and stay; fewer words
than a shingle form one; rows of the same doc_id and set are one node (each stays or goes with it); a
null doc_id counts as larger than any other, and a component of nothing else has a null component_id
and keeps all its rows; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batches, checkpointed, text_buffer, tune, unused
from graphloom.llm.components import components
from graphloom.llm.shingles import overlap, shingle_sets

K = 64
SMALL = 16
BLOCK = 512
SIGMAS = 7
COLUMNS = 4096
BUCKETS = 1 << 20


def least_shared(k: int, percent: int) -> int:
    """T of a full sketch."""
    p = percent / 100
    return max(1, math.floor(k * p - SIGMAS * math.sqrt(k * p * (1 - p))))


def _sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            h, at = shingle_sets(*text_buffer(batch.column(2)), size)
            n = np.diff(at)
            sig = [xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            short = np.minimum(n, k)
            starts = np.concatenate([[0], np.cumsum(short)]).astype(np.int32)
            pick = np.arange(starts[-1]) - np.repeat(starts[:-1], short) + np.repeat(at[:-1], short)
            sketch = pa.ListArray.from_arrays(starts, pa.array((h[pick] ^ np.uint64(1 << 63)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), sketch], names=["doc_id", "th", "n", "sig", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, n bigint, sig binary, sketch array<bigint>")


def _full_sets(rows: DataFrame, size: int) -> DataFrame:
    """nid, whole set (binary, 8 bytes a hash) of rows (nid, sig, text); rows whose text has another set go."""

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            h, at = shingle_sets(*text_buffer(batch.column(2)), size)
            sets = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            right = pa.array([xxhash.xxh3_128_digest(s) == sig.as_py() for s, sig in zip(sets, batch.column(1), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["nid", "whole"]).filter(right)

    return rows.mapInArrow(run, "nid bigint, whole binary")


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _estimated(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, sure of pairs with both sketches; pairs that can't be linked go."""
    least = least_shared(k, percent)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            keep, sure = [], []
            s, t = batch.column(4), batch.column(5)
            for i, (n, m) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = s[i].values.to_numpy(), t[i].values.to_numpy()
                whole = n <= k and m <= k
                if whole:
                    keep.append(linked(overlap(x, y), n, m, percent))
                else:
                    union = np.union1d(x, y)[:k]
                    keep.append(int((np.isin(union, x) & np.isin(union, y)).sum()) >= min(least, len(union)))
                sure.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sure, pa.bool_())], names=["a", "b", "sure"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a bigint, b bigint, sure boolean")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                keep.append(linked(overlap(a, b), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of intersections of every set of x with every set of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    fx, fy = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(fx, fy)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        sides = []
        for flat, rows, n in ((fx, rx, len(x)), (fy, ry, len(y))):
            where = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[where] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], where[hit]] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def block_links(ids: list[int], labels: list[int], sets: list[np.ndarray], left: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between a block's two sides that join different components; one is enough where others join the same."""
    x = [i for i, side in enumerate(left) if side]
    y = [i for i, side in enumerate(left) if not side] or x
    if not x or not y:
        return []
    common = common_counts([sets[i] for i in x], [sets[i] for i in y])
    n, m = np.array([len(sets[i]) for i in x])[:, None], np.array([len(sets[i]) for i in y])[None, :]
    lx, ly = np.array([labels[i] for i in x])[:, None], np.array([labels[i] for i in y])[None, :]
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.get(v, v) != v:
            v = root[v]
        return v

    out = []
    for i, j in np.argwhere((100 * common >= percent * (n + m - common)) & (lx != ly)).tolist():
        a, b = find(labels[x[i]]), find(labels[y[j]])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[x[i]], ids[y[j]]))
    return out


def _rest(entries: DataFrame, labels: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one large list that are not yet in one component; step 5 above."""
    known = entries.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    mixed = known.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("nid").alias("first")).where("lo <> hi")
    left = checkpointed(known.join(mixed.select("v", "first"), "v").select("nid", "n", "label", "first"))
    family = components(left.select(F.col("nid").alias("a"), F.col("first").alias("b")))
    # sizes of linked sets differ by a factor of 100 / percent at most: their bands are equal or next to each other
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) - 1e-9).cast("int")
    nodes = left.select("nid", "n", "label").distinct().join(family.select(F.col("node").alias("nid"), F.col("label").alias("family")), "nid").withColumn("band", band)
    sizes = nodes.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    above = sizes.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = sizes.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    sizes = sizes.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left").na.fill(0)
    nodes = nodes.join(sizes, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda lo, kind, i, j, side: F.struct(lo.alias("lo"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    b, own = F.col("band"), F.col("block")
    inside = F.transform(every(F.col("blocks")), lambda o: task(b, "=", F.least(own, o), F.greatest(own, o), own <= o))
    lower = F.transform(every(F.col("up")), lambda o: task(b, "<", own, o, F.lit(True)))
    upper = F.transform(every(F.col("down")), lambda o: task(b - 1, "<", o, own, F.lit(False)))
    dealt = nodes.select("family", "nid", "label", F.explode(F.concat(inside, lower, upper)).alias("t")).select("family", "nid", "label", "t.*").join(whole, "nid")

    def run(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(z.as_buffer(), np.uint64) for z in t["whole"]]
        found = block_links(t["nid"].to_pylist(), t["label"].to_pylist(), sets, t["side"].to_pylist(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return dealt.groupBy("family", "lo", "kind", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id and kept of every document."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    done = _sketches(rows, size, k)  # made again for the result, which takes less than keeping all sketches
    id_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = done.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(id_last).alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbers are those of a table that is written, so they stay when a task runs again
    classes = checkpointed(classes).select(F.monotonically_increasing_id().alias("nid"), "sig", "key.doc_id", "key.th", "n", "sketch")

    values = classes.select("nid", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = values.join(shared, "v").groupBy("nid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    m = F.least(F.col("n"), F.lit(k))
    least = least_shared(k, percent)
    t = F.when(F.col("n") * percent < k * (percent * percent / 100.0), F.ceil(F.col("n") * percent / 100.0 - 1e-9)).otherwise(F.lit(least))
    first = (m - t + 1) - (m - F.size("held"))  # values of one sketch alone stand before those
    entries = held.where(first > 0).select("nid", "n", F.explode(F.slice("held", F.lit(1), first.cast("int"))).alias("e")).select("nid", "n", "e.v", "e.df")
    entries = checkpointed(entries)

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    small = entries.where(F.col("df") <= SMALL)
    other = small.select("v", F.col("nid").alias("b"), F.col("n").alias("m"))
    few = small.select("v", F.col("nid").alias("a"), "n").join(other, "v").where("a < b").where(fits(F.col("n"), F.col("m"))).select("a", "b")
    large = entries.where(F.col("df") > SMALL)
    pivots = large.groupBy("v").agg(F.min(F.struct("nid", "n")).alias("p")).select("v", F.col("p.nid").alias("a"), F.col("p.n").alias("m"))
    stars = large.join(pivots, "v").where("a < nid").where(fits(F.col("n"), F.col("m"))).select("a", F.col("nid").alias("b"))
    pairs = few.unionByName(stars).distinct()
    sketches = classes.select("nid", "n", "sketch")
    pairs = pairs.join(sketches.select(F.col("nid").alias("a"), "n", F.col("sketch").alias("s")), "a").join(sketches.select(F.col("nid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t")), "b")
    pairs = checkpointed(_estimated(pairs, k, percent))

    unsure = pairs.where(~F.col("sure")).select("a", "b")
    wanted = unsure.select(F.col("a").alias("nid")).unionByName(unsure.select(F.col("b").alias("nid"))).unionByName(large.select("nid")).distinct()
    wanted = checkpointed(wanted.join(classes.select("nid", "sig", "doc_id", "th"), "nid"))
    texts = rows.withColumnsRenamed({"doc_id": "d", "th": "h"})
    # texts that none of the wanted can be stay where they are: a set of at most BUCKETS numbers tells most of them
    bucket = F.pmod(F.xxhash64("th", F.lit(1)), F.lit(BUCKETS)).alias("bucket")
    texts = texts.join(F.broadcast(wanted.select(bucket).distinct()), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(BUCKETS)) == F.col("bucket"), "left_semi")
    found = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("nid", "sig", "text")
    whole = checkpointed(_full_sets(found, size).dropDuplicates(["nid"]))
    both = unsure.join(whole.select(F.col("nid").alias("a"), F.col("whole").alias("x")), "a").join(whole.select(F.col("nid").alias("b"), F.col("whole").alias("y")), "b")
    links = checkpointed(pairs.where("sure").select("a", "b").unionByName(_verified(both, percent)))
    labels = components(links)
    rest = checkpointed(_rest(large, labels, whole, percent))
    if not rest.isEmpty():  # links between components, by their labels
        at = lambda c: F.coalesce(f"{c}_label", c)
        for c in ("a", "b"):
            rest = rest.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
        top = components(rest.select(at("a").alias("a"), at("b").alias("b")))
        labels = labels.unionByName(top.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
        labels = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    joined = labels

    named = classes.select("nid", "sig", "doc_id").join(joined.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(ids, "label").select("sig", "component_id", F.lit(True).alias("known"))
    out = done.select("doc_id", "th", "n", "sig").join(named, "sig", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, with its own columns. Of rows that repeat an id and text, the one with the least hash of its columns stays."""
    kid, kth, th, row = (unused(docs.columns, n) for n in ("kept_id", "kept_th", "th", "row"))
    kept = near_duplicates(docs, id, text, size, percent).where("kept").select(F.col("doc_id").alias(kid), F.col("th").alias(kth)).distinct()
    own = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = own.join(kept, own[id].eqNullSafe(kept[kid]) & (own[th] == kept[kth]))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*plain))
    return joined.groupBy(F.col(id).alias(kid), F.col(th).alias(kth)).agg(one.alias(row)).select(f"{row}.*")
