"""Exact top-k search with vector-approximation files.

The file holds each vector once: exact, and as an approximation of one byte a component, the number of one
of 256 cells of equal width that cover what all but a WIDE share of the vectors need; those are told exactly.

1. Approximations are dealt to blocks of about BLOCK rows and queries to blocks of about QUERIES; each pair of
   blocks is one task of bounded size. A scan of the cells gives each inner product up to an error that is
   the same for all rows: half a cell's width times the sum of the query's absolute components. Rows
   whose upper bound is below the k-th lower bound of the block go.
2. The k-th lower bound over all blocks is each query's threshold; only rows whose upper bound reaches it have
   their exact vectors read. The k-th result is certain then.

What is shuffled for a pair of blocks is a byte a component of the rows and the queries' exact vectors.
Of equal vectors only the rows that can be among the k best are in the file, and rows are dealt by a
number of their own, so nothing grows with a frequent vector or id.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without
vec_id, take no part; vectors of different lengths are not compared; a query given by several equal
rows is answered once, and one of several vectors has each row's best score; other rows that repeat are
candidates each; candidates of the query's own vec_id are its own row. Further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import tune, written

BLOCK, QUERIES = 8192, 2048
CELLS = 256
#: Share of the vectors, by their greatest absolute component, that lies outside the cells.
WIDE = 0.001
#: Queries whose bounds are held at once, times a block's rows.
SLICE = 256
#: Greater sums of absolute products may not be whole in doubles.
EXACT = 2.0**52


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of a column of lists of d numbers."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(-1, d)


def cells(v: np.ndarray, reach: float) -> np.ndarray:
    """The cell of each component between -reach and reach."""
    return np.clip((v + reach) * (CELLS / (2 * reach or 1)), 0, CELLS - 1).astype(np.uint8)


def middles(cell: np.ndarray, reach: float) -> np.ndarray:
    return (cell + 0.5) * (2 * reach / CELLS) - reach


def errors(q: np.ndarray, reach: float) -> np.ndarray:
    """How far the product with a cell's middles can be from the exact one, rounding included."""
    return np.abs(q).sum(axis=1) * (reach / CELLS + reach * 1e-9 * q.shape[1])


def products(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Integer inner products row by row; beyond what doubles hold exactly, in Python's integers."""
    most = (np.abs(a) * np.abs(b)).sum(axis=1)
    plain = np.einsum("ij,ij->i", a, b)
    return [int(p) if m < EXACT else sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for p, m, u, v in zip(plain.tolist(), most.tolist(), a, b, strict=True)]


def candidates(own: np.ndarray, q: np.ndarray, ids: np.ndarray, near: np.ndarray, errors_: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and rows that may be among the k best, with lower and upper bounds.

    near: the rows' middles, or exact values for rows whose error isn't `errors_` but 0 (those of the last column).
    """
    exact = near[:, -1] > 0
    near = near[:, :-1]
    for at in range(0, len(q), SLICE):
        part = q[at : at + SLICE]
        score = part @ near.T
        slack = np.where(exact[None, :], np.abs(score) * 1e-9 + 1, errors_[at : at + SLICE, None])
        score[own[at : at + SLICE, None] == ids[None, :]] = -np.inf
        low, high = score - slack, score + slack
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero((high >= floor[:, None]) & np.isfinite(high))
        yield i + at, j, low[i, j], high[i, j]


def usable(vectors: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """vec_id, d and v (floors of the scaled components) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  greater doubles are whole
    whole = vectors.select(F.col(id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    whole = whole.where(F.size("v") > 0).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return whole.select("vec_id", F.size("v").alias("d"), F.transform("v", lambda x: floor(x * scale)).alias("v"))


def reaches(whole: DataFrame) -> dict[int, float]:
    """How far the cells of each length of vectors reach."""
    greatest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return {r.d: r.reach for r in whole.groupBy("d").agg(F.percentile_approx(greatest, 1 - WIDE, 10000).alias("reach")).collect()}


def of_use(whole: DataFrame, k: int) -> DataFrame:
    """Rows that any query may have among its k best: of equal vectors, which score alike, those of the k + 1 least ids, k of each.

    Both limits are applied before rows are shuffled, so a frequent vector is few rows.
    """
    again, place = Window.partitionBy("v", "vec_id").orderBy("d"), Window.partitionBy("v").orderBy("vec_id")
    few = whole.withColumn("again", F.row_number().over(again)).where(F.col("again") <= k).drop("again")
    return few.withColumn("place", F.dense_rank().over(place)).where(F.col("place") <= k + 1).drop("place")


def approximated(rows: DataFrame, reach: dict[int, float]) -> DataFrame:
    """The file: uid, vec_id, d, v, cells (null for what is outside them) and reach of rows (vec_id, d, v)."""
    tune(rows.sparkSession)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            t = pa.Table.from_batches([batch])
            for d in np.unique(t["d"].to_numpy()).tolist():
                mine = t.filter(pc.equal(t["d"], d))
                x = matrix(mine["v"], d)
                inside = np.abs(x).max(axis=1) <= reach[d]
                packed = [c.tobytes() if ok else None for c, ok in zip(cells(x, reach[d]), inside, strict=True)]
                yield pa.RecordBatch.from_arrays([mine["vec_id"].combine_chunks(), mine["d"].combine_chunks(), mine["v"].combine_chunks(), pa.array(packed, pa.binary()), pa.array(np.full(len(x), reach[d]))], names=["vec_id", "d", "v", "cells", "reach"])

    file = rows.select("vec_id", "d", "v").mapInArrow(run, "vec_id bigint, d int, v array<double>, cells binary, reach double")
    return written(file.select(F.monotonically_increasing_id().alias("uid"), "*"))


def survivors(file: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """quid, uid: pairs of queries and rows whose upper bound reaches the k-th lower bound of the query."""
    n, m = file.count(), asked.count()
    n_blocks, q_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    block = lambda of: F.pmod(F.xxhash64("uid"), F.lit(of)).cast("int")
    rows = file.select("d", "reach", "uid", "vec_id", "cells", F.when(F.col("cells").isNull(), F.col("v")).alias("v"), F.lit(False).alias("q"), block(n_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    queries = asked.select("d", "reach", "uid", "vec_id", F.lit(None).cast("binary").alias("cells"), "v", F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"), block(q_blocks).alias("qb"))

    def run(t: pa.Table) -> pa.Table:
        d, reach = t["d"][0].as_py(), t["reach"][0].as_py()
        asked, rows = t.filter(t["q"]), t.filter(pc.invert(t["q"]))
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and rows.num_rows:
            near = np.empty((rows.num_rows, d + 1))
            known = rows["cells"].is_valid().to_numpy()
            near[:, d] = ~known
            near[known, :d] = middles(np.frombuffer(b"".join(rows["cells"].drop_null().to_pylist()), np.uint8).reshape(-1, d), reach)
            if not known.all():
                near[~known, :d] = matrix(rows["v"].drop_null(), d)
            q = matrix(asked["v"], d)
            quid, own, uid, ids = asked["uid"].to_numpy(), asked["vec_id"].to_numpy(), rows["uid"].to_numpy(), rows["vec_id"].to_numpy()
            out = [(quid[i], own[i], uid[j], low, high) for i, j, low, high in candidates(own, q, ids, near, errors(q, reach), k)]
        quid, own, uid, low, high = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 5
        return pa.table({"quid": pa.array(quid, pa.int64()), "query_id": pa.array(own, pa.int64()), "uid": pa.array(uid, pa.int64()), "low": pa.array(low, pa.float64()), "high": pa.array(high, pa.float64())})

    found = written(queries.unionByName(rows).groupBy("d", "cb", "qb").applyInArrow(run, "quid bigint, query_id bigint, uid bigint, low double, high double"))
    order = Window.partitionBy("quid").orderBy(F.col("low").desc(), "uid")
    floor = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("quid").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("floor"))
    floor = floor.select("quid", F.when(F.col("n") == k, F.col("floor")).otherwise(float("-inf")).alias("floor"))
    return found.join(floor, "quid").where(F.col("high") >= F.col("floor")).select("quid", "uid")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: each query (ids divisible by `every`) against all rows.

    Scores are inner products of floor(scale * x); one beyond 64 bits is given as the nearest that fits.
    """
    whole = usable(vectors, id, vector, scale)
    reach = reaches(whole)
    file = approximated(of_use(whole, k), reach)
    asked = approximated(whole.where(F.col("vec_id") % every == 0).distinct(), reach)
    pairs = survivors(file, asked, k)
    pairs = pairs.join(asked.select(F.col("uid").alias("quid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "quid").join(file.select("uid", "vec_id", "v"), "uid")

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            t = pa.Table.from_batches([batch])
            lengths = pc.list_value_length(t["q"]).to_numpy()
            for d in np.unique(lengths).tolist():
                mine = t.filter(pa.array(lengths == d))
                score = products(matrix(mine["q"], d), matrix(mine["v"], d))
                score = pa.array([max(-1 << 63, min((1 << 63) - 1, x)) for x in score], pa.int64())
                yield pa.RecordBatch.from_arrays([*(mine[c].combine_chunks() for c in ("query_id", "uid", "vec_id")), score], names=["query_id", "uid", "vec_id", "score"])

    exact = pairs.select("query_id", "uid", "vec_id", "q", "v").mapInArrow(run, "query_id bigint, uid bigint, vec_id bigint, score bigint")
    best = exact.groupBy("query_id", "uid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
