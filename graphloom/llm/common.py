"""Helpers shared by the text operators: reading tables, checkpoints, and word hashing over Arrow buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to a Python worker; texts are long, so the default of 10,000 rows would be hundreds of MB.
ARROW_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python workers by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names: Iterable[str], name: str) -> str:
    """`name`, with as many underscores behind it as it takes to differ from all `names` (letter case aside)."""
    taken = {x.lower() for x in names}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (spark.checkpoint.dir); one of our own only where none is set."""
    ctx = spark.sparkContext
    named = ctx.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not ctx.getCheckpointDir():
            ctx.setCheckpointDir(named)
    elif not ctx.getCheckpointDir():
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        ctx.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-ckpt-"))
    return ctx.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that a lost executor costs no recomputation of what stands before.

    What was shuffled for it isn't needed any more then; Spark deletes that once the driver's garbage is collected.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame) -> DataFrame:
    """Like `checkpointed`, as compressed Parquet in the shared folder; the reader's partitions may differ from the writer's."""
    at = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (rows + 1); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, so that a polynomial doesn't depend on how close byte values are.
_BYTE = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
#: A random 64-bit value for each byte at each place of a word of up to LONG bytes: two such words share a sum with a chance of 2^-64.
LONG = 64
_PLACED = _splitmix(np.arange(1, LONG * 256 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(LONG, 256)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: sums of random values by place and byte, XXH3 for spans over LONG bytes."""
    out = np.zeros(len(start), np.uint64)
    short = np.where(length > LONG, 0, length).astype(np.uint8)
    order = np.argsort(LONG - short, kind="stable")  # longest first, so that those with a k-th byte stand in front
    left = np.searchsorted((LONG - short)[order], LONG - np.arange(LONG), side="left")  # spans of more than k bytes
    at, sums = start[order], np.zeros(len(start), np.uint64)
    for k in range(LONG):
        m = left[k]
        if not m:
            break
        sums[:m] += _PLACED[k][data[at[:m] + k]]
    out[order] = sums
    out = _splitmix(out ^ length.astype(np.uint64) << np.uint64(48))
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]].tobytes())
    return out


@dataclass
class Words:
    """Words of a batch of texts, in order."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    lower: np.ndarray  # the bytes, folded (A-Z lower-cased)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have more bytes than `size`, and hashes of their first `size`."""
        long = np.flatnonzero(self.end - self.start > size)
        return long, _splitmix(span_hashes(self.lower, self.start[long], np.full(len(long), size)) + np.uint64(size))

    def per_row(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows).astype(np.int64)


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts laid end to end, with a 64-bit hash of each; `space` marks other separators, `fold` maps bytes first.

    Words never span two texts. No Python loop runs over words, but over those of more than LONG bytes.
    """
    lower = fold[raw]
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), lower)
    ink = ~space[raw]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    breaks = offsets[1:-1]
    cut = np.zeros(n, bool)
    cut[breaks[breaks < n]] = True
    first = ink & (first | cut)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~ink[1:] | cut[1:]
    last &= ink
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, row, span_hashes(lower, start, end - start), lower)


def batches(data: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about `limit` bytes at most, but one row at least."""
    for batch in data:
        if batch.nbytes <= limit or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        rows = max(1, int(batch.num_rows * limit / batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def merged(data: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Joins small batches of short rows, so that work for each batch is done less often."""
    held: list[pa.RecordBatch] = []
    for batch in data:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
