"""Filter interaction audit: what each filter removes alone, after others, and over all orders, by part of the corpus.

Exact duplicates by sorting: rows are dealt by ranges of (text fingerprint, doc_id), sorted within them by fingerprint, full text and
doc_id, and compared with the row before. A group of copies may go on over many ranges; ids there are ascending, so only the first fingerprint of a
range is open: its texts are looked up among those that end an earlier range. Every row's failures become a mask of five bits;
all measures are sums over masks, so a counter a (part, mask) is all that is merged.

Defined cases: a null text is empty: no words, which fails A only (and E). A null source is the part ''. E compares whole texts; a row without an id
has no smaller one and is none, so it neither fails E nor makes others fail. Rows that repeat an id and text don't fail E by each
other; each counts. Labels that repeat an id count as the greatest of each kind; nulls there and lacking ones as 0.
Distinct words are told by 64-bit hashes within a text. Other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batches, text_buffer, tune, words, written

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, percent of distinct words, percent of capitals, characters.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
_AS_IS = np.arange(256, dtype=np.uint8)
_CAPITAL = np.isin(_AS_IS, np.arange(65, 91))
_MARK = np.isin(_AS_IS, np.frombuffer(MARKS, np.uint8))
_STARTS = (_AS_IS & 0xC0) != 0x80  # bytes that begin a code point


def failures(texts: pa.Array) -> np.ndarray:
    """Masks of A to D of each text."""
    raw, offsets = text_buffer(texts)
    n = len(offsets) - 1
    w = words(raw, offsets, fold=_AS_IS)
    many = w.per_row(n)
    order = np.lexsort((w.hash, w.row))
    h, row = w.hash[order], w.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=n)

    def per_text(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return np.diff(sums[offsets])

    fails = (many < LEAST_WORDS, 100 * distinct < DISTINCT * many, 100 * per_text(_CAPITAL) > CAPITALS * per_text(_STARTS), per_text(_MARK) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _same_as_before(fp: np.ndarray, text: pa.Array) -> np.ndarray:
    """Which rows have the fingerprint and text of the row before."""
    same = np.zeros(len(fp), bool)
    near = np.flatnonzero(fp[1:] == fp[:-1]) + 1
    if len(near):
        equal = pc.equal(text.take(pa.array(near)), text.take(pa.array(near - 1)))
        same[near] = equal.to_numpy(zero_copy_only=False)
    return same


OUT = "kind int, doc_id bigint, part string, mask int, open bigint, place int, fp bigint, text string"
_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("open", pa.int64()), ("place", pa.int32()), ("fp", pa.int64()), ("text", pa.string())])
#: Kinds of rows that a range gives: a document; a text of its first fingerprint; a text of its last one.
DOCUMENT, OPEN, LAST = range(3)


def _compared(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (fp, text, doc_id, part, place) of one range to masks, and its texts at both ends."""
    first: int | None = None  # the range's first fingerprint
    opens = 0
    fp_before, text_before, least = None, None, None  # the run of equal texts so far: its least id is that of its first row
    number = -1  # which text of the first fingerprint it is
    ending: list[str] = []  # texts with an id, of the last fingerprint so far

    def named(kind: int, place: int, fp: int, texts: list[str], opened: list[int]) -> pa.RecordBatch:
        n = len(texts)
        none = [None] * n
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([kind] * n, none, none, none, opened, [place] * n, [fp] * n, texts), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    place = 0
    for batch in batches(data):
        n = batch.num_rows
        fp, text, place = batch.column(0).to_numpy(), batch.column(1), batch.column(4)[0].as_py()
        known = pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column(2), 0).to_numpy()
        if first is None:
            first = int(fp[0])
        same = _same_as_before(fp, text)
        same[0] = fp_before == fp[0] and text[0].as_py() == text_before
        run = np.cumsum(~same)  # 0 is the run that the batch before ended with
        heads = np.flatnonzero(~same)
        least_known = np.concatenate([[least is not None], known[heads]])
        leasts = np.concatenate([[least or 0], ids[heads]])
        again = known & least_known[run] & (ids > leasts[run])
        numbers = np.concatenate([[number], number + 1 + np.arange(len(heads))])
        is_open = (fp == first) & known & ~again
        opened = np.where(is_open, (np.int64(place) << 32) + numbers[run], -1)
        mask = failures(text) | np.where(again, DUPLICATE, 0).astype(np.int32)
        none = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(2), batch.column(3), pa.array(mask), pa.array(opened, mask=~is_open), pa.array(np.full(n, place, np.int32)), pa.nulls(n, pa.int64()), none], schema=_SCHEMA)
        for k, at in enumerate(heads.tolist()):
            if fp_before is None or fp[at] != fp_before:
                ending = []
                fp_before = int(fp[at])
            if known[at]:
                if fp[at] == fp[-1]:
                    ending.append(text[at].as_py())
                if fp[at] == first:
                    yield named(OPEN, place, first, [text[at].as_py()], [(place << 32) + int(numbers[k + 1])])
        number = int(numbers[run[-1]])
        least = int(leasts[run[-1]]) if least_known[run[-1]] else None
        text_before = text[n - 1].as_py()
    if ending:
        yield named(LAST, place, fp_before, ending, [None] * len(ending))


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, part and mask of every document (bit k: it fails filter k)."""
    tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", F.asc_nulls_last("doc_id")).sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id"))
    found = written(rows.select("fp", "text", "doc_id", "part", F.spark_partition_id().alias("place")).mapInArrow(_compared, OUT))
    ends = found.where(F.col("kind") == LAST).select("fp", "text", F.col("place").alias("earlier"))
    copied = found.where(F.col("kind") == OPEN).join(ends, ["fp", "text"]).where("earlier < place").select("open").distinct().withColumn("copied", F.lit(DUPLICATE))
    own = found.where(F.col("kind") == DOCUMENT).select("doc_id", "part", "mask", "open")
    settled = own.where("open is null").drop("open")
    at_ends = own.where("open is not null").join(copied, "open", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("copied", F.lit(0))).alias("mask"))
    return settled.unionByName(at_ends)


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just these filters, and how many of them have labels so."""
    per = masked.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")))
    without = per.where("doc_id is null").select("part", "mask", "n", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    joined = per.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    each = joined.unionByName(without)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the step's filter, and the mask of filters before it, of all permutations."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, x in enumerate(order, 1):
            k = FILTERS.index(x)
            out.append(("".join(order), step, k, before))
            before |= 1 << k
    return out


def interactions(counted: DataFrame) -> DataFrame:
    """A row per part, filter_order and step, from the counters alone: each meets the 80 pairs of a filter and a set before it."""
    pairs = sorted({(k, before) for _, _, k, before in orders()})
    literal = F.array(*(F.struct(F.lit(k).alias("filter"), F.lit(before).alias("before")) for k, before in pairs))
    c = counted.select("*", F.explode(literal).alias("p")).select("part", "mask", "n", "good", "toxic", "p.filter", "p.before")
    bit = F.expr("shiftleft(1, filter)")
    fails, early = F.col("mask").bitwiseAND(bit) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    removed = fails & ~early
    # of 120 orders, a document with k failures is removed by each of its filters in 120 / k
    share = F.expr(f"{len(orders()) // len(FILTERS)} div greatest(bit_count(mask), 1)")
    sums = {
        "kept": (~fails & ~early, F.col("n")), "removed": (removed, F.col("n")), "redundant": (fails & early, F.col("n")), "unique_fails": (F.col("mask") == bit, F.col("n")),
        "good_lost": (removed, F.col("good")), "toxic_lost": (removed, F.col("toxic")), "shapley": (fails, F.col("n") * share),
    }
    per = c.groupBy("part", "filter", "before").agg(*(F.sum(F.when(when, value).otherwise(0)).cast("bigint").alias(name) for name, (when, value) in sums.items()))
    steps = counted.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter int, before int")
    return per.join(F.broadcast(steps), ["filter", "before"]).select("part", "filter_order", "step", *MEASURES)  # 600 rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of all five filters over `docs`."""
    return interactions(counters(masks(docs), labels))
