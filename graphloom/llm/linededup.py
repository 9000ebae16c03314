"""Line dedup by content-defined chunks of lines.

A text is cut into chunks at each newline, and within a line before a word where the hash of the bytes
of the word before it and its own is less than those of the AROUND places on either side. A cut depends on
few words, so a passage is cut alike wherever it stands, whatever its punctuation and whatever stands
beside it, but for AROUND words at its edges.

1. Chunk hashes are counted over all documents; a bitmap tells nearly all chunks that stand once.
2. Consecutive chunks that stand more than once and have at least RUN words together, and the chunks beside them,
   send their bytes to where their hash is. The least document among those keeps a chunk, at its first place;
   it is compared, byte by byte, with all others.
3. All other places lose it where consecutive repeated chunks have at least LEAST words together, so short
   stock lines stay. What is removed goes with the white space after it. Only documents that lose
   something are shuffled.
4. A run of such chunks goes on at both ends, word by word, as far as the next two chunks and those that
   stand there in the document that keeps it are the same; a passage has no cut beyond its last one, so
   that is all of it. What goes so is kept by a lesser document (or stands earlier in the same one), which
   gives it up to a still lesser one only.

A hash that two different repeated chunks share (64 bits) is resolved for the bytes that are kept; the
other stays. The bitmap, of a bit for eight bytes of text and 2^MOST_FILTER bits at most, and the BUCKETS that
tell which documents may lose something only save shuffling: where they are full, all chunks or texts go.

Defined cases: a null text stays null, an empty one empty; a document that loses all its chunks has an
empty text, and `dedup` drops it; rows of one id are one document: what it keeps, each row of it keeps;
a document without an id gives way to any that has one, and keeps what only such share; an empty table
gives an empty one; further columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from graphloom.llm.common import _BYTE, _SPACE, _power_tables, _splitmix, batches, text_buffer, tune, unused, written

LEAST, RUN = 18, 10
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Places between words on either side of which a cut has the least hash; of 2 * AROUND + 1, one is a cut.
AROUND = 4
#: Bits of the bitmap of repeated chunks (64 MB at most), and buckets that tell which documents may lose some.
LEAST_FILTER, MOST_FILTER, BUCKETS = 22, 29, 1 << 20
#: Bytes of text whose chunk hashes meet in a partition.
PART = 64 << 20


@dataclass
class Chunks:
    """Chunks of texts laid end to end, in order; bytes from start to end are the chunk, `after` is where the next one starts."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    after: np.ndarray
    words: np.ndarray
    hash: np.ndarray


def chunks(raw: np.ndarray, offsets: np.ndarray) -> Chunks:
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Chunks(none, none, none, none, none, none)
    ink = ~_SPACE[raw]
    cut = np.zeros(n, bool)
    cut[offsets[1:-1][offsets[1:-1] < n]] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1  # of words
    if not len(start):
        return Chunks(none, none, none, none, none, none)
    row = np.searchsorted(offsets, start, side="right") - 1
    lines = np.zeros(n + 1, np.int32)
    np.cumsum(raw == 10, out=lines[1:])
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    hashed = lambda a, b: _splitmix((sums[b] - sums[a]) * down[a] ^ (b - a).astype(np.uint64))
    begins = np.ones(len(start), bool)
    begins[1:] = (row[1:] != row[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    line = np.cumsum(begins, dtype=np.int32)
    place = np.full(len(start), ~np.uint64(0))  # before each word that doesn't begin a line
    place[1:] = np.where(begins[1:], place[1:], hashed(start[:-1], end[1:]))
    least = ~begins
    for k in range(1, AROUND + 1):
        same = line[k:] == line[:-k]
        least[k:] &= ~same | (place[k:] < place[:-k])
        least[:-k] &= ~same | (place[:-k] <= place[k:])
    begins |= least
    head = np.flatnonzero(begins)  # the first word of each chunk
    tail = np.append(head[1:], len(start))
    c_row, c_start, c_end = row[head], start[head], end[tail - 1]
    after = offsets[1:][c_row].copy()
    again = c_row[1:] == c_row[:-1]
    after[:-1][again] = c_start[1:][again]
    return Chunks(c_row, c_start, c_end, after, tail - head, hashed(c_start, c_end).view(np.int64))


def _numbers(c: Chunks) -> np.ndarray:
    """Each chunk's number in its text."""
    if not len(c.row):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, c.row[1:] != c.row[:-1]))
    return np.arange(len(c.row)) - np.repeat(new, np.diff(np.append(new, len(c.row))))


def _repeated(rows: DataFrame, total: int) -> np.ndarray:
    """A bitmap of the chunk hashes that stand more than once, by their first bits; `rows` has the texts, `total` their bytes.

    Tasks send sorted hashes by range, two of each at most from what they hold; a range finds what it has twice and gives its slice of the bitmap.
    """
    bits = min(MOST_FILTER, max(LEAST_FILTER, (total // 8).bit_length()))
    parts = 1 << max(0, min(bits - 3, (total // PART).bit_length()))
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        some = np.ones(len(h), bool)
        some[2:] = h[2:] != h[:-2]  # two of a hash tell that it stands more than once, however often a stock line does
        h = h[some]
        at = [0, *np.searchsorted(h, edges).tolist(), len(h)]
        some = [p for p in range(parts) if at[p] < at[p + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[at[p] : at[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "hashes"])

    def hashes(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches(data):
            held.append(chunks(*text_buffer(batch.column(0))).hash.view(np.uint64))
            if sum(len(h) for h in held) >= 1 << 20:
                yield send(held)
                held = []
        if held:
            yield send(held)

    def twice(t: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t["hashes"]]))
        out = np.zeros((1 << bits) // parts, bool)
        out[((h[1:][h[1:] == h[:-1]] >> np.uint64(64 - bits)) & np.uint64(len(out) - 1)).astype(np.int64)] = True
        return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.mapInArrow(hashes, "part int, hashes binary").groupBy("part").applyInArrow(twice, "part int, bits binary").toLocalIterator():  # the bitmap, in slices
        out[r.part * len(r.bits) : (r.part + 1) * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _within(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) >> np.uint64(65 - (8 * len(bits)).bit_length())
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _in_runs(found: np.ndarray, c: Chunks) -> np.ndarray:
    """Which of the found chunks stand in runs of at least RUN words."""
    begins = np.ones(len(found), bool)
    begins[1:] = (found[1:] != found[:-1]) | (c.row[1:] != c.row[:-1])
    run = np.cumsum(begins) - 1
    return found & (np.bincount(run, c.words)[run] >= RUN)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, th (a hash of the text), the numbers of chunks that a document has to lose, if they are many words together, and
    ends: beside chunk i on this side (1: after, -1: before), `step` chunks away, the keeping document has the chunk `body`."""
    spark = docs.sparkSession
    tune(spark)
    rows = _keyed(docs, id, text)
    kind = rows.schema["d"].dataType.simpleString()

    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = spark.sparkContext.broadcast(_repeated(rows.select("text"), total))

    def bodies(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            raw, at = text_buffer(batch.column(2))
            c = chunks(raw, at)
            if not len(c.row):
                continue
            found, same = _in_runs(_within(bits.value, c.hash), c), c.row[1:] == c.row[:-1]
            sent = found.copy()
            for _ in range(2):  # a run goes on into two chunks at most: cuts are more than AROUND words apart
                before = sent.copy()
                sent[1:] |= before[:-1] & same
                sent[:-1] |= before[1:] & same
            keep = np.flatnonzero(sent)
            own, number = c.row[keep], _numbers(c)[keep]
            order = np.lexsort((c.hash[keep], own))
            one, two = own[order], c.hash[keep][order]
            first = np.ones(len(keep), bool)
            first[order[1:]] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            data_ = raw.tobytes()
            body = [data_[a:b] for a, b in zip(c.start[keep].tolist(), c.end[keep].tolist(), strict=True)]
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(number.astype(np.int32)), pa.array(~first), pa.array(found[keep]), pa.array(c.hash[keep]), pa.array(body, pa.binary())], names=["d", "th", "i", "again", "run", "h", "body"])

    places = written(rows.mapInArrow(bodies, f"d {kind}, th bigint, i int, again boolean, run boolean, h bigint, body binary"))
    many = places.where("run")
    least = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "again", "th", "i", "body"))  # an id is better than none
    kept = many.groupBy("h").agg(F.count(F.lit(1)).alias("n"), least.alias("kept")).where("n > 1").select("h", "kept")
    gone = (F.col("body") == F.col("kept.body")) & (~F.col("d").eqNullSafe(F.col("kept.d")) | F.col("again"))
    each = many.join(kept, "h").select("d", "th", F.struct("i", gone.alias("gone"), F.col("kept.d").alias("f"), F.col("kept.th").alias("fth"), F.col("kept.i").alias("j")).alias("x"))
    each = written(each)  # frees what was shuffled for it
    runs = each.groupBy("d", "th").agg(F.sort_array(F.collect_set("x")).alias("x")).where(F.exists("x", lambda x: x["gone"]))
    runs = written(runs)

    def ends(side: int) -> Column:
        on = lambda y, x: (y["i"] == x["i"] + side) & y["gone"]
        alone = lambda x, k: x["gone"] & ~F.coalesce(on(F.get("x", k + side), x), F.lit(False))
        ahead = lambda x, step: F.struct(x["i"].alias("i"), F.lit(side).alias("side"), F.lit(step).alias("step"), x["f"].alias("f"), x["fth"].alias("fth"), (x["j"] + side * step).alias("j"))
        return F.flatten(F.transform(F.filter("x", alone), lambda x: F.array(ahead(x, 1), ahead(x, 2))))

    edges = runs.select("d", "th", F.explode(F.concat(ends(1), ends(-1))).alias("e")).select("d", "th", "e.*")
    edges = written(edges)
    # only documents of such buckets are shuffled; at most BUCKETS numbers are broadcast
    wanted = F.broadcast(edges.select(F.pmod("fth", F.lit(BUCKETS)).alias("bucket")).distinct())
    beside = places.withColumn("bucket", F.pmod("th", F.lit(BUCKETS))).join(wanted, "bucket", "left_semi")
    beside = beside.select(F.col("d").alias("pd"), F.col("th").alias("fth"), F.col("i").alias("j"), "body")
    beside = edges.join(beside, ["fth", "j"]).where(F.col("f").eqNullSafe(F.col("pd"))).groupBy("d", "th").agg(F.collect_set(F.struct("i", "side", "step", "body")).alias("ends"))
    beside = beside.withColumnsRenamed({"d": "bd", "th": "bth"})
    lost = F.transform(F.filter("x", lambda x: x["gone"]), lambda x: x["i"])
    return runs.select("d", "th", lost.alias("lost")).join(beside, F.col("d").eqNullSafe(F.col("bd")) & (F.col("th") == F.col("bth")), "left").select("d", "th", "lost", "ends")


def _alike(own: list[re.Match], other: list[bytes]) -> int:
    """How many words both begin with."""
    n = 0
    while n < min(len(own), len(other)) and own[n].group() == other[n]:
        n += 1
    return n


def _cleaned_batch(batch: pa.RecordBatch, where: int, lost: pa.Array, ends: pa.Array, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """New texts, chunks removed whole, and whether a text lost all that it had."""
    column = batch.column(where)
    raw, at = text_buffer(column)
    c = chunks(raw, at)
    n = batch.num_rows
    gone = np.zeros(n, np.int64)
    texts = column.to_pylist()
    first = np.searchsorted(c.row, np.arange(n + 1))
    out, empty = [], np.zeros(n, bool)
    for r in range(n):
        a, b = first[r], first[r + 1]
        numbers = lost[r].as_py() if lost[r].is_valid else None
        if not numbers or texts[r] is None:
            out.append(texts[r])
            continue
        flag = np.zeros(b - a + 2, bool)
        flag[np.array(numbers) + 1] = True
        edge = np.flatnonzero(flag[1:] != flag[:-1])  # runs are [edge 0, edge 1), [edge 2, edge 3), ...
        beside = {(e["i"], e["side"], e["step"]): e["body"] for e in ends[r].as_py() or ()}
        inside = lambda lo, hi: list(_WORD.finditer(raw[c.start[lo] : c.end[hi - 1]].tobytes()))  # noqa: B023, E731
        parts, done = [], at[r]
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            words, begin, to = c.words[a + lo : a + hi].sum(), c.start[a + lo], c.after[a + hi - 1]
            low = lo - 2 if lo > 1 and not flag[lo - 1] else lo - 1  # flag[k + 1] is chunk k's
            if lo and (lo, -1, 1) in beside:
                own = inside(a + low, a + lo)[::-1]
                k = _alike(own, (beside.get((lo, -1, 2), b"").split() + beside[lo, -1, 1].split())[::-1])
                if k:
                    words, begin = words + k, c.start[a + low] + own[k - 1].start()
            high = hi + 2 if a + hi + 1 < b and not flag[hi + 2] else hi + 1
            if a + hi < b and (hi - 1, 1, 1) in beside:
                own = inside(a + hi, a + high)
                k = _alike(own, beside[hi - 1, 1, 1].split() + beside.get((hi - 1, 1, 2), b"").split())
                if k:
                    words, to = words + k, c.after[a + high - 1] if k == len(own) else c.start[a + hi] + own[k].start()
            if words >= least:
                parts.append(raw[done : max(begin, done)])
                done = to
                gone[r] += hi - lo
        parts.append(raw[done : at[r + 1]])
        new = b"".join(x.tobytes() for x in parts).decode() if gone[r] else texts[r]
        empty[r] = gone[r] > 0 and not new.strip()
        out.append("" if empty[r] else new)
    return pa.array(out, column.type), pa.array(gone), pa.array(empty)


def _cut(docs: DataFrame, id: str, text: str, least: int) -> tuple[DataFrame, str, str]:
    """`docs` with their cleaned text and two more columns, n_removed and emptied, under names that `docs` doesn't have."""
    names = docs.columns
    removed, emptied, d, h, lost_, ends_, th, bucket_ = (unused(names, x) for x in ("n_removed", "emptied", "d", "h", "lost", "ends", "th", "bucket"))
    lost = written(removals(docs, id, text)).withColumnsRenamed({"d": d, "th": h, "lost": lost_, "ends": ends_})
    # documents of no such bucket lose nothing and are not shuffled; at most BUCKETS numbers are broadcast
    bucket = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS))
    some = F.broadcast(lost.select(bucket(F.col(d), F.col(h)).alias(bucket_)).distinct())
    own = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    own = own.withColumn(bucket_, bucket(F.col(id), F.col(th)))
    kept = [F.col(f"`{c}`") for c in names]
    schema = StructType([*docs.schema.fields, StructField(removed, LongType()), StructField(emptied, BooleanType())])
    where, key = names.index(text), len(names)

    def cut(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            new, *more = _cleaned_batch(batch, where, batch.column(key), batch.column(key + 1), least)
            yield pa.RecordBatch.from_arrays([*(new if i == where else batch.column(i) for i in range(key)), *more], names=[*names, removed, emptied])

    rest = own.join(some, bucket_, "left_anti").select(*kept, F.lit(0).cast("bigint").alias(removed), F.lit(False).alias(emptied))
    own = own.join(some, bucket_, "left_semi")
    joined = own.join(lost, own[id].eqNullSafe(lost[d]) & (own[th] == lost[h]), "left").select(*kept, lost_, ends_)
    return rest.unionByName(joined.mapInArrow(cut, schema)), removed, emptied


def cleaned(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """`docs` with their cleaned text, n_removed (chunks removed whole), and emptied (it had chunks and has none left).

    Where `docs` has a column of such a name, it stays, and the new one has underscores behind its name.
    """
    return _cut(docs, id, text, least)[0]


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with their cleaned texts; a document of which nothing is left goes."""
    out, _, emptied = _cut(docs, id, text, LEAST)
    return out.where(~F.col(emptied)).select([F.col(f"`{c}`") for c in docs.columns])
