"""Language-model scores by online logistic context mixing over hashed-context bit predictors.

A text is a sequence of tokens: its words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end. A token is
told by a chain of bits, each "does this order have it": the two words before, the word before, the text
so far, and the vocabulary. What no order has is spelled, bit by bit of its bytes. Within an order the token has its relative frequency there, so with a_k
the probability of the chain's stop at k, the token has sum(a_k * p_k) + a_spelled * S.

The chain's bits are each predicted by PREDICTORS adaptive probabilities, named by hashed contexts: how
often the order's context has been seen, which orders had the last three tokens, the word before, how
long the longest order has gone on having them, and how well it does in this text. Their log odds
are mixed by weights that a gate selects, the mix is refined by an adaptive map, and the mean of
both is the prediction. All of it learns online, from training texts, in the order of a hash of their ids
and texts: a batch of STEP tokens is predicted before it is learned from, and a bit's target is the
posterior share of its order. A block's first PRIME training tokens are read once before, so that no text
meets an untrained mix. Orders leave out what a training text itself added to the counts.

The spelling model predicts bits of bytes, in a prefix code by how often they stand. Its predictors keep
counts of both bits in slots named by hashes of a context (the last one to four bytes, and all of the word
so far) and the bits of the byte so far; their mix is gated and refined likewise. It learns from the words
that stand once in the training texts, as those are what new words are like. Words that other texts
have more than SPELLED times aren't spelled; their share of S is left unused.

Scale: counts of words, pairs and triples are exact up to their hashes, and grow
with the corpus. Texts are dealt to blocks of about BLOCK bytes; a block sends the sorted hashes of what it has,
cut to so many bits that a chance match has odds of 2^-10, as differences of a few bytes, to partitions by
range of hash, and gets the sums back in the same order. So no vocabulary is held whole by a task
or the driver, and a frequent word is one number a block. Counts of the spelling model are sums: tasks add
theirs in two rounds; slots grow with the words that stand once, up to 2^MOST_BITS for each context.

Total bits are those of the tokens; bits per byte divide them by the bytes of words and one a token.

Defined cases: null and empty texts are one end token; a null id hashes like an empty string; rows
that repeat are scored and counted each; an empty table gives an empty one; without training words
all is spelled by an untrained model (and N is 0); further columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import _BYTE, _power_tables, _splitmix, merged, text_buffer, tune, words, written

#: Contexts of the spelling model, and bits of its slots' numbers, by how many words it learns from.
CONTEXTS = 5
LEAST_BITS, MOST_BITS = 18, 19
#: Bytes of text in a block, and of text whose hashes meet in a partition.
BLOCK, PART = 5 << 20, 4 << 20
#: Words that other texts have more often aren't spelled.
SPELLED = 3
#: Tokens of a batch of the chain, and words of one of the spelling model, over which weights stay.
STEP, WORDS = 8192, 4096
#: Training tokens of a block that are read once before.
PRIME = 1 << 16
RATE = 0.5
BUCKETS = 5
GATES = BUCKETS * BUCKETS
APM = 24
_NODE = (_splitmix(np.arange(256, dtype=np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)
_SALT = [np.uint64(0x100000001B3 * (k + 1)) for k in range(CONTEXTS)]
_F = np.float32


@dataclass
class Code:
    """A prefix code of bytes by Huffman's rule: bits of each byte, and the tree's node before each bit."""

    length: np.ndarray
    bit: np.ndarray  # [depth, byte]
    node: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        heap = [(int(n) * 256 + 1, b, b) for b, n in enumerate(counts)]
        heapq.heapify(heap)
        child: dict[int, tuple[int, int]] = {}
        for made in range(256, 511):
            x, y = heapq.heappop(heap), heapq.heappop(heap)
            child[made] = x[2], y[2]
            heapq.heappush(heap, (x[0] + y[0], made, made))
        paths: dict[int, list[tuple[int, int]]] = {510: []}
        for made in range(510, 255, -1):
            for bit, c in enumerate(child[made]):
                paths[c] = [*paths[made], (made - 256, bit)]
        length = np.array([len(paths[b]) for b in range(256)])
        bit, node = np.zeros((length.max(), 256), np.int64), np.zeros((length.max(), 256), np.int64)
        for b in range(256):
            for d, (n, x) in enumerate(paths[b]):
                node[d, b], bit[d, b] = n, x
        return Code(length, bit, node)


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30), dtype=x.dtype))


@dataclass
class Spelled:
    """Bytes of words, a terminator after each, with the contexts' hashes."""

    byte: np.ndarray
    word: np.ndarray
    contexts: list[np.ndarray]


def spell(raw: np.ndarray, offsets: np.ndarray) -> Spelled:
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(n), lengths + 1)
    start = offsets[:-1] + np.arange(n)
    byte = np.zeros(len(raw) + n, np.uint8)
    place = np.arange(len(raw)) + np.repeat(np.arange(n), lengths)
    byte[place] = raw
    at = np.arange(len(byte)) - start[word]
    mixed, context = [], np.zeros(len(byte), np.uint64)
    for k in range(CONTEXTS - 1):
        last = np.zeros(len(byte), np.uint64)
        last[k + 1 :] = byte[: len(byte) - k - 1]
        last[at <= k] = 0
        context = context + (last << np.uint64(8 * k))
        mixed.append(_splitmix(context + _SALT[k] + (np.minimum(at, k + 1).astype(np.uint64) << np.uint64(40))))
    up, down = _power_tables(len(byte) + 1)
    sums = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(_BYTE[byte] * up[: len(byte)], out=sums[1:])
    mixed.append(_splitmix((sums[:-1] - sums[start[word]]) * down[start[word]] + _SALT[CONTEXTS - 1]))
    return Spelled(byte, word, [(c >> np.uint64(32)).astype(np.uint32) for c in mixed])


def bits_of(s: Spelled, code: Code, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each depth of the code: the bytes that have a bit there, the node before it, the bit, and each predictor's slot."""
    at, byte, contexts = np.arange(len(s.byte)), s.byte, s.contexts
    down = np.uint32(33 - slots.bit_length())
    for d in range(len(code.bit)):
        if d:
            go = np.flatnonzero(code.length[byte] > d)
            if not len(go):
                return
            at, byte, contexts = at[go], byte[go], [c[go] for c in contexts]
        node = code.node[d, byte]
        salt = _NODE[node]
        yield at, node, code.bit[d, byte], [((c ^ salt) * np.uint32(0x9E3779B1) >> down).astype(np.int64) for c in contexts]


def _parts(raw: np.ndarray, offsets: np.ndarray, step: int = WORDS) -> Iterator[tuple[int, int, Spelled]]:
    for at in range(0, len(offsets) - 1, step):
        to = min(at + step, len(offsets) - 1)
        yield at, to, spell(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def count(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, code: Code) -> None:
    """Adds the bits of words to the counts, [order, slot, bit]."""
    for _, _, s in _parts(raw, offsets, 1 << 15):
        found: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]
        for _, _, bit, slots in bits_of(s, code, table.shape[1]):
            for k, slot in enumerate(slots):
                found[k].append(slot * 2 + bit)
        for k in range(CONTEXTS):
            table[k] += np.bincount(np.concatenate(found[k]), minlength=table[k].size).reshape(-1, 2).astype(table.dtype)


@dataclass
class Mixer:
    weights: np.ndarray  # [gate, predictor]
    apm: np.ndarray  # [bits so far, bucket, (ones, all)]

    @staticmethod
    def fresh() -> Mixer:
        return Mixer(np.full((GATES, CONTEXTS + 1), 0.4), np.zeros((256, APM, 2)))


def _gate(seen: list[np.ndarray]) -> np.ndarray:
    return (np.minimum(np.log2(seen[0] + 1).astype(np.int64), 2 * BUCKETS - 1) // 2) * BUCKETS + np.minimum(np.log2(seen[1] + 1).astype(np.int64), 2 * BUCKETS - 1) // 2


def _bucket(mix: np.ndarray) -> np.ndarray:
    return np.clip((mix + _F(8)) * _F(APM / 16), 0, APM - 1).astype(np.int64)


#: The probability in the middle of each bucket.
_MIDDLE = _squash(((np.arange(APM) + 0.5) * (16 / APM) - 8).astype(_F))


def learn(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, code: Code, m: Mixer) -> None:
    """One pass over words, in order: predict from counts without the word's own, then move the gate's weights against the error."""
    for _, _, s in _parts(raw, offsets):
        for _, node, bit, slots in bits_of(s, code, table.shape[1]):
            x, seen = [], []
            for k, slot in enumerate(slots):
                zero, one = table[k, slot, 0].astype(_F), table[k, slot, 1].astype(_F)
                one, zero = np.maximum(one - bit.astype(_F), 0), np.maximum(zero - (1 - bit).astype(_F), 0)
                x.append(np.log((one + _F(0.3)) / (zero + _F(0.3))))
                if k >= CONTEXTS - 2:
                    seen.append(one + zero)
            x.append(np.full(len(bit), 0.3, _F))
            gate = _gate(seen)
            w = m.weights.astype(_F)[gate]
            mix = sum(w[:, k] * x[k] for k in range(CONTEXTS + 1))
            error = bit - _squash(mix)
            cell = node * APM + _bucket(mix)
            m.apm[:, :, 0] += np.bincount(cell, bit, minlength=256 * APM).reshape(256, APM)
            m.apm[:, :, 1] += np.bincount(cell, minlength=256 * APM).reshape(256, APM)
            many = np.maximum(np.bincount(gate, minlength=GATES), 32.0)
            for k in range(CONTEXTS + 1):
                m.weights[:, k] += RATE * np.bincount(gate, error * x[k], minlength=GATES) / many / 4


def log2_spelled(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, code: Code, m: Mixer) -> np.ndarray:
    """log2 of the spelling model's probability of each word."""
    out = np.zeros(len(offsets) - 1)
    middle = (np.arange(APM) + 0.5) * (16 / APM) - 8
    prior = _squash(middle)[None, :]
    odds = np.log((m.apm[:, :, 0] + 20 * prior) / (m.apm[:, :, 1] - m.apm[:, :, 0] + 20 * (1 - prior))).astype(_F).reshape(-1)
    known = np.log((table[:, :, 1] + _F(0.3)) / (table[:, :, 0] + _F(0.3)), dtype=_F)
    level = [(np.minimum(np.log2(table[k].sum(axis=1).astype(_F) + 1), 2 * BUCKETS - 1).astype(np.uint8) // 2) for k in (CONTEXTS - 2, CONTEXTS - 1)]
    weights = np.ascontiguousarray(m.weights.T.astype(_F))
    for at, to, s in _parts(raw, offsets):
        total = np.zeros(len(s.byte))
        for where, node, bit, slots in bits_of(s, code, table.shape[1]):
            gate = (level[0][slots[-2]] * np.uint8(BUCKETS) + level[1][slots[-1]]).astype(np.int64)
            mix = weights[CONTEXTS][gate] * _F(0.3)
            for k, slot in enumerate(slots):
                mix += weights[k][gate] * known[k][slot]
            refined = (mix + odds[node * APM + _bucket(mix)]) / 2
            total[where] -= np.logaddexp(_F(0), np.where(bit == 1, -refined, refined))
        out[at:to] = np.bincount(s.word, total, minlength=to - at) / np.log(2)
    return out


def _word_buffer(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(batch.column(0))


def _code(vocabulary: DataFrame) -> Code:
    """The code by how often bytes stand in the words."""

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in merged(data):
            raw, at = _word_buffer(batch)
            n += np.bincount(raw, minlength=256)
            n[0] += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n)], names=["byte", "n"])

    counts = np.zeros(256, np.int64)
    for r in vocabulary.mapInArrow(run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    return Code.of(counts)


def _counts(vocabulary: DataFrame, code: Code, slots: int) -> np.ndarray:
    """Slot counts over all the words, by sums of the tasks' tables, first within groups of tasks."""
    slices = 32

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros((CONTEXTS, slots, 2), np.uint32), False
        for batch in merged(data):
            some = True
            count(*_word_buffer(batch), table, code)
        if some:
            for i, part in enumerate(np.split(table.reshape(-1), slices)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["i", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(2 * slots * CONTEXTS // slices, np.uint32)
        for x in t["part"]:
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"i": t["i"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    parts = vocabulary.mapInArrow(run, "i int, part binary").withColumn("task", F.spark_partition_id())
    groups = max(1, int(vocabulary.rdd.getNumPartitions() ** 0.5))
    parts = parts.groupBy("i", F.pmod("task", F.lit(groups)).alias("group")).applyInArrow(lambda t: add(t.select(["i", "part"])), "i int, part binary")
    table = np.zeros(2 * slots * CONTEXTS, np.uint32)
    for r in parts.groupBy("i").applyInArrow(add, "i int, part binary").toLocalIterator():
        size = len(table) // slices
        table[r.i * size : (r.i + 1) * size] = np.frombuffer(r.part, np.uint32)
    return table.reshape(CONTEXTS, slots, 2)


def _mixer(vocabulary: DataFrame, shared, code: Code) -> Mixer:
    """Weights averaged over tasks by their words, and the sum of their adaptive maps."""
    size = GATES * (CONTEXTS + 1)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = Mixer.fresh(), 0
        for batch in merged(data):
            learn(*_word_buffer(batch), shared.value, code, m)
            n += batch.num_rows
        if n:
            flat = np.concatenate([m.weights.reshape(-1) * n, m.apm.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), n), pa.int64())], names=["i", "x", "n"])

    m = Mixer.fresh()
    rows = vocabulary.mapInArrow(run, "i int, x double, n bigint").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()  # GATES * (CONTEXTS + 1) + 512 * APM rows
    if len(rows):
        rows = rows.sort_values("i")
        x, n = rows["x"].to_numpy(), rows["n"].to_numpy()
        m = Mixer((x[:size] / n[:size]).reshape(GATES, CONTEXTS + 1), x[size:].reshape(256, APM, 2))
    return m


#: Orders of the chain, and kinds of keys that are counted: words, pairs, triples.
TRIPLE, PAIR, TEXT, WORD = range(4)
ORDERS, KEYS = 4, 3
PREDICTORS = 5
#: Slots of each predictor of each bit, and gates: how often the context has been seen by which order had the last token.
SLOTS, CHAIN_GATES = 1 << 13, 16 * 7
_START, _END = _splitmix(np.array([1, 2], np.uint64))
_KIND = _splitmix(np.arange(11, 11 + KEYS, dtype=np.uint64))


@dataclass
class Tokens:
    """Tokens of texts, in order; `word` numbers the words of all texts, -1 for ends."""

    row: np.ndarray
    first: np.ndarray  # of each row
    hash: np.ndarray
    word: np.ndarray
    keys: list[np.ndarray]


def tokens(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with the keys of what is counted, and the words' bytes (all bytes, start, end)."""
    n = len(offsets) - 1
    w = words(raw, offsets)
    size = w.per_row(n) + 1
    stop = np.cumsum(size)
    first = stop - size
    h = np.full(stop[-1] if n else 0, _END, np.uint64)
    word = np.full(len(h), -1, np.int64)
    at = np.arange(len(w.hash)) + w.row
    h[at], word[at] = w.hash, np.arange(len(w.hash))
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[first] = two[first] = _START
    second = first[size > 1] + 1
    two[second] = _START
    cut = np.uint64(64 - bits)
    pair = _splitmix(_splitmix(one + _KIND[1]) + h) >> cut
    triple = _splitmix(_splitmix(_splitmix(two + _KIND[2]) + one) + h) >> cut
    return Tokens(row, first, h, word, [h, pair, triple]), w.lower, w.start, w.end


@dataclass
class Distinct:
    """Sorted distinct keys; `of` tells each token's, `own` how often its text has it, `before` how often earlier."""

    keys: np.ndarray
    of: np.ndarray
    own: np.ndarray
    before: np.ndarray
    first: np.ndarray  # a token that has the key


def distinct(keys: np.ndarray, row: np.ndarray) -> Distinct:
    n = len(keys)
    places = np.uint64(max(1, n.bit_length()))
    if n and int(keys.max()).bit_length() + int(places) <= 64:  # sorting numbers is much faster than sorting places by them
        both = keys << places
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << int(places)) - 1)).astype(np.int64)
        k = both >> places
    else:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
    r = row[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    fresh = new.copy()
    fresh[1:] |= r[1:] != r[:-1]
    of, own, before = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    runs = np.flatnonzero(fresh)
    size = np.diff(np.append(runs, n))
    own[order] = np.repeat(size, size)
    before[order] = np.arange(n) - np.repeat(runs, size)
    heads = np.flatnonzero(new)
    return Distinct(k[heads], of, own, before, order[heads])


def _narrow(x: np.ndarray) -> bytes:
    """How many bytes a number takes, and the numbers: first bytes of all, then second ones, so that few large ones cost little once compressed."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    width = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return out.view("<u8").reshape(n), 1 + n * width


_CODEC = pa.Codec("zstd", 1)


def _pack(keys: np.ndarray, counts: np.ndarray, once: list[bytes] | None) -> bytes:
    """Sorted keys, one at least, as differences, counts, and the words that stand once."""
    body = struct.pack("<QQ", len(keys), int(keys[0])) + _narrow(np.diff(keys)) + _narrow(counts)
    if once is not None:
        body += _narrow(np.array([len(x) for x in once], np.uint64)) + b"".join(once)
    return struct.pack("<Q", len(body)) + _CODEC.compress(body, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, memoryview]:
    view = memoryview(_CODEC.decompress(data[8:], struct.unpack("<Q", data[:8])[0], asbytes=True))
    n, first = struct.unpack("<QQ", view[:16])
    steps, used = _wide(view[16:], n - 1)
    view = view[16 + used :]
    counts, used = _wide(view, n)
    return np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(steps, dtype=np.uint64)]), counts.astype(np.int64), view[used:]


def _bounds(kind: int, parts: int, bits: int) -> np.ndarray:
    """The least key of each partition but the first."""
    whole = 1 << (64 if kind == 0 else bits)
    return np.array([whole * p // parts for p in range(1, parts)], np.uint64)


def _sent(rows: DataFrame, parts: int, bits: int) -> DataFrame:
    """block, part, kind, data: the sorted distinct keys of each block, with their counts in training texts."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        raw, at = text_buffer(t["text"])
        known, lower, start, end = tokens(raw, at, bits)
        train = t["training"].to_numpy()[known.row]
        out = []
        for kind, keys in enumerate(known.keys):
            d = distinct(keys, known.row)
            counts = np.bincount(d.of, train, minlength=len(d.keys)).astype(np.uint64)
            edges = [0, *np.searchsorted(d.keys, _bounds(kind, parts, bits)).tolist(), len(d.keys)]
            for p in range(parts):
                lo, hi = edges[p], edges[p + 1]
                if lo < hi:
                    once = None
                    if kind == 0:
                        w = known.word[d.first[lo:hi][counts[lo:hi] == 1]]
                        once = [lower[start[i] : end[i]].tobytes() if i >= 0 else b"" for i in w.tolist()]
                    out.append((p, kind, _pack(d.keys[lo:hi], counts[lo:hi], once)))
        p, k, data = zip(*out, strict=True)
        return pa.table({"block": pa.array(np.full(len(p), t["block"][0].as_py()), pa.int32()), "part": pa.array(p, pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(data, pa.binary())})

    return rows.select("block", "h", "training", "text").groupBy("block").applyInArrow(run, "block int, part int, kind int, data binary")


#: In the place of a block: rows with how many words and tokens there are, and rows with the words that stand once.
TOTALS, ONCE = -1, -2


def _summed(sent: DataFrame) -> DataFrame:
    """block, part, kind, data: the sums of what was sent, in its order; rows of TOTALS and ONCE."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("block", "ascending")])
        kinds, blocks, part = t["kind"].to_numpy(), t["block"].to_pylist(), t["part"][0].as_py()
        out = []
        for kind in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == kind)
            got = [_unpack(t["data"][int(i)].as_py()) for i in mine]
            every = np.concatenate([k for k, _, _ in got])
            order = np.argsort(every, kind="stable")
            new = np.ones(len(every), bool)
            new[1:] = every[order[1:]] != every[order[:-1]]
            of = np.empty(len(every), np.int64)
            of[order] = np.cumsum(new) - 1
            counts = np.concatenate([c for _, c, _ in got])
            total = np.bincount(of, counts).astype(np.int64)
            lo = 0
            for i, (k, _, _) in zip(mine.tolist(), got, strict=True):
                out.append((blocks[i], kind, _narrow(total[of[lo : lo + len(k)]].astype(np.uint64))))
                lo += len(k)
            if kind == 0:
                out.append((TOTALS, kind, struct.pack("<QQ", int((total > 0).sum()), int(total.sum()))))
                alone, lo = [], 0
                for k, c, rest in got:
                    here = np.flatnonzero(c == 1)
                    sizes, used = _wide(rest, len(here))
                    ends = np.cumsum(sizes.astype(np.int64)) + used
                    for j in np.flatnonzero(total[of[lo + here]] == 1).tolist():
                        alone.append(bytes(rest[ends[j] - int(sizes[j]) : ends[j]]))
                    lo += len(k)
                out.append((ONCE, kind, _narrow(np.array([len(x) for x in alone], np.uint64)) + b"".join(alone) + struct.pack("<Q", len(alone))))
        b, k, data = zip(*out, strict=True)
        return pa.table({"block": pa.array(b, pa.int32()), "part": pa.array([part] * len(b), pa.int32()), "kind": pa.array(k, pa.int32()), "data": pa.array(data, pa.binary())})

    return sent.groupBy("part").applyInArrow(run, "block int, part int, kind int, data binary")


def _once(summed: DataFrame) -> DataFrame:
    """word (binary): the words that stand once in training texts; ends aren't among them."""

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in data:
            for x in batch.column(0):
                body = x.as_py()
                n = struct.unpack("<Q", body[-8:])[0]
                sizes, used = _wide(memoryview(body), n)
                at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body[used:-8])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([column.filter(pa.array(sizes > 0))], names=["word"])

    return summed.where(F.col("block") == ONCE).orderBy("part").select("data").mapInArrow(run, "word binary")


@dataclass
class Chain:
    """Adaptive probabilities [bit, predictor, (ones, all), slot], weights [bit, predictor, gate] and maps [bit, (ones, all), run and bucket]."""

    seen: np.ndarray
    weights: np.ndarray
    maps: np.ndarray

    @staticmethod
    def fresh() -> Chain:
        return Chain(np.zeros((ORDERS, PREDICTORS, 2, SLOTS), _F), np.full((ORDERS, PREDICTORS + 1, CHAIN_GATES), 1 / PREDICTORS, _F), np.zeros((ORDERS, 2, 8 * APM), _F))

    def step(self, p: np.ndarray, contexts: list[list[np.ndarray]], gates: list[np.ndarray], runs: np.ndarray, may: np.ndarray, spelled: np.ndarray, learns: np.ndarray) -> np.ndarray:
        """log2 of the probability of each token of a batch; learns from those of `learns` after all are predicted.

        p: the tokens' relative frequencies by order; may: orders whose context has been seen; spelled: log2 of S.
        """
        n = p.shape[1]
        left = np.ones(n)
        kept = []
        shares = np.zeros((ORDERS, n))
        for k in range(ORDERS):
            on = np.flatnonzero(may[k])
            if not len(on):
                kept.append(None)
                continue
            slots = [c[on] for c in contexts[k]]
            gate = gates[k][on]
            x, mix = [], _F(0.3) * self.weights[k, PREDICTORS][gate]
            for i, slot in enumerate(slots):
                ones, every = self.seen[k, i, 0][slot], self.seen[k, i, 1][slot]
                x.append(np.log((ones + _F(0.2)) / (np.maximum(every - ones, _F(0)) + _F(0.2))))
                mix += self.weights[k, i][gate] * x[i]
            bucket = _bucket(mix)
            cell = (runs[on] >> 1) * APM + bucket
            plain = _squash(mix)
            refined = (self.maps[k, 0][cell] + _F(20) * _MIDDLE[bucket]) / (self.maps[k, 1][cell] + _F(20))
            own = np.clip((plain + refined) / 2, 1e-6, 1 - 1e-6).astype(float)
            shares[k, on] = left[on] * own
            left[on] *= 1 - own
            kept.append((on, slots, x, gate, cell, plain))
        shares *= p
        out = np.logaddexp2(np.log2(np.maximum(shares.sum(axis=0), 1e-300)), np.log2(left) + spelled)
        if learns.any():
            shares *= np.exp2(-out)
            reach = np.ones(n)
            for k, made in enumerate(kept):
                if made is not None:
                    on, slots, x, gate, cell, plain = made
                    use = slice(None) if learns.all() else np.flatnonzero(learns[on])
                    on, gate, cell, plain = on[use], gate[use], cell[use], plain[use]
                    weight = reach[on]
                    target = np.minimum(shares[k, on], weight)
                    for i, slot in enumerate(slots):
                        self.seen[k, i, 0] += np.bincount(slot[use], target, minlength=SLOTS)
                        self.seen[k, i, 1] += np.bincount(slot[use], weight, minlength=SLOTS)
                    self.maps[k, 0] += np.bincount(cell, target, minlength=8 * APM)
                    self.maps[k, 1] += np.bincount(cell, weight, minlength=8 * APM)
                    error = target - weight * plain
                    rate = RATE / 4 / np.maximum(np.bincount(gate, weight, minlength=CHAIN_GATES), 32.0)
                    for i in range(PREDICTORS):
                        self.weights[k, i] += rate * np.bincount(gate, error * x[i][use], minlength=CHAIN_GATES)
                    self.weights[k, PREDICTORS] += rate * 0.3 * np.bincount(gate, error, minlength=CHAIN_GATES)
                reach = np.maximum(reach - shares[k], 0)
        return out


def _level(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0).astype(_F) + _F(1)), _F(15)).astype(np.uint8)


def _chained(known: Tokens, p: np.ndarray, n: np.ndarray, spelled: np.ndarray, training: np.ndarray) -> np.ndarray:
    """log2 of each token's probability; p: relative frequencies by order, n: how often their contexts have been seen."""
    size = len(known.row)
    at = np.arange(size) - known.first[known.row]
    hit = np.where((p > 0).any(axis=0), np.argmax(p > 0, axis=0), ORDERS).astype(np.int16)

    def back(k: int) -> np.ndarray:
        out = np.full(size, ORDERS + 1, np.int16)
        out[k:] = np.where(at[k:] >= k, hit[:-k], ORDERS + 1) if size > k else ORDERS + 1
        return out

    last = back(1)
    past = (last * 7 + back(2)) * 7 + back(3)
    long = hit == TRIPLE
    broken = np.maximum.accumulate(np.where(~long | (at == 0), np.arange(size), -1))
    run = np.zeros(size, np.uint8)
    run[1:] = np.minimum(np.arange(size - 1) - broken[:-1], 15)
    run[at == 0] = 0
    sums = np.concatenate([[0], np.cumsum(long)])
    share = (8 * (sums[:-1] - sums[known.first[known.row]]) / np.maximum(at, 1)).astype(np.uint8)
    before = np.full(size, _START, np.uint64)
    before[1:] = known.hash[:-1]
    before[at == 0] = _START
    levels, place = np.stack([_level(n[k]) for k in range(ORDERS)]), _level(at)
    learns = training[known.row]
    out = np.empty(size)
    chain = Chain.fresh()
    slot = lambda x: (_splitmix(x.astype(np.uint64) + np.uint64(77)) >> np.uint64(64 - 13)).astype(np.int64)  # noqa: E731  of 2^13

    def go(part: np.ndarray | slice) -> np.ndarray:
        ls = levels[:, part].astype(np.int64)
        h, r, s, w, of, i = last[part].astype(np.int64), run[part].astype(np.int64), share[part].astype(np.int64), before[part], past[part].astype(np.int64), place[part].astype(np.int64)
        contexts, gates = [], []
        for k in range(ORDERS):
            contexts.append([ls[k] * 16 + ls[min(k + 1, ORDERS - 1)], slot(of * 16 + ls[k]), slot(w + ls[k].astype(np.uint64)), (r * 16 + ls[k]) * 7 + h, (s * 16 + ls[k]) * 16 + i])
            gates.append(ls[k] * 7 + h)
        return chain.step(p[:, part], contexts, gates, r, n[:, part] > 0, spelled[part], learns[part])

    first = np.flatnonzero(learns)[:PRIME]
    for lo in range(0, len(first), STEP):
        go(first[lo : lo + STEP])
    for lo in range(0, size, STEP):
        out[lo : lo + STEP] = go(slice(lo, lo + STEP))
    return out


def _counted(given: pa.Table) -> list[np.ndarray]:
    """Sums of each kind, in the order of a block's sorted distinct keys."""
    given = given.sort_by([("kind", "ascending"), ("part", "ascending")])
    kinds, out = given["kind"].to_numpy(), []
    for kind in range(KEYS):
        each = []
        for i in np.flatnonzero(kinds == kind).tolist():
            data = memoryview(given["data"][i].as_buffer())
            each.append(_wide(data, (len(data) - 1) // data[0])[0])
        out.append(np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64))
    return out


@dataclass
class Frequencies:
    """Relative frequencies [order, token], how often the contexts have been seen, and of the words: counts with and without the token's own text, their number, and a token that is each."""

    p: np.ndarray
    context: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    of: np.ndarray
    first: np.ndarray


def frequencies(known: Tokens, given: list[np.ndarray], training: np.ndarray, n: int) -> Frequencies:
    """`given` has the training texts' counts of each kind's distinct keys, n their tokens; a training text's own are left out."""
    size = len(known.row)
    learns = training[known.row]
    rest = []
    for kind in range(KEYS):
        d = distinct(known.keys[kind], known.row)
        known.keys[kind] = None  # frees it
        every = given[kind][d.of]
        rest.append(np.maximum(every - np.where(learns, d.own, 0), 0))
        if kind == 0:
            total, before, of, first = every, d.before, d.of, d.first
        del d, every
    per = np.bincount(known.row, minlength=len(training))
    context = np.empty((ORDERS, size))
    context[TRIPLE, 1:], context[PAIR, 1:] = rest[1][:-1], rest[0][:-1]
    context[TRIPLE, known.first], context[PAIR, known.first] = 0, rest[0][np.flatnonzero(known.word < 0)]  # as many starts as ends
    context[TEXT], context[WORD] = np.arange(size) - known.first[known.row], n - np.where(learns, per[known.row], 0)
    p = np.stack([rest[2], rest[1], before, rest[0]]) / np.maximum(context, 1)
    p = np.where(context > 0, np.minimum(p, 1), 0)
    return Frequencies(p, context.astype(_F), total, rest[0], of, first)


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes, total_bits, bits_per_byte."""
    spark = docs.sparkSession
    tune(spark)
    training = ~held_out(F.col(id)) if training is None else training
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), training.alias("training"))
    size = rows.agg(F.sum(F.octet_length("text") + 4)).first()[0] or 0
    blocks, parts = max(1, -(-size // BLOCK)), max(1, -(-size // PART))
    bits = min(64, size.bit_length() + 10)
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    summed = written(_summed(_sent(rows, parts, bits)))
    v = n = 0
    for r in summed.where(F.col("block") == TOTALS).select("data").toLocalIterator():  # 16 bytes a partition
        x = struct.unpack("<QQ", r.data)
        v, n = v + x[0], n + x[1]
    once = written(_once(summed))
    code = _code(once)
    slots = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * once.count()).bit_length()))
    table = spark.sparkContext.broadcast(_counts(once, code, slots))  # CONTEXTS * slots * 8 bytes, 20 MB at most
    mixer = _mixer(once, table, code)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("h")
        rows, train = left.num_rows, left["training"].to_numpy()
        raw, at = text_buffer(left["text"])
        known, lower, start, end = tokens(raw, at, bits)
        size = len(known.row)
        learns = train[known.row]
        given = _counted(right)
        f = frequencies(known, _counted(right), train, n)
        per = np.bincount(known.row, minlength=rows)
        base = np.log10((f.total + 0.1) / (n + 0.1 * (v + 1)))
        n_known = np.bincount(known.row, f.total > 0, minlength=rows).astype(np.int64)
        need = np.unique(f.of[f.rest <= SPELLED])
        spelled = np.full(len(f.first), -np.inf)
        if len(need):
            w = known.word[f.first[need]]
            pieces = [lower[start[i] : end[i]].tobytes() if i >= 0 else b"" for i in w.tolist()]
            spelled[need] = log2_spelled(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64), table.value, code, mixer)
        spelled = np.where(f.rest <= SPELLED, spelled[f.of], -np.inf)
        p, context = f.p, f.context
        del f
        bits_ = -np.bincount(known.row, _chained(known, p, context, spelled, train), minlength=rows)
        n_bytes = per + np.bincount(known.row[known.word >= 0], (end - start)[known.word[known.word >= 0]], minlength=rows).astype(np.int64)
        return pa.table(
            {
                "doc_id": left["doc_id"], "held_out": pa.array(~train), "n_tokens": pa.array(per.astype(np.int64)), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(rows, n), pa.int64()),
                "base_score": pa.array(np.bincount(known.row, base, minlength=rows)), "score": pa.array(-bits_ * np.log10(2.0)), "n_bytes": pa.array(n_bytes, pa.int64()), "total_bits": pa.array(bits_), "bits_per_byte": pa.array(bits_ / n_bytes),
            }
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, total_bits double, bits_per_byte double"
    given = summed.where("block >= 0").select("block", "part", "kind", "data")
    return rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(sum_up, schema)
