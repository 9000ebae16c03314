"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Null texts encode like empty ones: no ids, and no bytes when decoded. Row order, repeated rows and
further columns play no part. Where there is a column of a name that is added, it stays, and the new one
has underscores behind its name. Long texts are
cut where the pre-splitting pattern starts a new match whatever stands around, so that a worker
doesn't hold the pieces of a whole long text; what stays whole is a run of letters, of digits or of marks,
which the pattern takes as one match (or a few) itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from graphloom.llm.common import batches, tune, unused

#: Characters after which a long text is cut at the next safe boundary.
PIECE = 1 << 16
#: Fixed value: the pre-splitting pattern whose matches are known to end where SAFE says.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Places where that pattern's match before ends and the next one starts, whatever stands around: white space after
#: something else, a letter before a digit or mark, a digit before a letter or mark. No match goes from one to the
#: other there, and no look-ahead from before reaches beyond.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z\u4e00-\u9fff])(?=[0-9!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])")
_encodings: dict[bytes, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """Built once in a worker process."""
    key = hashlib.sha256(ranks + b"\0" + pattern.encode()).digest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE, pattern: str = SPLIT) -> Iterator[str]:
    """The text in parts of about `size` characters that encode independently; whole under a pattern other than SPLIT."""
    at = 0
    while pattern == SPLIT and len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), np.uint32)
    return np.concatenate([np.array(enc.encode_ordinary(p), np.uint32) for p in pieces(text, size, enc._pat_str)])


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids array<int> and n_tokens long."""
    tune(docs.sparkSession)
    ids_, n_ = unused(docs.columns, "token_ids"), unused(docs.columns, "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # about 1 MB, the size of the vocabulary

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches(data):
            ids = [encode_text(enc, t.as_py()) for t in batch.column(text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(np.diff(offsets).astype(np.int64))],
                names=[*batch.schema.names, ids_, n_],
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(ids_, ArrayType(IntegerType())), StructField(n_, LongType())]))


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids") -> DataFrame:
    """`encoded` with the raw bytes of its ids (decoded binary); null ids decode to no bytes."""
    tune(encoded.sparkSession)
    decoded = unused(encoded.columns, "decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches(data):
            raw = [enc.decode_bytes(x.as_py() or []) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(decoded, BinaryType())]))


def digests(docs: DataFrame, ranks: bytes, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each input row.

    Ids and decoded bytes live only within a batch, so nothing but the digests leaves a worker.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches(data):
            counts, of_ids, of_bytes = [], [], []
            for t in batch.column(1):
                ids = encode_text(enc, t.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
