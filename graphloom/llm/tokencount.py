"""Token counts of whole texts by a sentencepiece BPE model; huge texts are encoded in overlapping chunks and spliced.

Why a splice is right. BPE merges the best pair first and, of equal ones, the leftmost. Restricted to a run of tokens
that no merge crosses, this is the order of merges in the run alone. So any run of neighbours in an encoding is what
its own text encodes to, and a sequence in which every two neighbours are neighbours in some encoding is the encoding
of what it spells. Where two chunks share a token, with the same start and end, the first's tokens up to it and the
second's after it are such a sequence: the text's own encoding. A chunk begins at a token's start of the one
before, so that even one letter repeated falls into step. Where no token is shared, the overlap is doubled; when it would be
half a chunk, the text begins anew with chunks twice as long, in the end as one.

That holds for models without a normaliser, user-defined or unused pieces, with byte fallback; texts are encoded whole under others.

Defined cases: a null text counts like an empty one, no bytes and no tokens. Equal texts have equal counts; repeated rows stay.
Rows without an id stay. Special strings such as `</s>` inside texts are ordinary text, the library's default. Further columns stay; where one has
a name that is added, the new one has underscores behind its name. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from graphloom.llm.common import batches, tune, unused

#: Characters of a chunk, and by which the next one overlaps it at first.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: Tokens that a document may have before it is over the limit.
LIMIT = 4096
_encoders: dict[bytes, Encoder] = {}


def model_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def spliceable(model: bytes) -> bool:
    """Whether chunks of a text may be spliced: the conditions of the module's proof."""
    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    kinds = {p.type for p in spec.pieces}
    piece = sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.escape_whitespaces
    return plain and spec.trainer_spec.model_type == 2 and not spec.trainer_spec.treat_whitespace_as_suffix and piece.BYTE in kinds and not kinds & {piece.USER_DEFINED, piece.UNUSED}


class Encoder:
    """A model, and the same without the space that it puts before a text, for chunks that don't begin one."""

    def __init__(self, model: bytes) -> None:
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spliceable = spliceable(model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.prefix = int(spec.normalizer_spec.add_dummy_prefix)
        spec.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.chars = np.array([self._chars(i) for i in range(self.whole.get_piece_size())], np.int64)

    def _chars(self, i: int) -> int:
        """Characters that a token spells; of a character's byte tokens, the first one counts."""
        if self.whole.is_control(i) or self.whole.is_unknown(i):
            return 0
        piece = self.whole.id_to_piece(i)
        if self.whole.is_byte(i):
            return int(not 0x80 <= int(piece[3:5], 16) < 0xC0)
        return len(piece)

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:end] and where each ends in the text."""
        ids = np.array((self.inner if start else self.whole).encode(text[start:end]), np.int32)
        return ids, start + np.cumsum(self.chars[ids]) - (0 if start else self.prefix)

    def parts(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray] | None:
        """Ids of the text in parts whose sequence is the text's encoding; None where some overlap shares no token."""
        out: list[int] = []
        ids, ends = self._chunk(text, 0, size)
        first, end = 0, size  # the first of this chunk's tokens that aren't in a part yet
        while end < len(text):
            wide = overlap
            while True:
                if 2 * wide > size:
                    return None
                at = max(int(np.searchsorted(ends, end - wide)), first)  # a token's end, where the next one starts
                begin = int(ends[at]) if at < len(ends) else end
                more, more_ends = self._chunk(text, begin, min(len(text), begin + size)) if begin < end else (ids[:0], ends[:0])
                shared = self._shared(ends[at:], more_ends, begin, end)
                if shared:
                    break
                wide *= 2
            mine, others = shared
            out.append(ids[first : at + mine + 1])
            ids, ends, first, end = more, more_ends, others + 1, min(len(text), begin + size)
        return iter([*out, ids[first:]])

    @staticmethod
    def _shared(ends: np.ndarray, more: np.ndarray, begin: int, end: int) -> tuple[int, int] | None:
        """Places of the last token that both have, with its start and its end; `ends` starts with the end of the token before `begin`."""
        a, b = ends[1:], more[: np.searchsorted(more, end, side="right")]
        a_start, b_start = ends[:-1], np.concatenate([[begin], b[:-1]]) if len(b) else b
        key_a, key_b = np.where(a > a_start, a * 2 ** 20 + (a - a_start), -1), np.where(b > b_start, b * 2 ** 20 + (b - b_start), -2)
        _, i, j = np.intersect1d(key_a, key_b, return_indices=True)
        return (int(i.max()) + 1, int(j.max())) if len(i) else None

    def ids(self, text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
        """The text's ids, in parts where it is longer than a chunk."""
        if not text:
            return
        while self.spliceable and len(text) > size:
            found = self.parts(text, size, overlap)
            if found is not None:
                yield from found
                return
            size, overlap = size * 2, overlap * 2
        yield np.array(self.whole.encode(text), np.int32)

    def count(self, text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> int:
        return sum(map(len, self.ids(text, size, overlap)))


def encoder(model: bytes) -> Encoder:
    """Built once in a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def count(docs: DataFrame, model: bytes, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """`docs` with n_bytes and n_tokens long and over_limit boolean, in one pass without a shuffle."""
    tune(docs.sparkSession)
    names = [unused(docs.columns, n) for n in ("n_bytes", "n_tokens", "over_limit")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a MB, the size of the vocabulary

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches(data):
            column = batch.column(text)
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            n = pa.array([enc.count(t.as_py()) for t in column], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, n, pc.greater(n, limit)], names=[*batch.schema.names, *names])

    kinds = (LongType(), LongType(), BooleanType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *map(StructField, names, kinds)]))
