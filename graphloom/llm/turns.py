"""Conversation structure repair: cheapest edits that turn rows into system? (user assistant)+, by a DP that a trie of signatures shares.

A conversation's signature has a letter a row: the row's role (s, u, a, or another) with its first fault (blank, duplicate,
truncated, or none). Sorted signatures are a trie walked depth first: what a signature shares with the one before is a
path from the root, whose layers of the DP stay on a stack; only letters beyond it are computed, once for all that share them.

Edits: keep 0; rerole to user or assistant 2; delete 3, which blank and duplicate rows need; insert an empty user or
assistant row 2; a truncated row that isn't deleted adds 1. Of cheapest edits, those whose initials (D, I, K, R) come first.

How it runs. Rows are found to be repeats by windows over a conversation's equal rows, dealt by role and text, then
sorted over ranges of (conversation, turn, role, text's digest), so that a conversation may span many tasks; each task makes one piece of
a signature, and pieces are joined: a byte a row. Signatures are sorted over ranges of (signature, conversation), so that many
equal ones are split too. Edits go back to the texts in front of their conversation's rows in one sorted stream: a
conversation's texts pass one task there, as a stream that holds a batch, for their order is what the repaired text is.

Defined cases: rows of a conversation stand by turn (nulls first), those of one turn by role, then by the text's SHA-256. A null in
role or text is one space, hence such a role fits none and such a text is blank; conversations without an id are one. Turns may repeat or lack; a gap is
counted between the least and the greatest. Empty and white texts are blank. Long texts are judged whole. A conversation without rows has no edits. Roles
go by their first letter, as it is. Further columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.common import tune

#: Letters of signatures: roles by faults. Their order has no meaning beyond sorting.
ROLES, FAULTS = "sua?", ("ok", "truncated", "duplicate", "blank")
LETTERS = {(r, f): chr(97 + 4 * i + k) for i, r in enumerate(ROLES) for k, f in enumerate(FAULTS)}
_MEANING = {letter: pair for pair, letter in LETTERS.items()}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: States after some rows: nothing yet, a system row, a user row, an assistant row; and where the next row of a role leads.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
_FAR = 1 << 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn`, modulo 20; `copies` is 0 for rows that are dropped, 2 for repeated ones."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text, role = as_text("text"), as_text("role")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table as it is, for `signatures` and `repaired`."""
    return rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pieces(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, letter, copies) to one piece a conversation: its letters, first and last turn, turns."""
    out: list[list] = []
    held = 0
    current: list | None = None
    for batch in data:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        for conv, turn, letter, copies in zip(*columns, strict=True):
            if current is None or current[0] != conv:
                if current is not None:
                    out.append(current)
                    held += len(current[1])
                    if held > 1 << 20 or len(out) > 1 << 14:
                        yield _piece_batch(out, batch.schema.field(0).type)
                        out, held = [], 0
                current = [conv, [], None, None, 0]
            if copies:
                current[1].append(letter)
                if turn is not None and turn != current[3]:
                    current[2] = turn if current[2] is None else current[2]
                    current[3], current[4] = turn, current[4] + 1
    if current is not None:
        yield _piece_batch([*out, current], batch.schema.field(0).type)


def _piece_batch(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    conv, letters, first, last, turns = zip(*rows, strict=True)
    columns = [pa.array(conv, id_type), pa.array(["".join(x) for x in letters]), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(turns, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "letters", "first", "last", "turns"])


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and gaps of every conversation of `rows` (as `damaged` gives them)."""
    tune(rows.sparkSession)
    ink = F.rtrim("text", F.lit("\t\n\x0b\f\r "))
    end = F.substr(ink, F.length(ink), F.lit(1))
    initial = F.substr("role", F.lit(1), F.lit(1))
    r = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", _digest(F.col("text")).alias("digest"), "copies", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("as_role"), (ink == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
    same = Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))
    # a repeated row's second copy is one more letter, always a repeat; of a dropped row none is left
    r = r.withColumn("seen", F.row_number().over(same) > 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    r = r.withColumn("again", F.col("seen") | (F.col("copy") > 1))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen") | (F.col("copy") > 1), "duplicate").when(F.col("truncated"), "truncated").otherwise("ok")
    letter = F.element_at(F.create_map(*(F.lit(x) for (a, b), c in LETTERS.items() for x in (a + b, c))), F.concat("as_role", fault))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "again"]
    sorted_rows = r.select("conv_id", "turn", "role", "digest", "again", letter.alias("letter"), "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    pieces = sorted_rows.select("conv_id", "turn", "letter", "copies").withColumn("part", F.spark_partition_id()).mapInArrow(_placed, f"conv_id {id_type}, part int, letters string, first bigint, last bigint, turns bigint")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "letters", "first", "last", "turns"))).alias("p"))
    known = F.filter("p", lambda x: x["turns"] > 0)  # pieces that have turns; one turn may stand in several
    # turns ascend, so the first known piece has the least and the last the greatest
    shared = F.aggregate(F.sequence(F.lit(1), F.size(known) - 1, F.lit(1)), F.lit(0).cast("bigint"), lambda n, i: n + F.when(F.get(known, i)["first"] == F.get(known, i - 1)["last"], 1).otherwise(0))
    distinct = F.aggregate(known, F.lit(0).cast("bigint"), lambda n, x: n + x["turns"]) - F.when(F.size(known) > 1, shared).otherwise(0)
    gaps = F.when(F.size(known) == 0, F.lit(0)).otherwise(F.get(known, F.size(known) - 1)["last"] - F.get(known, F.lit(0))["first"] + 1 - distinct)
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("signature"), gaps.cast("bigint").alias("gaps"))


def _placed(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_pieces` of a partition, with its number."""
    part = 0

    def narrow() -> Iterator[pa.RecordBatch]:
        nonlocal part
        for batch in data:
            if batch.num_rows:
                part = batch.column(4)[0].as_py()
                yield batch

    for out in _pieces(narrow()):
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array([part] * out.num_rows, pa.int32()), *out.columns[1:]], names=["conv_id", "part", *out.schema.names[1:]])


Layer = tuple[int, int, int, int]
#: A layer of the DP: by how much the least cost has grown since the layer before, and costs by state above that least one. There are
#: few such pairs, so each is made once and a layer on the stack is a reference.
Step = tuple[int, Layer]


def _with_inserts(f: list[int]) -> Step:
    f[2] = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    f[3] = min(f[3], f[2] + INSERT)
    least = min(f)
    return least, tuple(min(x - least, _FAR) for x in f)


_FIRST = _with_inserts([0, _FAR, _FAR, _FAR])


def _wanted(state: int) -> tuple[str, int]:
    """The role that a row of any role may be given or that is inserted in a state, and the state after it."""
    return ("a", 3) if state == 2 else ("u", 2)


def _moves(letter: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state, by their initials' order: initial, cost, next state."""
    role, fault = _MEANING[letter]
    yield "D", DELETE, state
    if fault in ("ok", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        if role in _NEXT[state]:
            yield "K", more, _NEXT[state][role]
        yield "R", REROLE + more, _wanted(state)[1]


_STEPS = {letter: [(s, t, c) for s in range(4) for _, c, t in _moves(letter, s)] for letter in _MEANING}


@cache
def advance(layer: Layer, letter: str) -> Step:
    """Costs by state after one more row."""
    f = [_FAR] * 4
    for s, t, c in _STEPS[letter]:
        f[t] = min(f[t], layer[s] + c)
    return _with_inserts(f)


@cache
def _before(here: Layer, letter: str, after: Step, marked: int) -> int:
    """States (as bits) from which a row's edit leads to one that is marked, at least cost."""
    more, costs = after
    return sum({1 << s for s, t, c in _STEPS[letter] if marked >> t & 1 and here[s] + c == more + costs[t]})


@cache
def _with_inserted(here: Layer, marked: int) -> int:
    """`marked` and the states from which inserts lead there: over a user row to an assistant row, at most."""
    for _ in range(2):
        for s in range(4):
            to = _wanted(s)[1]
            if marked >> to & 1 and here[s] + INSERT == here[to]:
                marked |= 1 << s
    return marked


def edits(signature: str, layers: list[Step]) -> tuple[int, str]:
    """The least cost and the first of the cheapest edits' initials, from a path of layers (one more than letters).

    States on a cheapest path are marked from the end; from the start, the least initial that leads to a marked one is taken.
    A state and place are reached by one text of initials alone, as initials tell the roles.
    """
    n = len(signature)
    last = layers[n][1]
    least = min(last[s] for s in _ENDS)
    marked = bytearray(n + 1)
    marked[n] = _with_inserted(last, sum(1 << s for s in _ENDS if last[s] == least))
    for i in range(n - 1, -1, -1):
        marked[i] = _with_inserted(layers[i][1], _before(layers[i][1], signature[i], layers[i + 1], marked[i + 1]))
    out: list[str] = []
    i, s = 0, 0
    while True:
        here, to = layers[i][1], _wanted(s)[1]
        found = [(x, i + 1, t) for x, c, t in _moves(signature[i], s) if marked[i + 1] >> t & 1 and here[s] + c == layers[i + 1][0] + layers[i + 1][1][t]] if i < n else []
        if marked[i] >> to & 1 and here[s] + INSERT == here[to]:
            found.append(("I", i, to))
        if not found:
            return sum(x for x, _ in layers) + least, "".join(out)
        initial, i, s = min(found)
        out.append(initial)


def tallies(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles may not follow each other."""
    faults = [sum(signature.count(LETTERS[r, f]) for r in ROLES) for f in ("blank", "duplicate", "truncated")]
    roles = [_MEANING[x][0] for x in signature]
    return *faults, sum(a + b not in LEGAL for a, b in pairwise(roles))


def walk(ordered: Iterable[str]) -> Iterator[tuple[int, int, int, int, int, str]]:
    """For each of sorted signatures: blank, duplicate, truncated, illegal, cost, audit. Layers of what it shares with the one before are kept."""
    before, layers, answer = "", [_FIRST], None
    for signature in ordered:
        if answer is None or signature != before:
            shared = 0
            for a, b in zip(before, signature, strict=False):
                if a != b:
                    break
                shared += 1
            del layers[shared + 1 :]
            for letter in signature[shared:]:
                layers.append(advance(layers[-1][1], letter))
            before, answer = signature, (*tallies(signature), *edits(signature, layers))
        yield answer


AUDIT = "signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _walked(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch: pa.RecordBatch | None = None

    def each() -> Iterator[str]:
        """Signatures of all batches; `batch` is the one that the last came from."""
        nonlocal batch
        for b in data:
            if b.num_rows:
                batch = b
                yield from b.column(1).to_pylist()

    answers: list[tuple] = []
    for answer in walk(each()):
        answers.append(answer)
        if len(answers) == batch.num_rows:
            columns = [pa.array(x, pa.int64()) for x in list(zip(*answers, strict=True))[:5]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([a[5] for a in answers])], names=[*batch.schema.names, "blank", "duplicate", "truncated", "illegal", "cost", "audit"])
            answers = []


def audit(signed: DataFrame) -> DataFrame:
    """`signed` (of `signatures`) with counts of faults, the least cost and its edits' initials."""
    tune(signed.sparkSession)
    ordered = signed.select("conv_id", "signature", "gaps").repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return ordered.mapInArrow(_walked, f"conv_id {signed.schema['conv_id'].dataType.simpleString()}, {AUDIT}")


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in order, in one partition each."""
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *_HEAD, F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    body = rows.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies")))
    body = body.select("conv_id", F.lit(1).alias("kind"), *(F.lit(None).cast("bigint").alias(c) for c in _HEAD), F.col("turn").cast("bigint").alias("turn"), "role", "text", _digest(F.col("text")).alias("digest"))
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")
    return both.drop("digest")


def _edited(data: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("head", conv_id, the audit's row), then ("row", conv_id, turn, role, text, edit) of what is left, a conversation after the other."""
    initials, place, state, conv = "", 0, 0, None

    def inserts() -> Iterator[tuple]:
        nonlocal place, state
        while place < len(initials) and initials[place] == "I":
            role, state = _wanted(state)
            place += 1
            yield "row", conv, None, {"u": "user", "a": "assistant"}[role], "", "I"

    for batch in data:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                yield from inserts()  # behind the last row of the one before
                initials, place, state, conv = row["text"], 0, 0, row["conv_id"]
                yield "head", conv, row
                continue
            yield from inserts()
            edit, role = initials[place], row["role"]
            place += 1
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            state = _NEXT[state][role[:1]]
            yield "row", conv, row["turn"], role, row["text"], edit
    yield from inserts()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows that the edits leave: conv_id, place (from 1), turn (null if inserted), role, text, edit (K, R or I)."""
    tune(rows.sparkSession)
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held, place = 0, 0
        for item in _edited(data):
            if item[0] == "head":
                place = 0
                continue
            place += 1
            out.append({"conv_id": item[1], "place": place, "turn": item[2], "role": item[3], "text": item[4], "edit": item[5]})
            held += len(item[4])
            if len(out) >= 1024 or held > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = f"conv_id {id_type}, place bigint, turn bigint, role string, text string, edit string"
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return _stream(rows, audits).mapInArrow(run, kinds)


def report(rows: DataFrame) -> DataFrame:
    """A row a conversation of `rows` (as `damaged` gives them): faults, cost, audit, and the SHA-256 of the repaired rows, `role:text` a line."""
    tune(rows.sparkSession)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", *_HEAD, "audit", "repaired_sha256"]

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        current, sha, lines = None, None, 0

        def close() -> None:
            out.append({**{c: current[c] for c in ("conv_id", *_HEAD)}, "audit": current["text"], "repaired_sha256": sha.hexdigest()})

        for item in _edited(data):
            if item[0] == "head":
                if current is not None:
                    close()
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                current, sha, lines = item[2], hashlib.sha256(), 0
                continue
            sha.update((("\n" if lines else "") + f"{item[3]}:{item[4]}").encode())
            lines += 1
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = f"conv_id {id_type}, " + ", ".join(f"{c} bigint" for c in _HEAD) + ", audit string, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    return _stream(rows, audit(signatures(rows))).mapInArrow(run, kinds).select(*columns)
