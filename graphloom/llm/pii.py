"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

All of it is built-in expressions over one row, so there is no shuffle. Offsets are code points, the
end exclusive. Patterns hold possessive repeats and look back where a search could otherwise begin
again within a run it has already seen, so time grows with a text's length and no repeat recurses; offsets
and what stands near a span are found in pieces, so time grows little faster than the number of spans.

Kinds email, ip, card and phone are the base; iban is added where its mod-97 check holds. A span's
score is 0.6 (0.9 for what a checksum confirms) and 0.1 or 0.3 less or more by the words near it, at
most 1; no span is dropped for its score.

Defined cases: a null text is empty and has no spans; every row is judged alone, so repeated rows,
an empty table and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: The whole run of digits with single separators, where it has 14 to 19.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,4}+)?+)(?![A-Za-z0-9])"
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

#: Words that speak for a kind, and code points looked at on either side.
NEAR = {
    "email": "mail|contact|write|address|correo|courriel",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|credit|payment|master|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
}
AGAINST = "version|serial|order|invoice|isbn|issue|example"
WINDOW = 40
#: Code points of a piece of a text, and values that are added up in one go.
PIECE, SOME = 256, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Doubles every second digit from the right; digits of what results must sum to a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064: with the first four characters last and letters as 10 to 35, the remainder by 97 is 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def phone_length(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


#: kind, pattern, what a text must contain to be searched, check of a match, whether that is a checksum.
KINDS: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column] | None, bool]] = [
    ("email", EMAIL, lambda t: F.contains(t, F.lit("@")), None, False),
    ("ip", IP, lambda t: F.contains(t, F.lit(".")), lambda v: v.rlike(PART), False),
    ("card", CARD, lambda t: t.isNotNull(), luhn, True),
    ("phone", PHONE, lambda t: F.contains(t, F.lit("+")), phone_length, False),
    ("iban", IBAN, lambda t: t.isNotNull(), mod97, True),
]
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, which is computed once, though `body` names it within functions over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one add up to; an append copies an array, so arrays of up to SOME values are made and joined."""

    def one(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def whole(z: Column) -> Column:
        last = F.floor((F.size(z) - 1) / SOME).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(z, k * SOME + 1, F.lit(SOME)))
        sums = F.transform(parts, lambda part: F.aggregate(part, zero, add))
        return F.flatten(F.zip_with(parts, one(sums, zero), one))

    return _let(values, whole)


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that what stands at an offset is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _at(pieces: Column, start: Column, end: Column) -> Column:
    first = F.floor(start / PIECE).cast("int")
    return F.substr(F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), ""), start % PIECE + 1, end - start)


def _near(words: str) -> str:
    return rf"(?:^|[^a-z0-9_])(?:{words})(?:[^a-z0-9_]|\z)"


def _found(text: Column, k: int) -> Column:
    """Spans of the k-th kind: the parts between matches and the matches give the offsets."""
    kind, pattern, may, check, proven = KINDS[k]
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda part, hit: F.struct(F.length(part).alias("gap"), F.length(hit).alias("size"), hit.alias("value")))
    sums = lambda z: _before(F.transform(z, lambda p: p["gap"] + p["size"]), F.lit(0), lambda a, x: a + x)
    spans = _let(pairs, lambda z: F.zip_with(sums(z), z, lambda at, p: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value"))))
    if check:
        spans = F.filter(spans, lambda s: check(s["value"]))

    def scored(s: Column, pieces: Column) -> Column:
        left = _at(pieces, F.greatest(s["start"] - WINDOW, F.lit(0)), s["start"])
        around = F.translate(F.concat(left, F.lit(" "), _at(pieces, s["end"], s["end"] + WINDOW)), UPPER, LOWER)
        tenths = F.lit(9 if proven else 6) + F.when(around.rlike(_near(NEAR[kind])), 3).otherwise(0) - F.when(around.rlike(_near(AGAINST)), 1).otherwise(0)
        return F.struct(s["start"].alias("start"), F.lit(k).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), (F.least(tenths, F.lit(10)) / 10).alias("score"))

    none = F.array().cast(SPAN)
    both = F.struct(spans.alias("spans"), _pieces(text).alias("pieces"))
    return F.when(may(text) & text.rlike(pattern), _let(both, lambda z: F.transform(z["spans"], lambda s: scored(s, z["pieces"]))).cast(SPAN)).otherwise(none)


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, ord, kind, end, value, score)."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_found(t, k) for k in range(len(KINDS)))))


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """`docs` with the spans of a text in the column `into`, which must be a new one."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into}")
    return docs.withColumn(into, spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """`docs` with spans of at least that score replaced by their kind in brackets; those that overlap go together, under the first one's kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(spans(t), lambda s: s["score"] >= least)

    def done(z: Column) -> Column:
        upto = lambda y: _before(F.transform(y, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
        part = lambda end, s: F.when(s["start"] >= end, F.concat(_at(z["pieces"], end, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        rest = _at(z["pieces"], F.coalesce(F.array_max(F.transform(z["found"], lambda s: s["end"])), F.lit(0)), F.length(z["text"]))
        return F.concat(F.array_join(F.zip_with(upto(z["found"]), z["found"], part), ""), rest)

    new = _let(F.struct(found.alias("found"), _pieces(t).alias("pieces"), t.alias("text")), done)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), new))


def digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, a digest of base spans, and all spans with their scores."""
    rows = find(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["ord"] < 4)
    count = lambda k: F.size(F.filter("found", lambda s: s["ord"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(4)),
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
        F.concat_ws(",", F.transform("found", lambda s: F.format_number(s["score"], 1))).alias("scores"),
    )
