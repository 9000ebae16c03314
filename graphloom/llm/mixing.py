"""Mixing sources to target weights: tokens per source, repetition rates, and seeded copies of documents.

All of it is DataFrame operations. A source's size is a partial aggregate, so a source with a third
of all rows costs no more than others; one row per source meets in a task, where sources are ordered, and
targets come back to rows without a shuffle, or by parts of sources.

Defined cases: a null text has size 0; the null source is a source like others and comes last; a
source of size 0 has target 0 and rate 0; an empty table mixes to an empty one; rows that repeat
count and are drawn each alike, as the draw depends on doc_id, or on the text where that is null;
further columns, whatever their names, are kept by `mix` and ignored by `rates`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CEILING = 2.0
#: Sources of which a table is broadcast (some 10 MB), and parts of a source beyond that.
FEW, SALTS = 100_000, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target of rows (source, size).

    Sources in order of code points weigh `weights`, repeating, and share `share` times all sizes; no
    target exceeds `ceiling` times its source's size, and what is over goes to the others by weight.
    Resharing until none is above gives the level at which capped sources are those of the lowest
    ratio of ceiling to weight, so one pass in order of that ratio finds it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(every)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.lit(float(ceiling)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the level at the first source that stays under its cap holds for all after it
    under = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("place", F.row_number().over(by_ratio))
    per = per.withColumn("water", F.min_by(F.when(under, F.col("level")), F.when(under, F.col("place"))).over(whole))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def with_targets(rows: DataFrame, source: str, targets: DataFrame, of: str, salt: Column) -> DataFrame:
    """`rows` joined with the targets of their source, which the column `of` names.

    Up to FEW sources are broadcast, so rows aren't shuffled; more are dealt to SALTS parts each, as one may hold a third of all rows.
    """
    targets = checkpointed(targets)
    if targets.count() <= FEW:
        return rows.join(F.broadcast(targets), rows[source].eqNullSafe(targets[of]))
    name = unused([*rows.columns, *targets.columns], "salt")
    dealt = targets.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    salted = rows.withColumn(name, F.pmod(salt, F.lit(SALTS)))
    return salted.join(dealt, salted[source].eqNullSafe(dealt[of]) & (salted[name] == dealt[name])).drop(salted[name]).drop(dealt[name])


def draw(id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone, on the text where there is no id: 52 bits of an MD5."""
    alone = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    hex13 = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id.cast("string"), alone))), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document."""
    sized = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(F.col(id), F.col(text), seed).alias("drawn"))  # no text is shuffled
    targets = source_targets(sized).withColumnRenamed("source", "of")
    joined = with_targets(sized, "source", targets, "of", F.xxhash64("doc_id", "drawn"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (F.col("drawn") < rate - F.floor(rate)).cast("bigint")).cast("bigint")
    out = joined.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """Each document as often as the mix takes it, with the columns of `docs`."""
    of, rate, copy = (unused(docs.columns, n) for n in ("of", "rate", "copy"))
    targets = source_targets(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    targets = targets.select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    joined = with_targets(docs, source, targets, of, F.xxhash64(F.col(id), F.col(text)))
    copies = (F.floor(rate) + (draw(F.col(id), F.col(text), seed) < F.col(rate) - F.floor(rate)).cast("bigint")).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select([F.col(f"`{c}`") for c in docs.columns])
