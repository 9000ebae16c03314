"""Spans of lines and the lines within them, met block by block, so that no file is one group of a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block: as many as a long has bits.
BLOCK = 64


def block_of(line: Column) -> Column:
    return F.floor(line / BLOCK).cast("bigint")


def by_block(spans: DataFrame) -> DataFrame:
    """`spans` (start_line, end_line, …) with a row for every `block` that they reach into."""
    some = spans.where(F.col("start_line") <= F.col("end_line"))
    return some.withColumn("block", F.explode(F.sequence(block_of(F.col("start_line")), block_of(F.col("end_line")))))


def outside(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (path, line, …) that stand in none of the spans (path, start_line, end_line): a bit tells each line of a block.

    Exploded rows are far more than their source, by which Spark would judge them fit to be broadcast; hence the hint.
    """
    low = F.greatest(F.col("start_line") - F.col("block") * BLOCK, F.lit(0)).cast("int")
    high = F.least(F.col("end_line") - F.col("block") * BLOCK, F.lit(BLOCK - 1)).cast("int")
    each = by_block(spans.select("path", "start_line", "end_line")).select("path", "block", low.alias("low"), high.alias("high"))
    bits = each.groupBy("path", "block").agg(F.bit_or(F.expr(f"shiftleft(-1L, low) & shiftrightunsigned(-1L, {BLOCK - 1} - high)")).alias("__held"))
    at = lines.withColumn("block", block_of(F.col("line"))).hint("merge").join(bits, ["path", "block"], "left")
    held = F.expr(f"shiftrightunsigned(__held, cast(line - block * {BLOCK} as int)) & 1L")
    return at.where(F.coalesce(held, F.lit(0)) == 0).select(*lines.columns)


def inside(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """`spans` (path, start_line, end_line, …) with `own`, their lines of a block as structs (line, text) in order: a row a span and block that has some.

    Lines (path, line, text) are shuffled once, by block, and leave as arrays.
    """
    packed = lines.groupBy("path", block_of(F.col("line")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("__lines"))  # a block's
    own = F.filter("__lines", lambda x: x["line"].between(F.col("start_line"), F.col("end_line")))
    met = packed.hint("merge").join(by_block(spans), ["path", "block"])
    return met.withColumn("own", own).where(F.size("own") > 0).select(*spans.columns, "own")
