"""Hashes and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits: where it starts, as two halves, and the low part of its prime, 2^40 + 435.
_HIGH, _LOW, _PRIME = 0xCBF29CE4, 0x84222325, 435
_HALF = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, in hexadecimal without leading zeros.

    A fold over bytes on two halves of 32 bits, so that no product leaves 64 bits.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * _PRIME
        high = h["high"] * _PRIME + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("high"), product.bitwiseAND(F.lit(_HALF)).alias("low"))

    start = F.struct(F.lit(_HIGH).cast("bigint").alias("high"), F.lit(_LOW).cast("bigint").alias("low"))
    h = F.aggregate(bytes_, start, step)
    whole = F.concat(F.lpad(F.lower(F.hex(h["high"])), 8, "0"), F.lpad(F.lower(F.hex(h["low"])), 8, "0"))
    return F.coalesce(F.nullif(F.ltrim(whole, F.lit("0")), F.lit("")), F.lit("0"))


#: Hexadecimal digits of a path's hash that name a node at each level of a listing's tree; the root has none.
LEVELS = (4, 3, 2, 1, 0)


def digest_tree(listing: DataFrame, keys: list[str], path: str, row: Column) -> DataFrame:
    """keys, level, node and digest: a tree of digests over a listing, by `keys` (its root, say).

    A leaf has the rows whose path's hash begins with its name, a node the sixteen below it. Digests are of sorted lists: of a 65,536th of a
    listing in a leaf, of sixteen at most above. Equal listings have equal trees, whatever the order of rows.
    """
    leaf = F.substr(F.sha2(F.col(path), 256), F.lit(1), F.lit(LEVELS[0]))
    level = listing.groupBy(*keys, leaf.alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"))
    out = level = level.select(*keys, F.lit(LEVELS[0]).alias("level"), "node", "digest")
    for n in LEVELS[1:]:
        above = F.substr(F.col("node"), F.lit(1), F.lit(n))
        of = F.array_join(F.sort_array(F.collect_list(F.concat("node", "digest"))), "\n")
        level = level.groupBy(*keys, above.alias("node")).agg(F.sha2(of, 256).alias("digest")).select(*keys, F.lit(n).alias("level"), "node", "digest")
        out = out.unionByName(level)
    return out


def changed_leaves(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and node of leaves that differ between two trees, found from the roots down: of a level, only what is below an unequal node is compared."""
    open_ = None
    for n in reversed(LEVELS):
        a, b = (t.where(F.col("level") == n).select(*keys, "node", F.col("digest").alias(d)) for t, d in ((old, "was"), (new, "now")))
        if open_ is not None:
            up = F.substr(F.col("node"), F.lit(1), F.lit(n - 1))
            a, b = (t.withColumn("up", up).join(open_, [*keys, "up"], "left_semi").drop("up") for t in (a, b))
        unequal = a.join(b, [*keys, "node"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, "node")
        open_ = unequal.withColumnRenamed("node", "up")
    return unequal
