"""References to declarations by name, without pairs of all that share one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(refs: DataFrame, decls: DataFrame, visible: DataFrame) -> DataFrame:
    """src, dst, kind: which declarations references mean.

    refs are (src, own, own_member, path, pkg, short, kind), own being the short name of src; decls (dst, short, to, at, exported, member); visible
    (path, to) the packages that a file sees. A declaration is meant where its package is the reference's own, or is seen and exports it;
    those in the reference's file before others. A member that several could be is none.

    References of a file to a name are one row until the end, and that meets the packages the file sees, never all of a
    name. How many could be meant, and how many in the file, are counted there; what isn't meant is gone before references are joined, so no row
    is made but links and, for each file and name, what they are chosen from.
    """
    asked = refs.select("path", "pkg", "short").distinct().join(decls.select("short").distinct().hint("merge"), "short", "left_semi")
    scope = visible.select("path", "to").union(asked.select("path", F.col("pkg").alias("to"))).distinct()
    met = asked.join(scope, "path").join(decls.hint("merge"), ["to", "short"]).where((F.col("pkg") == F.col("to")) | F.col("exported"))
    met = met.withColumn("near", F.col("at") == F.col("path"))
    counts = met.groupBy("path", "pkg", "short").agg(F.count(F.lit(1)).alias("many"), F.count_if(F.col("near") & ~F.col("member")).alias("in_file"))
    # of three, one at most is the reference's own declaration, so no member is meant; of two in the file, one is left for sure
    left = met.join(counts, ["path", "pkg", "short"]).where((F.col("many") <= 2) | (~F.col("member") & (F.col("near") | (F.col("in_file") < 2))))
    left = left.select("path", "pkg", "short", "dst", "member", "near", "many", "in_file")
    itself = F.when(F.col("own") == F.col("short"), 1).otherwise(0)
    plain_itself = F.when(F.col("own_member"), 0).otherwise(itself)
    out = refs.join(left, ["path", "pkg", "short"]).where(F.col("src") != F.col("dst"))
    alone = F.col("many") - itself == 1
    return out.where(alone | (~F.col("member") & (F.col("near") | (F.col("in_file") - plain_itself == 0)))).select("src", "dst", "kind")
