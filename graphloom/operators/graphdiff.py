"""What differs between two snapshots: declarations, edges, imports and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import smells
from graphloom.sources.binding import Graph


def _gone(a: Graph, b: Graph) -> DataFrame:
    return a.decls.join(b.decls.select("id"), "id", "left_anti")


def moved(base: Graph, head: Graph) -> DataFrame:
    """Declarations of one name, kind and shape that left one place and came to one other; never where several could be meant."""
    key = ["name", "kind", "shape"]

    def single(df: DataFrame) -> DataFrame:
        lone = df.where("shape <> ''").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "path")).alias("d"))
        return lone.where("n = 1").select(*key, "d")

    out = single(_gone(base, head)).withColumnRenamed("d", "old").join(single(_gone(head, base)).withColumnRenamed("d", "new"), key)
    return out.select(F.col("old.id").alias("from_id"), F.col("new.id").alias("to_id"), F.col("old.path").alias("from_path"), F.col("new.path").alias("to_path"), "name", "kind")


def added(base: Graph, head: Graph) -> DataFrame:
    return _gone(head, base).join(moved(base, head).select(F.col("to_id").alias("id")), "id", "left_anti").select("id", "kind", "path")


def removed(base: Graph, head: Graph) -> DataFrame:
    return _gone(base, head).join(moved(base, head).select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "kind", "path")


def renamed(base: Graph, head: Graph, column: str = "id") -> DataFrame:
    """Ids of base and what they are in head."""
    m = moved(base, head).select(F.col("from_id").alias("id"), "to_id")
    return base.decls.select("id").join(m, "id", "left").select("id", F.coalesce("to_id", "id").alias("to_id"))


def changed(base: Graph, head: Graph) -> DataFrame:
    """Declarations of both sides, by their id in head, of which anything measured differs."""
    sides = ("signature", "complexity", "lines", "shape")
    b = base.decls.join(renamed(base, head), "id").select(F.col("to_id").alias("id"), *(F.col(c).alias(f"old_{c}") for c in sides))
    both = head.decls.select("id", *sides).join(b, "id")
    flags = {f"{n}_changed": F.col(c) != F.col(f"old_{c}") for n, c in zip(("sig", "complexity", "lines", "shape"), sides, strict=True)}
    out = both.withColumns(flags)
    any_ = F.col("sig_changed") | F.col("complexity_changed") | F.col("lines_changed") | F.col("shape_changed")
    return out.where(any_).select("id", *flags, (F.col("complexity") - F.col("old_complexity")).alias("complexity_delta"), (F.col("lines") - F.col("old_lines")).alias("lines_delta"))


def _renamed_edges(base: Graph, head: Graph) -> DataFrame:
    r = renamed(base, head)
    e = base.edges.select("src", "dst", "kind")
    e = e.join(r.select(F.col("id").alias("src"), F.col("to_id").alias("s")), "src", "left").join(r.select(F.col("id").alias("dst"), F.col("to_id").alias("d")), "dst", "left")
    return e.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "kind")


def edges_added(base: Graph, head: Graph) -> DataFrame:
    return head.edges.select("src", "dst", "kind").subtract(_renamed_edges(base, head))


def edges_removed(base: Graph, head: Graph) -> DataFrame:
    return _renamed_edges(base, head).subtract(head.edges.select("src", "dst", "kind"))


def imports_added(base: Graph, head: Graph) -> DataFrame:
    return head.imports.subtract(base.imports)


def imports_removed(base: Graph, head: Graph) -> DataFrame:
    return base.imports.subtract(head.imports)


def findings_delta(base: Graph, head: Graph, rules: Sequence[str] = smells.RULES) -> DataFrame:
    """Findings that head introduces and those that it fixes."""
    return smells.delta(smells.union(base, rules), smells.union(head, rules))


def between(base: Graph, head: Graph) -> dict[str, DataFrame]:
    parts = (added, removed, moved, changed, edges_added, edges_removed, imports_added, imports_removed, findings_delta)
    return {p.__name__: p(base, head) for p in parts}
