"""Queries by name, and what each should return in DuckDB's SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graphdiff, prognoses, review, smells, walks
from graphloom.plans import linked, oracle, portable, ruled, texts, walked
from graphloom.sources.binding import Graph, both_kept, bound, versions

Query = Callable[[SparkSession, str], DataFrame]


def _one(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(bound(spark, sf_dir))


def _all(f: Callable[[Graph], DataFrame]) -> Query:
    """For what reads a graph's tables many times."""
    return lambda spark, sf_dir: f(bound(spark, sf_dir).kept())


def _two(f: Callable[[Graph, Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*versions(spark, sf_dir))


def hunks(g: Graph, removed: int) -> DataFrame:
    return g.decls.where((F.col("k") % 29 == 0) | (F.col("k") % 23 == 0) | (F.col("k") % removed == 0)).select("path", F.col("start_line").alias("start"), F.greatest("lines", F.lit(1)).alias("n"))


def _units(base: Graph, head: Graph, gained: DataFrame | None = None) -> DataFrame:
    base, head = both_kept(base, head, "decls", "edges")
    return review.units(base, head, review.touched_lines(base.decls, hunks(base, 19)), review.touched_lines(head.decls, hunks(head, 17)), gained)


SMELL_IDS = {r: f"sm{i:02d}_{r}" for i, r in enumerate(smells.RULES, 1)}
PROGNOSIS_IDS = {k.__name__.rstrip("_"): f"pg{i:02d}_{k.__name__.rstrip('_')}" for i, k in zip((1, 2, 3, 4, 5, 6, 7, 8, 10, 11), prognoses.KINDS, strict=True)}
DIFF_IDS = {"added": "gd01_added", "removed": "gd01_removed", "moved": "gd02_moved", "changed": "gd03_changed", "edges_added": "gd04_edges_added", "edges_removed": "gd04_edges_removed", "imports_added": "gd05_imports_added", "imports_removed": "gd05_imports_removed", "findings_delta": "gd06_findings_delta"}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"set04_findings": _all(smells.union), "win03_prognoses": _all(prognoses.find)}
    out |= {SMELL_IDS[r]: _one(lambda g, r=r: smells.union(g, (r,))) for r in smells.RULES}
    out |= {PROGNOSIS_IDS[k.__name__.rstrip("_")]: _one(k) for k in prognoses.KINDS}
    out |= {DIFF_IDS[n]: _two(getattr(graphdiff, n)) for n in DIFF_IDS if n != "findings_delta"}
    out |= {DIFF_IDS["findings_delta"]: _two(lambda b, h: graphdiff.findings_delta(*both_kept(b, h)))}
    out |= {
        "pg12_heats": _one(prognoses.heats),
        "snk09_cli_lines": _all(lambda g: prognoses.lines(prognoses.union(g))),
        "win07_reach_related": _one(lambda g: prognoses.reach_related(g, 20)),
        "agg02_outside_calls": _one(prognoses.outside_calls),
        "agg04_instability": _one(smells.instability),
        "agg06_middle_tally": _one(smells.middle_tally),
        "agg08_hot_churn": _one(prognoses.hot_churn),
        "agg09_callers": _one(prognoses.callers),
        "flt05_used_outside": _one(smells.used_outside),
        "jn02_touched": _two(lambda b, h: review.touched(h.decls, hunks(h, 17))),
        "jn03_decl_lines": _two(lambda b, h: review.touched_lines(h.decls, hunks(h, 17))),
        "rv02_units": _two(_units),
        "gr05_layers": _one(walks.layers),
    }
    return out | portable.queries() | texts.QUERIES | walked.QUERIES | linked.QUERIES | ruled.QUERIES


def oracle_sql() -> dict[str, str]:
    sql = oracle.sql
    out = {"set04_findings": sql(oracle.FINDINGS), "win03_prognoses": sql(oracle.ALL_PROGNOSES)}
    out |= {SMELL_IDS[n]: sql(q) for n, q in oracle.SMELLS.items()}
    out |= {PROGNOSIS_IDS[n]: sql(q) for n, q in oracle.PROGNOSES.items()}
    out |= {DIFF_IDS[n]: sql(q) for n, q in oracle.DIFFS.items()}
    out |= {
        "pg12_heats": sql(oracle.HEATS),
        "snk09_cli_lines": sql(oracle.CLI),
        "win07_reach_related": sql("select id, pos, \"from\" as package, n from (select *, row_number() over (partition by id order by n desc, \"from\") as pos from {calling} where id in (select id from {decls} where not test) and id in (select id from {calling} group by id having sum(n) >= 20)) where pos <= 8"),
        "agg02_outside_calls": sql("select c.id, cast(sum(c.n) as bigint) as n from {calling} c join {decls} d on c.id = d.id where c.\"from\" <> d.pkg group by c.id"),
        "agg04_instability": sql("select * from {instability}"),
        "agg06_middle_tally": sql("select pkg, recv, cast(methods as bigint) as methods, coalesce(field, '') as field, cast(coalesce(n, 0) as bigint) as n from {tally}"),
        "agg08_hot_churn": sql("select cast(hot as bigint) as hot from {hot}"),
        "agg09_callers": sql("select * from {callers}"),
        "flt05_used_outside": sql("select * from {used}"),
        "jn02_touched": sql(oracle.TOUCHED),
        "jn03_decl_lines": sql("select * from {new_lines}"),
        "rv02_units": sql(oracle.UNITS),
    }
    return out | portable.oracle_sql() | texts.oracle_sql() | walked.oracle_sql() | linked.oracle_sql() | ruled.oracle_sql()


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query: all findings of the smallest tables, worst first."""
    return smells.find(bound(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")).kept())
