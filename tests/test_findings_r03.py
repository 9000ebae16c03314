"""What the third round's reviewer found, on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import spans
from graphloom.functions.scalars import fixed2
from graphloom.operators import build, handoff, review
from graphloom.plans import walked
from graphloom.sources.binding import bound, versions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_digits_go_by_the_exact_value(spark):
    values = [0.0, 0.125, 0.375, 0.625, 0.875, 0.145, 0.155, 0.29, 0.57, 1.0, 1 / 3, 0.995, 1.005]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(fixed2(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:.2f}" for v in values]


LINE, SPAN = "path string, line bigint, text string", "id string, path string, start_line bigint, end_line bigint"


def test_lines_and_spans_meet_over_blocks(spark):
    lines = spark.createDataFrame([("a", i, f"t{i}") for i in range(1, 301)] + [("b", i, "x") for i in range(1, 4)], LINE)
    held = [("p", "a", 2, 2), ("q", "a", 60, 200), ("r", "a", 63, 64), ("s", "a", 250, 400), ("n", "a", 100, 110), ("t", "c", 1, 9), ("u", "b", 3, 3)]
    decls = spark.createDataFrame(held, SPAN)
    want = {(p, i) for p, n in (("a", 300), ("b", 3)) for i in range(1, n + 1) if not any(p == f and s <= i <= e for _, f, s, e in held)}
    assert {(r.path, r.line) for r in review.loose(lines, decls).collect()} == want
    code = {r.id: r.code for r in handoff.excerpt(lines, decls).collect()}
    assert set(code) == {"p", "q", "r", "s", "n", "u"} and code["r"] == ["t63", "t64"]
    assert code["q"] == [f"t{i}" for i in range(60, 100)] + ["… 101 more lines"] and code["s"][-1] == "… 11 more lines"
    assert sum(len(r.own) for r in spans.inside(lines, decls).where("id = 'q'").collect()) == 141


def test_hunks_meet_declarations_over_blocks(spark):
    decls = spark.createDataFrame([("p", "a", 10, 300), ("q", "a", 301, 310), ("r", "b", 10, 20)], SPAN)
    hunks = spark.createDataFrame([("a", 1, 9), ("a", 200, 105), ("a", 63, 0), ("b", 20, 0), ("c", 10, 5)], "path string, start bigint, n bigint")
    assert sorted(map(tuple, review.touched_lines(decls, hunks).collect())) == [("p", 101), ("q", 4)]
    assert sorted(r.id for r in review.touched(decls, hunks).collect()) == ["p", "q"]


def test_a_declarations_text_is_whole_or_none(spark, sf):
    base, _ = versions(spark, sf)
    some = base.decls.limit(3).collect()
    lines = spark.createDataFrame([(r.path, i, f"{r.id}{i}") for r in some for i in range(r.start_line, r.end_line + 1) if r is not some[2] or i < r.end_line], LINE)
    got = {r.id: r.own for r in build._texts_of(spark.createDataFrame([(r.id,) for r in some], "id string"), base, lines).collect()}
    assert got == {r.id: "\n".join(f"{r.id}{i}" for i in range(r.start_line, r.end_line + 1)) for r in some[:2]}


@pytest.mark.parametrize("name", ["ui02_decl_lines", "gr07_owner", "rv04_loose_lines"])
def test_no_exploded_rows_are_broadcast(spark, sf, name):
    plan = _plan(entry.queries()[name](spark, sf))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("SortMergeJoin" in j for j in joins)
    assert "BroadcastHashJoin" not in joins[0]


def test_lines_are_made_by_many_tasks(spark, sf):
    assert walked.file_lines(bound(spark, sf)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_versions_share_the_edges_by_keys(spark, sf):
    base, head = versions(spark, sf)
    plain = {json.dumps(r.asDict(), sort_keys=True) for r in head.edges.collect()}
    base.kept("decls", "edges"), head.kept("decls", "edges")
    assert base.sources["pairs"] is head.sources["pairs"]
    assert {json.dumps(r.asDict(), sort_keys=True) for r in head.edges.collect()} == plain


def test_change_lines_are_of_a_changes_units(spark, sf):
    got = {r.id: (r.added, r.deleted) for r in entry.queries()["ui06_change_lines"](spark, sf).collect()}
    assert got == {r.id: (r.added, r.deleted) for r in entry.queries()["rv02_units"](spark, sf).collect()}
    assert "ui06_pull_lines" in entry.queries()
