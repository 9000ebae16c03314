"""Items, keys, sums of roots and heats on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import items

FINDINGS = "rule string, severity bigint, package string, file string, line bigint, decl string, subject string, target string, measure bigint, limit_value bigint, detail string"


def test_finding_items(spark):
    rows = [
        ("long-func", 1, "m/p", "p/a.go", 7, "m/p.f", "f", "", 70, 60, "70 lines, limit 60"),
        ("unstable-dep", 1, "m/p", "", 0, "", "p", "m/q", 50, 33, "imports q"),
        ("large-file", 2, "m/p", "p/b.go", 0, "", "p/b.go", "", 900, 600, ""),
        ("own-rule", 0, "m/p", "", 0, "", "p", "", 0, 0, ""),
    ]
    code = spark.createDataFrame([("m/p.f", ["one", "two"])], "id string, code array<string>")
    got = {r.key: r for r in items.finding_items(spark.createDataFrame(rows, FINDINGS), "wt", "tools", code).collect()}
    f = got["long-func:m/p.f"]
    assert (f.title, f.place, f.code) == ("Long function: f", "tools/p/a.go:7", ["one", "two"])
    assert f.body == "70 lines, limit 60. A long function is hard to hold in your head."
    assert f.check == "Re-read the code: the long function no longer applies to f, and the build and tests still pass."
    assert got["unstable-dep:m/p->m/q"].place == "p" and got["unstable-dep:m/p->m/q"].body.endswith("this one. Other package: m/q.")
    assert got["large-file:p/b.go"].place == "tools/p/b.go" and got["large-file:p/b.go"].code == []
    assert got["own-rule:m/p"].title == "own-rule: p" and got["own-rule:m/p"].body == ""


def test_summaries_add_up_units_and_take_the_most_lines(spark):
    units = spark.createDataFrame([("c", "."), ("c", "."), ("c", "tools"), ("d", ".")], "change string, root string")
    introduced = spark.createDataFrame([("c", "."), ("c", "tools")], "change string, root string")
    files = spark.createDataFrame([("c", ".", 5, 1), ("c", ".", 2, 1), ("c", "tools", 6, 4)], "change string, root string, added bigint, deleted bigint")
    assert sorted(map(tuple, items.summaries(units, introduced, files).collect())) == [("c", 3, 2, 2, 7, 4), ("d", 1, 1, 0, 0, 0)]


def test_shown_lines(spark):
    rows = [(1, True, 5, 2, 9, 9), (2, False, 0, 0, 9, 8), (3, False, 4, 1, None, None)]
    got = items.change_lines(spark.createDataFrame(rows, "k int, ready boolean, added int, deleted int, pr_added int, pr_deleted int"))
    assert [(r.k, r.shown_added, r.shown_deleted) for r in got.orderBy("k").collect()] == [(1, 5, 2), (2, 9, 8), (3, 4, 1)]


@pytest.mark.parametrize(
    ("lens", "want"),
    [("smells", [0, 1, 2, 3, 4, 4]), ("complexity", [0, 1, 1, 1, 2, 5]), ("churn", [0, 1, 1, 1, 2, 5])],
)
def test_heats_on_their_limits(spark, lens, want):
    v = [0.0, 1.0, 3.0, 5.0, 10.0, 40.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    worst = F.lit(1) if lens == "smells" else None
    assert [r.h for r in df.select("i", items.heat(lens, F.col("v"), F.lit(40.0), worst).alias("h")).orderBy("i").collect()] == want
