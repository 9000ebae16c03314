"""Measures and places behind prognoses, on small graphs."""

from pyspark.sql import functions as F

from graphloom.operators import evidence, prognoses
from tests.test_operators import graph


def by_key(df, *columns):
    out = {}
    for r in df.orderBy("key", "pos").collect():
        out.setdefault(r.key, []).append(tuple(r[c] for c in columns))
    return out


def test_every_kind_has_its_measures(spark):
    many = [{"name": f"p{i}", "params": 6 + i} for i in range(3)]
    g = graph(spark, [*many, {"name": "alone", "params": 9, "pkg": "shop/b"}, {"name": "hard", "complexity": 30, "lines": 40}, {"name": "big", "lines": 1300, "path": "a/big.src"}], churn={"a/x.src": 4, "a/big.src": 1})
    got = by_key(evidence.facts(g, share=90), "label", "value", "limit_value")
    assert got["params:shop/a"] == [("functions with too many parameters", 3, 3), ("most parameters in one", 8, 5)]
    assert got["params:shop/b.alone"] == [("parameters", 9, 5)]
    assert got["large-file:a/big.src"] == [("lines of code", 1300, 1200), ("commits lately", 1, 0)]
    assert got["dominant:shop/a"] == [("share of the module's lines, %", 99, 50), ("lines", 1343, 0), ("files", 2, 0)]
    assert got["hotspot:shop/a.hard"] == got["untested:shop/a.hard"] == [("paths through it (complexity)", 30, 10), ("commits to its file lately", 4, 0), ("lines", 40, 60), ("tests that call it", 0, 0)]
    assert got["untested-pkg:shop/b"] == [("lines", 1, 0), ("test files", 0, 0)]
    shown = {r.key for r in prognoses.union(g).collect()}
    assert set(got) - {"dominant:shop/a"} <= shown and shown <= set(got)


def test_places_go_by_rank_and_end_at_eight(spark):
    callers = [{"name": f"c{i:02}", "lines": 20 - i} for i in range(10)]
    g = graph(
        spark, [{"name": "hard", "complexity": 12}, *callers, {"name": "TestHard", "test": True, "path": "a/t.src"}, {"name": "alone", "params": 7, "pkg": "shop/b"}, {"name": "f", "lines": 700, "path": "a/big.src"}],
        [*((f"shop/a.c{i:02}", "shop/a.hard") for i in range(10)), ("shop/a.TestHard", "shop/a.hard"), ("shop/a.c01", "shop/b.alone")],
    )
    got = by_key(evidence.related(g, least=10), "pos", "id", "name", "why")
    assert got["complex:shop/a.hard"] == [(i + 1, f"shop/a.c{i:02}", f"c{i:02}", evidence.REACHED) for i in range(8)]
    assert "untested:shop/a.hard" not in got
    assert got["params:shop/b.alone"] == [(1, "shop/a.c01", "c01", evidence.RESIGNED)]
    assert got["reach:shop/a.hard"] == [(1, "shop/a", "a", "10 declarations here call it")]
    assert got["large-file:a/big.src"] == [(1, "shop/a.f", "f", "700 lines")]


def test_exports_that_nobody_uses_come_first(spark):
    names = [{"name": f"E{i}", "exported": True, "pkg": "shop/w"} for i in range(9)]
    g = graph(spark, [*names, {"name": "u", "pkg": "shop/v"}, {"name": "w", "pkg": "shop/v"}], [("shop/v.u", "shop/w.E0"), ("shop/v.w", "shop/w.E0"), ("shop/v.u", "shop/w.E1")], imports=[("shop/v", "shop/w")])
    got = by_key(evidence.related(g), "name", "why")["wide:shop/w"]
    assert [n for n, _ in got] == ["E2", "E3", "E4", "E5", "E6", "E7", "E8", "E1"]
    assert got[0][1] == evidence.UNCALLED and got[-1][1] == "used 1 time from other packages"


def test_label_keeps_argument_types(spark):
    rows = [("M.f(::Int)", "M", "f"), ("M.f", "M", "f"), ("M.fg(x)", "M", "f")]
    df = spark.createDataFrame(rows, "id string, pkg string, name string")
    assert [r.x for r in df.select(evidence.label(F.col("id"), F.col("pkg"), F.col("name")).alias("x")).collect()] == ["f(::Int)", "f", "f"]


def test_an_empty_graph_has_nothing_behind_it(spark):
    g = graph(spark, [{"name": "f"}])
    for n in ("decls", "files"):
        g.given[n] = g.given[n].limit(0)
    assert evidence.facts(g).count() == 0 and evidence.related(g).count() == 0
