"""Operators against hand-made graphs, on the limits of each rule, and against DuckDB on the driver's tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.operators import graphdiff, prognoses, review, smells, walks
from graphloom.sources.binding import Graph, bound

DECL = (
    "k bigint, b bigint, id string, name string, kind string, pkg string, pkg_name string, path string, test boolean, generated boolean, exported boolean, data boolean, start_line bigint, end_line bigint, lines bigint, complexity bigint, nesting bigint, "
    "params bigint, signature string, shape string, forwards string, delegates string, deprecated boolean, calls bigint, escapes boolean, fixed_param string, fixed_value string, ord bigint"
)


def graph(spark, decls, edges=(), imports=None, churn=None):
    rows = []
    for k, d in enumerate(decls):
        d = {"kind": "func", "pkg": "shop/a", "test": False, "generated": False, "exported": False, "data": False, "lines": 1, "complexity": 0, "nesting": 0, "params": 0, "signature": "", "shape": f"s{k}", "forwards": "", "delegates": "", "deprecated": False, "calls": 0, "escapes": False, "fixed_param": "", "fixed_value": ""} | d
        d.setdefault("pkg_name", d["pkg"].rsplit("/", 1)[-1])
        d.setdefault("path", d["pkg"].removeprefix("shop/") + "/x.src")
        rows.append((k, 0, d.get("id", d["pkg"] + "." + d["name"]), d["name"], d["kind"], d["pkg"], d["pkg_name"], d["path"], d["test"], d["generated"], d["exported"], d["data"], k + 1, k + d["lines"], d["lines"], d["complexity"], d["nesting"], d["params"], d["signature"], d["shape"], d["forwards"], d["delegates"], d["deprecated"], d["calls"], d["escapes"], d["fixed_param"], d["fixed_value"], k))
    g = Graph(spark, None)
    g.given["decls"] = spark.createDataFrame(rows, DECL)
    g.given["edges"] = spark.createDataFrame([(*e, "caller", 1)[:2] + ((e[2] if len(e) > 2 else "caller"), (e[3] if len(e) > 3 else 1)) for e in edges], "src string, dst string, kind string, n bigint")
    g.given["imports"] = spark.createDataFrame(list(imports or []), "src string, dst string")
    files = {}
    for r in rows:
        f = files.setdefault((r[5], r[7]), [False, False, 0])
        f[0], f[1], f[2] = f[0] or r[8], f[1] or r[9], f[2] + r[14]
    g.given["files"] = spark.createDataFrame([(p, q, *v, (churn or {}).get(q, 0)) for (p, q), v in files.items()], "pkg string, path string, test boolean, generated boolean, lines bigint, churn bigint")
    return g


def found(df):
    return {(r.decl or r.file or r.package): r for r in df.collect()}


def test_sizes_on_their_limits(spark):
    g = graph(spark, [
        {"name": "l60", "lines": 60}, {"name": "l61", "lines": 61}, {"name": "l120", "lines": 120}, {"name": "l121", "lines": 121}, {"name": "t", "lines": 500, "test": True, "path": "a/t.src"}, {"name": "gen", "lines": 500, "generated": True, "path": "a/g.src"}, {"name": "T", "kind": "type", "lines": 500},
        {"name": "c10", "complexity": 10}, {"name": "c11", "complexity": 11}, {"name": "c20", "complexity": 20, "kind": "method"}, {"name": "c21", "complexity": 21}, {"name": "n4", "nesting": 4}, {"name": "n5", "nesting": 5}, {"name": "p5", "params": 5}, {"name": "p6", "params": 6},
    ])
    got = {k.split(".")[-1]: (r.severity, r.measure, r.limit_value, r.detail) for k, r in found(smells.long_func(g)).items()}
    assert got == {"l61": (1, 61, 60, "61 lines, limit 60"), "l120": (1, 120, 60, "120 lines, limit 60"), "l121": (2, 121, 120, "121 lines, high limit 120")}
    assert {k.split(".")[-1]: r.severity for k, r in found(smells.complex_func(g)).items()} == {"c11": 1, "c20": 1, "c21": 2}
    assert [r.detail for r in smells.deep_nesting(g).collect()] == ["nesting 5, limit 4"]
    assert [r.detail for r in smells.many_params(g).collect()] == ["6 params, limit 5"]
    assert smells.find(g).first().severity == 2


def test_large_files(spark):
    rows = [{"name": f"f{n}", "lines": n, "path": f"a/{n}.src"} for n in (600, 601, 1200, 1201)] + [{"name": "t", "lines": 900, "test": True, "path": "a/t.src"}]
    assert {r.file: r.severity for r in smells.large_file(graph(spark, rows)).collect()} == {"a/601.src": 1, "a/1200.src": 1, "a/1201.src": 2}


def test_reach_rules(spark):
    g = graph(spark, [
        {"name": "Used", "exported": True, "pkg": "shop/internal/p"}, {"name": "Alone", "exported": True, "pkg": "shop/internal/p"}, {"name": "Mode", "kind": "type", "exported": True, "pkg": "shop/internal/p"}, {"name": "ModeA", "kind": "const", "exported": True, "pkg": "shop/internal/p", "signature": "Mode, x"},
        {"name": "Open", "exported": True, "pkg": "shop/q"}, {"name": "init", "pkg": "shop/q"}, {"name": "gone", "pkg": "shop/q"}, {"name": "V", "kind": "var", "pkg": "shop/q"}, {"name": "T.m", "kind": "method", "pkg": "shop/q"}, {"name": "main", "pkg": "shop/cmd", "pkg_name": "main"}, {"name": "X", "exported": True, "pkg": "shop/cmd", "pkg_name": "main"},
    ], [("shop/q.Open", "shop/internal/p.Used"), ("shop/q.Open", "shop/internal/p.Mode", "user")])
    assert set(found(smells.unused_export(g))) == {"shop/internal/p.Alone"}
    assert {k: r.severity for k, r in found(smells.dead_code(g)).items()} == {"shop/q.gone": 1, "shop/q.V": 0, "shop/cmd.X": 1}


def test_envy_ties_go_to_the_least_package(spark):
    g = graph(spark, [{"name": "f"}, {"name": "own"}, {"name": "x", "pkg": "shop/hub"}, {"name": "y", "pkg": "shop/zed"}, {"name": "few"}], [("shop/a.f", "shop/a.own", "caller", 1), ("shop/a.f", "shop/hub.x", "caller", 4), ("shop/a.f", "shop/zed.y", "caller", 4), ("shop/a.few", "shop/hub.x", "caller", 3)])
    (r,) = smells.envious_func(g).collect()
    assert (r.decl, r.target, r.measure, r.limit_value, r.detail) == ("shop/a.f", "shop/hub", 4, 1, "4 refs to hub, 1 to own package")


def test_unstable_dependency(spark):
    g = graph(spark, [{"name": "f", "pkg": f"shop/{p}"} for p in ("app", "core", "flaky", "leaf", "two")], imports=[("shop/app", "shop/core"), ("shop/two", "shop/core"), ("shop/core", "shop/flaky"), ("shop/flaky", "shop/leaf")])
    (r,) = smells.unstable_dep(g).collect()
    assert (r.package, r.target, r.measure, r.limit_value, r.detail) == ("shop/core", "shop/flaky", 50, 33, "imports flaky (I=0.50) from I=0.33")


def test_untested_and_layers_of_calls(spark):
    g = graph(spark, [
        {"name": "f", "pkg": "shop/none"}, {"name": "f", "pkg": "shop/own"}, {"name": "TestF", "pkg": "shop/own", "test": True, "path": "own/t.src"}, {"name": "f", "pkg": "shop/by"}, {"name": "pass", "forwards": "g", "pkg": "shop/own"}, {"name": "init", "forwards": "g", "pkg": "shop/own"},
        {"name": "fix", "fixed_param": "n", "fixed_value": "3", "calls": 3, "pkg": "shop/own"}, {"name": "few", "fixed_param": "n", "fixed_value": "3", "calls": 2, "pkg": "shop/own"}, {"name": "Open", "exported": True, "fixed_param": "n", "fixed_value": "3", "calls": 3, "pkg": "shop/own"}, {"name": "esc", "fixed_param": "n", "fixed_value": "3", "calls": 3, "escapes": True, "pkg": "shop/own"},
    ], [("shop/own.TestF", "shop/by.f")])
    assert {r.package for r in smells.untested_package(g).collect()} == {"shop/none"}
    assert [r.detail for r in smells.pass_through(g).collect()] == ["only calls g with its own arguments"]
    assert {k: r.detail for k, r in found(smells.fixed_arg(g)).items()} == {"shop/own.fix": "n is 3 at all 3 production call sites"}


def test_middle_man(spark):
    m = lambda t, i, d: {"name": f"{t}.m{i}", "kind": "method", "delegates": d}
    rows = [{"name": t, "kind": "type"} for t in "ABC"] + [{"name": "D", "kind": "type", "deprecated": True}]
    rows += [m("A", i, d) for i, d in enumerate(("x", "in", "in", "x"))] + [m("B", i, d) for i, d in enumerate(("in", "", ""))] + [m("C", i, "in") for i in range(2)] + [m("D", i, "in") for i in range(3)]
    assert {k: r.detail for k, r in found(smells.middle_man(graph(spark, rows))).items()} == {"shop/a.A": "2 of 4 methods only call in's"}


def test_prognoses(spark):
    callers = [{"name": f"u{i}", "pkg": "shop/u"} for i in range(50)]
    g = graph(spark, [
        {"name": "Tangled", "complexity": 17, "path": "a/busy.src"}, {"name": "Knotty", "complexity": 11, "path": "a/calm.src"}, {"name": "Six", "params": 6}, {"name": "Seven", "params": 7}, {"name": "Eight", "params": 8}, {"name": "Far", "pkg": "shop/b"}, {"name": "Lone", "params": 6, "pkg": "shop/b"}, {"name": "T", "test": True, "path": "a/t.src"}, *callers,
    ], [("shop/a.T", "shop/a.Knotty"), *((f"shop/u.u{i}", "shop/b.Far") for i in range(50))], churn={"a/busy.src": 9})
    got = {r.key: r for r in prognoses.find(g).collect()}
    assert got["hotspot:shop/a.Tangled"].level == 2 and got["untested:shop/a.Tangled"].level == 2 and got["complex:shop/a.Knotty"].level == 1 and "untested:shop/a.Knotty" not in got
    assert (got["params:shop/a"].target, got["params:shop/a"].level) == ("shop/a.Eight", 2) and got["params:shop/b.Lone"].level == 1
    assert got["reach:shop/b.Far"].summary == "Far is used by 50 declarations in 1 package."
    lines = {r.key: r.text for r in prognoses.lines(prognoses.union(g)).collect()}
    assert lines["hotspot:shop/a.Tangled"] == "hotspot:shop/a.Tangled\tfix soon\tHard to follow, and it keeps changing\tTangled (a/busy.src:1)"
    heats = {r.id: (r.health, r.reach, r.structure, r.tests) for r in prognoses.heats(g).collect()}
    assert heats["shop/a.Tangled"] == (4, 0, 1, 3) and heats["shop/a.Knotty"] == (3, 0, 1, 0) and heats["shop/a.Eight"] == (0, 0, 1, 3) and heats["shop/b.Far"][1] == 4


def test_graph_diff(spark):
    base = graph(spark, [{"name": "stay", "shape": "a"}, {"name": "gone", "shape": "b"}, {"name": "mv", "shape": "m", "pkg": "shop/x"}, {"name": "am", "shape": "q", "pkg": "shop/x"}, {"name": "am", "shape": "q", "pkg": "shop/y"}, {"name": "sig", "signature": "1", "lines": 2, "shape": "z"}, {"name": "bare", "shape": "", "pkg": "shop/x"}], [("shop/a.stay", "shop/x.mv"), ("shop/a.stay", "shop/a.gone")], [("shop/a", "shop/x")])
    head = graph(spark, [{"name": "stay", "shape": "a"}, {"name": "new", "shape": "n"}, {"name": "mv", "shape": "m", "pkg": "shop/w"}, {"name": "am", "shape": "q", "pkg": "shop/w"}, {"name": "sig", "signature": "2", "lines": 5, "shape": "z"}, {"name": "bare", "shape": "", "pkg": "shop/w"}], [("shop/a.stay", "shop/w.mv"), ("shop/a.stay", "shop/a.new")], [("shop/a", "shop/w")])
    ids = lambda df: {r.id for r in df.collect()}
    assert [(r.from_id, r.to_id) for r in graphdiff.moved(base, head).collect()] == [("shop/x.mv", "shop/w.mv")]
    assert ids(graphdiff.added(base, head)) == {"shop/a.new", "shop/w.am", "shop/w.bare"} and ids(graphdiff.removed(base, head)) == {"shop/a.gone", "shop/x.am", "shop/y.am", "shop/x.bare"}
    (c,) = graphdiff.changed(base, head).collect()
    assert (c.id, c.sig_changed, c.lines_changed, c.shape_changed, c.lines_delta) == ("shop/a.sig", True, True, False, 3)
    assert [r.dst for r in graphdiff.edges_added(base, head).collect()] == ["shop/a.new"] and [r.dst for r in graphdiff.edges_removed(base, head).collect()] == ["shop/a.gone"]
    assert [r.dst for r in graphdiff.imports_added(base, head).collect()] == ["shop/w"]


def test_findings_pair_one_for_one(spark):
    row = lambda decl, line, name="f", rule="long-func", file="a.src": (rule, 1, "p", file, line, decl, name, "", 61, 60, "")
    df = lambda rows: spark.createDataFrame(rows, "rule string, severity bigint, package string, file string, line bigint, decl string, subject string, target string, measure bigint, limit_value bigint, detail string")
    change = lambda a, b: sorted((r.change, r.decl, r.line) for r in smells.delta(df(a), df(b)).collect())
    assert change([row("p.f", 1)], [row("p.f", 1), row("p.f#2", 9)]) == [("introduced", "p.f#2", 9)]
    assert change([row("p.f", 1), row("p.f#2", 9)], [row("p.f", 1)]) == [("fixed", "p.f#2", 9)]
    assert change([row("p.f", 1)], [row("q.f", 5, file="b.src")]) == []  # moved with its smell


def test_units(spark):
    base = graph(spark, [{"name": "Api", "exported": True, "signature": "1", "shape": "a"}, {"name": "calm", "shape": "b"}, {"name": "old", "shape": "c"}, {"name": "caller", "shape": "d"}], [("shop/a.caller", "shop/a.old")])
    head = graph(spark, [{"name": "Api", "exported": True, "signature": "2", "shape": "a2", "complexity": 4}, {"name": "calm", "shape": "b"}, {"name": "fresh", "shape": "e", "complexity": 11}, {"name": "caller", "shape": "d"}, {"name": "Test", "test": True, "shape": "t"}], [("shop/a.caller", "shop/a.Api"), ("shop/a.Test", "shop/a.Api")])
    lines = lambda rows: spark.createDataFrame(rows, "id string, lines bigint")
    got = {r.name: r for r in review.units(base, head, lines([("shop/a.Api", 2), ("shop/a.calm", 1), ("shop/a.old", 9)]), lines([("shop/a.Api", 3), ("shop/a.fresh", 8), ("shop/a.Test", 1)])).collect()}
    api = got["Api"]
    assert (api.change, api.lane) == ("modified", review.CONTRACT) and api.reasons == "signature changed; 2 callers (1 in tests); 1 new reference; exported; complexity 4 (+4)"
    assert api.risk == 5 // 4 + 6 + 3 + 2 + 4 + (2 + 8)
    assert (got["calm"].lane, got["calm"].risk, got["calm"].reasons) == (review.NOISE, 0, "comments or layout only")
    assert (got["old"].change, got["old"].risk, got["old"].reasons) == ("removed", 2 + 4 + 3, "1 caller")
    assert (got["fresh"].change, got["fresh"].risk, got["fresh"].reasons) == ("added", 2 + 5 + 5, "complexity 11; no direct test") and got["Test"].lane == review.TESTS
    assert review.ordered(spark.createDataFrame(list(got.values()))).first().name == "Api"


def test_walks(spark):
    g = graph(spark, [{"name": n} for n in ("root", "quiet", "busy", "user", "c1", "c2")] + [{"name": "TestR", "test": True}], [("shop/a.quiet", "shop/a.root"), ("shop/a.busy", "shop/a.root"), ("shop/a.user", "shop/a.root", "user"), ("shop/a.TestR", "shop/a.root"), ("shop/a.c1", "shop/a.busy"), ("shop/a.c2", "shop/a.busy"), ("shop/a.root", "shop/a.c1")], [("shop/x", "shop/y"), ("shop/y", "shop/z"), ("shop/x", "shop/z")])
    path = spark.createDataFrame([("t", ["shop/a.root"])], "thread string, ids array<string>")
    assert [r.id.split(".")[1] for r in walks.next_steps(g, path).orderBy("pos").collect()] == ["busy", "quiet", "user", "TestR"]
    ring = {r.id.split(".")[1]: r.hop for r in walks.ring(g, g.decls.where("name = 'root'").select("id")).collect()}
    assert ring == {"quiet": 1, "busy": 1, "TestR": 1, "c1": 2, "c2": 2}
    g.given["packages"] = spark.createDataFrame([(f"shop/{p}", p, p) for p in "xyz"], "pkg string, name string, rel string")
    g.__dict__.pop("packages", None)
    assert {r.pkg: r.layer for r in walks.layers(g).collect()} == {"shop/x": 2, "shop/y": 1, "shop/z": 0}
    steps = spark.createDataFrame([("t", 1, "shop/a.root"), ("t", 2, "shop/a.busy"), ("t", 3, "shop/a.quiet"), ("t", 4, "shop/a.c1")], "thread string, pos int, id string")
    assert [r.pos for r in walks.replay(steps, g).orderBy("pos").collect()] == [1, 2]


def test_layers_on_and_above_cycles(spark):
    import random

    def plain(imports, packages):
        layer = {}

        def depth(p, seen):
            if p in layer:
                return layer[p]
            if p not in packages or p in seen:
                return 0
            seen.add(p)
            deepest = 0
            for q in sorted(d for s, d in imports if s == p):
                deepest = max(deepest, depth(q, seen) + 1)
            layer[p] = deepest
            return deepest

        return {p: depth(p, set()) for p in sorted(packages)}

    r = random.Random(3)
    for n in (4, 9, 14):
        packages = [f"p{i:02d}" for i in range(n)]
        imports = {tuple(r.sample(packages, 2)) for _ in range(n + 4)} | {("p00", "elsewhere")}
        g = Graph(spark, None)
        g.given["imports"] = spark.createDataFrame(sorted(imports), "src string, dst string")
        g.given["packages"] = spark.createDataFrame([(p, p, p) for p in packages], "pkg string, name string, rel string")
        assert {x.pkg: x.layer for x in walks.layers(g).collect()} == plain(imports, set(packages))


def test_path_codec(spark):
    from graphloom.functions.scalars import join_path, split_path
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a~b", "%7E%25", ""), ("", "~~", "%")], "a string, b string, c string")
    got = rows.withColumn("j", join_path(F.col("a"), F.col("b"), F.col("c"))).withColumn("p", split_path(F.col("j"))).collect()
    assert all(x.p == [x.a, x.b, x.c] for x in got) and got[0].j == "a%7Eb~%257E%2525~"


def test_closure_follows_imports_to_the_end(spark):
    g = Graph(spark, None)
    chain = [(f"p{i}", f"p{i + 1}") for i in range(7)] + [("p7", "p5"), ("p0", "p1")]
    g.given["imports"] = spark.createDataFrame(chain, "src string, dst string")
    got = sorted(tuple(r) for r in walks.closure(g).collect())
    want = {(f"p{i}", f"p{j}") for i in range(8) for j in range(i + 1, 8)} | {("p6", "p5"), ("p7", "p5"), ("p7", "p6")}
    assert got == sorted(want)


def test_generated_header(spark, tmp_path):
    says = {
        "// Code Generated by x": True, "# DO NOT EDIT": True, "// AUTO-GENERATED": True, "autogenerated": True, "/* @Generated */": True, "a generated text": False, "": False, "1\n2\n3\n4\n@generated": True,
        "1\n2\n3\n4\n5\n@generated": False, "x" * 502 + "@generated": True, "x" * 503 + "@generated": False, "é" * 251 + "@generated": True, "é" * 252 + "@generated": False,
    }
    spark.createDataFrame(list(enumerate(says)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.generated for r in entry.queries()["flt16_generated_header"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(says))] == list(says.values())


QUICK = ("sm01_long_func", "sm08_envious_func", "pg01_hotspot", "gd02_moved", "gd04_edges_added", "jn02_touched", "agg03_package_refs", "tm05_dsm", "win12_fold_rows", "src03_roots", "snk06_basket_move", "gr04_ring")


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, sf).select(*(f"`{c}`" for c in columns)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_queries_run_over_all_declarations(spark):
    sf, con, got = "/root/testdata/sf0.01", duckdb.connect(), {}
    for t in ("part", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("jn07_named_links", "flt07_span_hits", "flt11_map_scope", "sc17_path_codec", "win11_basket_groups", "win05_candidates", "gr01_next", "gr02_follow"):
        want = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        got[name] = [tuple(r) for r in entry.queries()[name](spark, sf).select(*columns).collect()]
        assert sorted(map(repr, got[name])) == sorted(map(repr, want.fetchall()))
    g = bound(spark, sf)
    ids, edges = {r.id for r in g.decls.select("id").collect()}, {(r.dst, r.src) for r in g.edges.select("dst", "src").collect()}
    for name in ("flt11_map_scope", "sc17_path_codec"):
        assert {r[0] for r in got[name]} == ids
    assert ids <= {x for r in got["win11_basket_groups"] for x in r}
    assert {r[:2] for r in got["gr01_next"]} == {r[:2] for r in got["win05_candidates"]} == edges
    assert {r.dst for r in entry.queries()["ui03_thread_text"](spark, sf).collect()} == {d for d, _ in edges}


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_strong_components(spark):
    import random

    from graphloom.operators import strong

    rng = random.Random(9)
    nodes = [f"n{i:02d}" for i in range(26)]
    edges = {tuple(rng.sample(nodes[:22], 2)) for _ in range(30)} | {(f"n{i:02d}", f"n{i + 1:02d}") for i in range(22, 25)} | {("n00", "n00")}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in edges:
            for x in nodes:
                if a in reach[x]:
                    reach[x].add(b)
    want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    got = strong.components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    assert {r.node: r.component for r in got.collect()} == want and len(set(want.values())) < len(nodes)
