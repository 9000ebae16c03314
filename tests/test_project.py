"""From small trees on disk to findings, differences and units."""

import subprocess

import pytest

from graphloom.operators import smells
from graphloom.plans.project import Project
from graphloom.sources import diffs, frontends, git, golang

GO = {
    "go.mod": "module m\n\ngo 1.22\n",
    "main.go": 'package main\n\nimport "m/store"\n\nfunc main() {\n\tstore.Open("a", 1)\n\tstore.Open("b", 1)\n\tstore.Open("c", 1)\n\ts := &store.Store{}\n\ts.Get("x")\n}\n',
    "store/store.go": """package store

// Store keeps things.
type Store struct {
	Name  string
	inner *disk
}

type disk struct{}

func (d *disk) Get(k string) string { return k }

func (s *Store) Get(k string) string { return s.inner.Get(k) }
func (s *Store) Put(k string) string { return s.inner.Put(k) }
func (s *Store) Del(k string) string { return s.inner.Del(k) }

func Open(name string, mode int) *Store {
	if name == "" && mode > 0 {
		return nil
	}
	return pass(name, mode)
}

func pass(name string, mode int) *Store { return made(name, mode) }

func made(name string, mode int) *Store {
	x := name
	for i := 0; i < mode; i++ {
		x += name
	}
	return &Store{Name: x}
}

func unused() {}

var help = `one
two
three`
""",
    "store/store_test.go": 'package store\n\nimport "testing"\n\nfunc TestOpen(t *testing.T) { Open("t", 9) }\n',
    "vendor/v/v.go": "package v\nfunc V() {}\n",
    "sub/go.mod": "module other\n",
    "sub/x.go": "package x\nfunc X() {}\n",
    "tools/pyproject.toml": '[project]\nname = "tools"\n',
    "tools/app.py": "# code generated by x\nfrom lib import helper\n\n\ndef run(a):\n    return helper(a)\n",
    "tools/lib.py": "def helper(x):\n    if x:\n        return 1\n    return 2\n\n\ndef lone():\n    return 3\n",
}


def commit(repo, files, said, when):
    for path, text in files.items():
        at = repo / path
        if text is None:
            at.unlink()
        else:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "PATH": "/usr/bin:/bin", "HOME": str(repo)}
    for args in (["add", "-A"], ["-c", "user.name=n", "-c", "user.email=e@e", "commit", "-qm", said]):
        subprocess.run(["git", "-C", str(repo), *args], check=True, env=env)
    return git.head(str(repo))


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    subprocess.run(["git", "init", "-q", "-b", "main", str(at)], check=True)
    commit(at, GO, "first", "2026-01-01T10:00:00Z")
    return at


def found(df):
    return {(r.rule, r.subject): r for r in df.collect()}


def test_go_facts_from_tokens():
    rows = {r[2]: dict(zip(golang.COLUMNS, r, strict=True)) for r in golang.rows("store/store.go", GO["store/store.go"], "m")}
    assert set(rows) == {"Store", "disk", "disk.Get", "Store.Get", "Store.Put", "Store.Del", "Open", "pass", "made", "unused", "help"}
    s = rows["Store"]
    assert (s["pkg"], s["kind"], s["start_line"], s["end_line"], s["lines"], s["signature"], s["exported"]) == ("m/store", "type", 3, 7, 4, "struct{Name string}", True)
    assert (rows["Store.Get"]["delegates"], rows["Store.Get"]["forwards"], rows["pass"]["forwards"]) == ("inner", "s.inner.Get", "made")
    assert (rows["Open"]["complexity"], rows["Open"]["nesting"], rows["Open"]["params"], rows["made"]["complexity"]) == (3, 1, 2, 2)
    assert rows["help"]["data"] and rows["help"]["lines"] == 1 and not rows["disk.Get"]["exported"]
    text = GO["store/store.go"]
    moved = {r[2]: r[14] for r in golang.rows("store/store.go", "// a comment\n" + text.replace("\treturn nil", "\t\treturn nil // why"), "m")}
    assert all(moved[n] == r["shape"] for n, r in rows.items())
    assert list(golang.rows("x.go", "no go", "m"))[0][20] == "no package clause"


def test_go_tokens_and_generics():
    text = "package p\n\ntype G[K comparable, V any] struct{ m map[K]V }\n\nfunc (g *G[K, V]) At(k K, more ...V) (V, bool) {\n\tswitch {\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\treturn g.m[k], true\n}\n\nconst (\n\tA, B = 'x', \"}{\"\n\tC // same\n)\n\nfunc F(func(int) (string, error), *int) {}\n\n/* Deprecated: no */\nfunc Old() { New() }\n"
    rows = {r[2]: dict(zip(golang.COLUMNS, r, strict=True)) for r in golang.rows("p/p.go", text, "m")}
    assert set(rows) == {"G", "G.At", "A", "C", "F", "Old"} and rows["G.At"]["complexity"] == 2 and rows["G.At"]["params"] == 2 and rows["G.At"]["variadic"]
    assert rows["Old"]["deprecated"] and rows["Old"]["forwards"] == "" and rows["F"]["params"] == 2


def test_roots_and_detection(spark, repo):
    p = Project(spark, str(repo))
    assert p.roots() == [(".", "go"), ("sub", "go"), ("tools", "python")] == p.roots("HEAD")
    paths = ["a/Project.toml", "b/go.mod", "b/Project.toml", "b/package.json", "_x/go.mod", ".h/go.mod", "c/testdata/d/go.mod", "setup.py", "e/tsconfig.json", "f/main.go"]
    got = [tuple(r) for r in frontends.roots(spark.createDataFrame([(x,) for x in paths], "path string")).collect()]
    assert got == [(".", "python"), ("a", "julia"), ("b", "go"), ("b", "typescript"), ("e", "typescript")]
    assert frontends.detect({"go.mod", "Project.toml"}) == "go" and frontends.detect({"x"}) == ""
    with pytest.raises(frontends.NoProject):
        p.produce(root="store")
    p.close()


def test_findings_of_a_go_project(spark, repo):
    p = Project(spark, str(repo))
    snap = p.produce()
    g = snap.graph
    decls = {r.id: r for r in g.decls.collect()}
    assert "m/store.Open" in decls and "m.main" in decls and not any("vendor" in d or "other" in d for d in decls)
    assert {(r.src, r.dst) for r in g.edges.collect()} >= {("m.main", "m/store.Open"), ("m/store.Open", "m/store.pass"), ("m/store.TestOpen", "m/store.Open")}
    assert [tuple(r) for r in g.imports.collect()] == [("m", "m/store")]
    o = decls["m/store.Open"]
    assert (o.calls, o.escapes, o.fixed_param, o.fixed_value) == (3, False, "mode", "1")
    f = found(snap.findings)
    assert ("pass-through", "pass") in f and ("dead-code", "unused") in f
    assert f["middle-man", "Store"].detail == "3 of 3 methods only call inner's"
    assert ("fixed-arg", "Open") not in f  # others may import the package
    inner = {x.replace("store/", "internal/store/", 1): t.replace('"m/store"', '"m/internal/store"') for x, t in GO.items() if "/" not in x or x.startswith("store/")}
    again = frontends.load(spark.createDataFrame([(x, bytearray(t.encode())) for x, t in inner.items()], "path string, content binary"), "m")
    assert found(smells.union(again))["fixed-arg", "Open"].detail == "mode is 1 at all 3 production call sites"
    files = {r.path: r for r in g.files.collect()}
    assert files["store/store.go"].churn == 1 and files["store/store_test.go"].test and files["store/store.go"].lines == 26
    py = p.produce(root="tools").graph
    assert {r.name for r in py.decls.collect()} == {"run", "helper", "lone"} and {r.path for r in py.files.where("generated").collect()} == {"app.py"}
    assert [r.dst.split(".")[-1] for r in py.edges.collect()] == ["helper"]
    p.close()


def test_compare_and_store(spark, repo, tmp_path):
    first = git.head(str(repo))
    text = GO["store/store.go"].replace("x += name", 'x += name + "!"').replace("func unused() {}\n", "")
    second = commit(repo, {"store/store.go": text, "new/go.mod": "module n\n", "new/n.go": "package n\n\nfunc N() {}\n"}, "second", "2026-01-05T10:00:00Z")
    (repo / "store" / "extra.go").write_text("package store\n\nfunc Extra(a, b, c, d, e, f int) {}\n")
    p = Project(spark, str(repo), store=str(tmp_path / "store"))
    c = p.compare(first, second)
    assert {r.id for r in c.changes["removed"].collect()} == {"m/store.unused"} and [r.id for r in c.changes["changed"].collect()] == ["m/store.made"]
    assert {(r.change, r.rule, r.subject) for r in c.changes["findings_delta"].collect()} == {("fixed", "dead-code", "unused")}
    units = {r.id: r for r in c.units.collect()}
    assert units["m/store.made"].change == "modified" and units["m/store.unused"].change == "removed"
    w = p.review(second)
    assert {r.id for r in w.changes["added"].collect()} == {"m/store.Extra"} and {r.new_path for r in w.files.where("status = 'added'").collect()} == {"store/extra.go"}
    assert ("introduced", "many-params") in {(r.change, r.rule) for r in w.changes["findings_delta"].collect()}
    assert {r.id: r.lane for r in w.units.collect()}["m/store.Extra"] == 0
    loose = [r for r in w.units.collect() if r.kind == ""]
    assert loose == []
    n = p.compare(first, second, "new")
    assert [r.id for r in n.changes["added"].collect()] == ["n.N"] and n.base.graph.decls.count() == 0
    p.close()
    again = Project(spark, str(repo), store=str(tmp_path / "store"))
    old = again.snapshot(first)
    assert old.restored and old.graph.decls.count() == c.base.graph.decls.count() and old.findings.count() == c.base.findings.count()
    assert again.snapshot().restored
    (repo / "store" / "extra.go").write_text("package store\n")
    again.refresh()
    again.engine.get(("", "."))
    assert not again.snapshot().restored and not again.snapshot().graph.decls.where("name = 'Extra'").count()
    again.close()


def test_units_of_files_lines_and_moves(spark, repo):
    first = git.head(str(repo))
    moved = "func made(" + GO["store/store.go"].split("func made(")[1].split("\n\nfunc unused")[0]
    edited = moved.replace("made(", "built(").replace("return &Store{Name: x}", "y := x\n\treturn &Store{Name: y}")
    second = commit(repo, {
        "store/store.go": GO["store/store.go"].replace(moved + "\n", "").replace("package store\n", 'package store\n\nimport "os"\n') + "\nfunc help2() { os.Exit(1) }\n",
        "other/made.go": "package other\n\n" + moved + "\n", "other/gen.go": "// Code generated by x. DO NOT EDIT.\npackage other\n\nfunc G() {}\n",
        "go.mod": GO["go.mod"] + "// x\n", "go.sum": "x\n", "testdata/in.txt": "a\n", "pic.bin": "a\0b", "sub/x.go": "package x\n\n// more\nfunc X() {}\n", "sub/y_test.go": "package x\n", "README.md": "text\n" * 50, "sub/go.mod": "module other2\n",
    }, "second", "2026-01-05T10:00:00Z")
    p = Project(spark, str(repo))
    u = {r.id: r for r in p.compare(first, second).units.collect()}
    p.close()
    assert (u["m/other.made"].change, u["m/other.made"].lane, u["m/other.made"].risk, u["m/other.made"].reasons) == ("moved", 4, 0, "moved from store/store.go") and "m/store.made" not in u
    assert (u["store/store.go#file"].lane, u["store/store.go#file"].reasons, u["store/store.go#file"].added, u["store/store.go#file"].deleted) == (4, "imports and file-level lines", 1, 0)
    lanes = {"other/gen.go": (4, "generated"), "go.mod": (0, "dependencies"), "go.sum": (4, "checksums"), "testdata/in.txt": (2, "test fixture"), "sub/x.go": (4, "comments or layout only"), "sub/y_test.go": (2, "in another module"), "README.md": (3, ""), "sub/go.mod": (3, "dependencies; in another module")}
    assert {k: (u[k].lane, u[k].reasons) for k in lanes} == lanes
    assert (u["pic.bin"].reasons, u["pic.bin"].change, u["README.md"].risk, u["README.md"].added) == ("binary", "added", 10, 50)
    third = commit(repo, {"other/made.go": "package other\n", "store/built.go": "package store\n\n" + edited.replace("built(", "made(") + "\n"}, "third", "2026-01-06T10:00:00Z")
    q = Project(spark, str(repo))
    v = {r.id: r for r in q.compare(second, third).units.collect()}
    q.close()
    assert v["m/store.made"].change == "modified" and v["m/store.made"].reasons.startswith("moved from other/made.go") and (v["m/store.made"].added, v["m/store.made"].deleted) == (2, 1) and "m/other.made" not in v


def test_top_level_statements(spark, repo):
    first = git.head(str(repo))
    second = commit(repo, {"tools/lib.py": "import os\nprint(1)\n" + GO["tools/lib.py"], "tools/more.py": "# only\nfrom lib import (\n    helper,\n)\n\n\ndef more():\n    return 1\n"}, "second", "2026-01-05T10:00:00Z")
    p = Project(spark, str(repo))
    u = {r.id: r for r in p.compare(first, second, "tools").units.collect()}
    p.close()
    assert (u["lib.py#file"].lane, u["lib.py#file"].reasons, u["lib.py#file"].added) == (1, "top-level statements", 2) and u["more.py#file"].lane == 4


def test_git_reads_trees_and_untracked_files(spark, repo):
    (repo / "bin").write_bytes(b"a\0b")
    (repo / "link").symlink_to("main.go")
    (repo / "empty").write_text("")
    (repo / "é x.txt").write_text("one\ntwo")
    at = {r.new_path: r for r in git.diff(spark, str(repo), "HEAD").collect()}
    assert at["bin"].binary and at["link"].hunks == [] == at["empty"].hunks and at["é x.txt"].hunks[0].new_lines == 2 and not at["é x.txt"].binary
    assert git.content(str(repo), "link") == b"main.go" and git.content(str(repo), "store") is None
    assert git.default_base(str(repo)) == "main" and git.merge_base(str(repo), "main") == git.head(str(repo)) and git.resolve(str(repo), "nope") == ""
    tree = {r.path: bytes(r.content).decode() for r in git.tree(spark, str(repo), "HEAD", "store").collect()}
    assert tree["store.go"] == GO["store/store.go"] and len(tree) == 2
    assert list(diffs.parse('diff --git "a/\\303\\251 x" "b/q\\"\\\\.txt"\nsimilarity index 90%\nrename from "\\303\\251 x"\nrename to "q\\"\\\\.txt"\n'))[0][:3] == ("é x", 'q"\\.txt', "renamed")


def test_engine_keeps_leased_values_and_runs_urgent_loads_first():
    from graphloom.plans.engine import Engine

    import threading

    gate, order, freed, pools = threading.Event(), [], [], []

    def load(key):
        order.append(key)
        if key == "first":
            gate.wait(5)
        return [key]

    e = Engine(load, freed.append, workers=1, enter=pools.append)
    flight = threading.Thread(target=e.get, args=("first",))
    flight.start()
    while not order:
        pass
    e.warm("cold")
    e.warm("warmed")
    got = []
    urgent = threading.Thread(target=lambda: got.append(e.lease("warmed")))
    urgent.start()
    while len(e._waiting) < 3:
        pass
    gate.set()
    flight.join()
    urgent.join()
    assert got == [["warmed"]]
    e.get("cold")
    assert order == ["first", "warmed", "cold"] and pools == ["urgent", "urgent", "warm"]
    e.refresh("warmed")
    new = e.get("warmed")
    assert new is not got[0] and freed == []
    e.done("warmed", got[0])
    assert freed == [["warmed"]] and freed[0] is got[0]
    e.close()
