"""Changes of several repositories over their roots: paths by root, readings, order and cards."""

import subprocess

from graphloom.operators import inbox
from graphloom.plans.project import Project
from tests.test_project import commit


def test_paths_belong_to_the_deepest_root(spark):
    files = spark.createDataFrame([("a.go", "a.go", 1), ("sub/x.go", "sub/deep/x.go", 2), ("", "sub/deep/y.go", 3), ("subway/z.go", "", 4), ("sub/deeper/q.go", "q.go", 5)], "old_path string, new_path string, k int")
    roots = spark.createDataFrame([(".",), ("sub",), ("sub/deep",), ("sub",)], "dir string")
    got = sorted(map(tuple, inbox.scoped(files, roots).collect()))
    assert got == [
        (".", "", "q.go", 5), (".", "a.go", "a.go", 1), (".", "subway/z.go", "", 4), ("sub", "deeper/q.go", "", 5), ("sub", "x.go", "", 2), ("sub/deep", "", "x.go", 2), ("sub/deep", "", "y.go", 3),
    ]
    assert [r.root for r in inbox.scoped(files, roots.where("dir = 'sub/deep'")).collect()] == ["sub/deep"] * 2
    assert inbox.scoped(files.limit(0), roots).count() == 0


UNITS, PLACE = "repo string, change string, root string, key string, lane bigint, risk bigint", "repo string, change string, root string"


def test_readings_and_order(spark):
    units = spark.createDataFrame([("r", "wt", ".", "a", 0, 3), ("r", "wt", "t", "b", 1, 9), ("r", "wt", "t", "c", 2, 1), ("r", "p1", ".", "a", 0, 3), ("s", "p1", ".", "n", 4, 0)], UNITS)
    introduced = spark.createDataFrame([("r", "wt", "."), ("r", "wt", "t")], PLACE)
    files = spark.createDataFrame([("r", "wt", ".", 5, 1), ("r", "wt", "t", 5, 1), ("r", "wt", "u", 5, 1), ("s", "p1", ".", 0, 2)], PLACE + ", added bigint, deleted bigint")
    reviewed = spark.createDataFrame([("r", "b"), ("r", "b"), ("s", "a")], "repo string, key string")
    read = inbox.readings(units, introduced, files, reviewed)
    got = {(r.repo, r.change): (r.units, r.done, r.contract, r.logic, r.max_risk, r.introduced, r.added, r.deleted, [tuple(x) for x in r.roots]) for r in read.collect()}
    assert got[("r", "wt")] == (3, 1, 1, 0, 9, 2, 5, 1, [(".", 1), ("t", 2), ("u", 0)])
    assert got[("r", "p1")] == (1, 0, 1, 0, 3, 0, 0, 0, [(".", 1)])
    assert got[("s", "p1")] == (1, 0, 0, 0, 0, 0, 0, 2, [(".", 1)])
    changes = spark.createDataFrame([("r", "wt", None), ("r", "p1", 1), ("s", "p1", 1), ("s", "p2", 2), ("s", "wt", None)], "repo string, change string, number bigint")
    repos = spark.createDataFrame([("r", "zoo"), ("s", "ant")], "repo string, name string")
    rows = inbox.inbox(changes, repos, read).orderBy("pos").collect()
    assert [(r.repo, r.change, r.ready, r.needs_reading) for r in rows] == [("r", "wt", True, True), ("r", "p1", True, True), ("s", "p1", True, False), ("s", "p2", False, False)]
    assert inbox.readings(units.limit(0), introduced.limit(0), files.limit(0), reviewed).count() == 0


def test_cards(spark):
    repos = spark.createDataFrame([("r", "zoo"), ("s", "ant")], "repo string, name string")
    roots = spark.createDataFrame([("r", "b", "go", False), ("r", "a", "rust", True), ("r", "c", "go", False)], "repo string, dir string, lang string, ready boolean")
    prognoses = spark.createDataFrame([("r", 3), ("r", 1), ("r", 1)], "repo string, level bigint")
    got = sorted(map(tuple, inbox.cards(repos, roots, prognoses, spark.createDataFrame([("s", 4)], "repo string, number int")).collect()))
    assert got == [("r", "zoo", ["rust (named)", "go (typed)"], True, 1, 0, 2, 0), ("s", "ant", [], False, 0, 0, 0, 1)]


def test_a_change_is_read_over_all_its_roots(spark, tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    subprocess.run(["git", "init", "-q", "-b", "main", str(at)], check=True)
    commit(at, {"go.mod": "module m\n", "m.go": "package m\n\nfunc F() {}\n", "sub/go.mod": "module s\n", "sub/s.go": "package s\n\nfunc G() {}\n"}, "first", "2026-01-01T10:00:00Z")
    (at / "sub/s.go").write_text("package s\n\nfunc G() { H() }\n\nfunc H() {}\n")
    p = Project(spark, str(at))
    (r,) = p.reading("HEAD").collect()
    p.close()
    assert [tuple(x) for x in r.roots] == [(".", 0), ("sub", 2)]
    assert (r.units, r.done, r.added, r.deleted) == (2, 0, 3, 1)
