import json
import time

from graphloom.operators import handoff, layout, review
from graphloom.plans.engine import Engine
from graphloom.sources import diffs, python_code, store
from graphloom.streaming.live import Epochs, fingerprint, watch

DESK = """import math
from lib.fees.late import late
from .loan import Loan, DAYS


class Desk(Base):
    limit = 3

    @property
    def full(self) -> bool:
        return self.count >= self.limit

    def lend(self, x: Loan, *more: Loan):
        # a comment
        settle([x], today=DAYS)


async def settle(loans, *, today=0):
    "What a reader owes."
    owed = 0
    while loans:
        x = loans.pop()
        try:
            if x and x.due < today or today < 0:
                owed += late(x)
        except KeyError:
            owed = max(o for o in [owed] if o)
    return owed


def _hidden():
    return math.pi
"""
FILES = {
    "lib/desk.py": DESK,
    "lib/loan.py": "DAYS = 30\n_INNER: int = 1\nlower = 2\n\n\nclass Loan:\n    due = 0\n",
    "lib/tests/check.py": "from lib.desk import settle\n\n\ndef check():\n    return settle([])\n",
    "lib/fees/late.py": "from x import deprecated\n\n\n@deprecated(\"x\")\ndef late(x, rate=1):\n    return rate if x.due else 0\n",
    "lib/broken.py": "def (:\n",
}


def test_python_frontend(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    found = python_code.extract(files, "app").persist()
    decls, edges, imports = python_code.link(found)
    d = {r.id: r for r in decls.collect()}
    s = d["lib.settle"]
    assert (s.kind, s.exported, s.test, s.start_line, s.end_line, s.complexity, s.nesting, s.params) == ("func", True, False, 18, 28, 8, 3, 2)
    assert s.lines == 11 and not d["lib._hidden"].exported and d["lib.Desk.lend"].kind == "method" and d["lib.Desk.lend"].params == 2 and d["lib.Desk.full"].params == 0
    assert d["lib.Desk.lend"].lines == 2 and d["lib.Desk.full"].start_line == 9
    assert d["lib.DAYS"].kind == "const" and not d["lib._INNER"].exported and "lib.lower" not in d and d["lib.tests.check"].test
    late = d["lib.fees.late"]
    assert (late.deprecated, late.start_line, late.complexity, late.params) == (True, 4, 2, 2)
    e = {(r.src, r.dst, r.kind) for r in edges.collect()}
    assert {s for s, t, k in e if t == "lib.settle" and k == "caller"} == {"lib.Desk.lend", "lib.tests.check"}
    assert {s for s, t, k in e if t == "lib.fees.late"} == {"lib.settle"} and ("lib.Desk.lend", "lib.Loan", "user") in e and ("lib.Desk.lend", "lib.DAYS", "caller") in e
    assert {tuple(r) for r in imports.collect()} == {("lib", "lib.fees")}
    assert found.where("error <> ''").select("path").collect()[0].path == "lib/broken.py"


DIFF = """diff --git a/x.go b/x.go
index 1..2 100644
--- a/x.go
+++ b/x.go
@@ -3 +3,2 @@ func f() {
-a
+b
+c
@@ -9,0 +11 @@
+d
diff --git a/new.txt b/new.txt
new file mode 100644
--- /dev/null
+++ b/new.txt
@@ -0,0 +1 @@
+@@ -1 +1 @@
diff --git a/old.bin b/old.bin
deleted file mode 100644
Binary files a/old.bin and /dev/null differ
diff --git a/p q.go b/r s.go
similarity index 90%
rename from p q.go
rename to r s.go
"""


def test_unified_diff(spark):
    files = diffs.file_diffs(spark.createDataFrame([("d", DIFF), ("e", None)], "diff_id string, text string")).persist()
    got = [(r.old_path, r.new_path, r.status, r.binary, len(r.hunks)) for r in files.collect()]
    assert got == [("x.go", "x.go", "modified", False, 2), ("", "new.txt", "added", False, 1), ("old.bin", "", "deleted", True, 0), ("p q.go", "r s.go", "renamed", False, 0)]
    assert sorted(tuple(r) for r in diffs.hunks(files, "new").collect()) == [("new.txt", 1, 1), ("x.go", 3, 2), ("x.go", 11, 1)]


def test_line_diff_puts_deletions_first():
    assert [x[0] for x in review.line_diff(list("abc"), list("axc"))] == [" ", "-", "+", " "]
    assert review.line_diff(["a"], [], 5, 9) == [("-", 5, 0, "a")]
    assert review.line_diff([], ["a", "b"], 1, 7)[1] == ("+", 0, 8, "b")


def test_diff_texts(spark):
    got = review.diff_texts(spark.createDataFrame([(1, "a\nb", "a\nc")], "key bigint, old_text string, new_text string")).orderBy("seq").collect()
    assert [(r.op, r.old, r.new, r.text) for r in got] == [(" ", 1, 1, "a"), ("-", 2, 0, "b"), ("+", 0, 2, "c")]


def test_treemap_of_extreme_weights():
    for weights in ([1e308, 1e308], [1e308, 1e-308, 5e-324], [1.0] * 3000):
        tiles = layout.squarify([(f"n{i}", w) for i, w in enumerate(weights)], 0, 0, 100, 50)
        assert len(tiles) == len(weights) and abs(sum(w * h for *_, w, h in tiles) - 5000) < 1e-6
    assert layout.squarify([("a", 1.0)], 0, 0, float("inf"), 1) == []


def test_treemap_invariants():
    import random

    items = [(f"n{i:02d}", w) for i, w in enumerate([500, 300, 200, 90, 80, 70, 60, 50, 40, 30, 20, 10, 5, 4, 3, 2, 1])] + [("zero", 0.0), ("nan", float("nan"))]
    tiles = layout.squarify(items, 10, 20, 1000, 600)
    assert len(tiles) == 17
    total, area = sum(w for _, w in items[:17]), 1000 * 600
    for i, x, y, w, h in tiles:
        assert abs(w * h - dict(items)[i] / total * area) < 1e-6 * area
        assert x >= 10 - 1e-9 and y >= 20 - 1e-9 and x + w <= 1010 + 1e-6 and y + h <= 620 + 1e-6
    for a in tiles:
        for b in tiles:
            if a[0] < b[0]:
                assert min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) < 1e-6 or min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]) < 1e-6
    assert sum(max(w / h, h / w) for *_, w, h in tiles) / 17 < 3
    for seed in range(10):
        other = items[:]
        random.Random(seed).shuffle(other)
        assert layout.squarify(other, 10, 20, 1000, 600) == tiles


def test_handoff_text(spark):
    schema = "basket string, pos int, repo string, repo_name string, kind string, title string, place_text string, scope string, body string, steps array<string>, check string, code array<string>"
    rows = [
        ("b", 1, "shop", "Shop", "prognosis", "Split it", "cart.go:42", "wt", "Three branches.", ["One.", "Two."], "Tests pass.", []),
        ("b", 2, "shop", "Shop", "finding", "Too complex", "cart.go:42", "pr:7@9f8e", "", [], "", ["a ```` b"]),
        ("b", 3, "blog", "Blog", "note", "Look", "", "commit:abc", "x", [], "", []),
    ]
    text = handoff.render(spark.createDataFrame(rows, schema)).first().text
    assert text.index("## Blog") < text.index("## Shop") < text.index("### Findings") < text.index("### Prognoses")
    assert "Scope: PR #7 at 9f8e" in text and "Scope: working tree" in text and "Scope: commit abc" in text
    assert "`````\na ```` b\n`````" in text and "1. One.\n2. Two." in text and handoff.fence(["`"]) == "```"


def test_stores(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    store.write_json(path, {"a": 1})
    assert store.read_json(path) == {"a": 1} and store.read_json(path + "?", []) == []
    at = str(tmp_path / "snap")
    df = spark.createDataFrame([("x", 1)], "id string, n int")
    store.save(df, at, "r", "root", "c1", "b1", 1)
    store.save(df.withColumn("n", df.n + 1), at, "r", "root", "c2", "b1", 2)
    assert store.load(spark, at, "r", "root", "c2", "b1").first().n == 2
    assert store.load(spark, at, "r", "root", "c2", "other") is None
    index = spark.createDataFrame([("r", "a", f"c{i}", i) for i in range(6)] + [("r", "a", "", 0)], "repo string, root string, rev string, used int")
    assert {r.rev for r in store.prunable(index).collect()} == {"c0", "c1"}
    basket = spark.createDataFrame([(i, k) for i, k in enumerate("abcd", 1)], "pos bigint, key string")
    for to, want in ((1, "cabd"), (3, "abcd"), (99, "abdc"), (-5, "cabd")):
        got = store.move(basket, "c", to).orderBy("pos").collect()
        assert "".join(r.key for r in got) == want
    lines = tmp_path / "s.json"
    lines.write_text(json.dumps({"id": "a.b", "name": "b", "lines": 3}) + "\n")
    assert store.snapshot_json(spark, str(lines)).first().lines == 3


def test_engine_shares_loads_and_keeps_stale_values():
    calls, fail = [], []
    gate = __import__("threading").Event()

    def load(key):
        calls.append(key)
        if key == "slow":
            gate.wait(5)
        if fail:
            raise RuntimeError("no")
        return f"{key}{len(calls)}"

    freed = []
    e = Engine(load, freed.append, capacity=2)
    a = [e._pool.submit(e.get, "slow") for _ in range(2)]
    time.sleep(0.1)
    gate.set()
    assert len({x.result() for x in a}) == 1 and calls.count("slow") == 1
    e.lease("a")
    e.get("b")
    e.get("c")
    assert "a" in e.cached() and len(e.cached()) <= 2 and freed
    fail.append(1)
    old = e.peek("a")[0]
    e.refresh("a")
    time.sleep(0.2)
    assert e.peek("a")[0] == old and e.peek("a")[1] == "no"
    e.close()


def test_live_folder(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    before = fingerprint(str(root))
    (root / "b.txt").write_text("not watched")
    assert fingerprint(str(root)) == before
    seen = []
    q = watch(spark, str(root), lambda at: spark.range(1), lambda at, df: seen.append(fingerprint(at)), str(tmp_path / "ckpt"), "200 milliseconds")
    try:
        end = time.time() + 60
        while len(seen) < 1 and time.time() < end:
            time.sleep(0.2)
        (root / "a.py").write_text("x = 22\n")
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.2)
        assert len(seen) >= 2 and seen[0] != seen[-1] == fingerprint(str(root))
    finally:
        q.stop()
    e = Epochs()
    assert e.bump("x") == 1 and e.current("x") == 1 and e.current("y") == 0


def test_line_diff_equals_a_plain_table():
    import random

    from graphloom.operators.review import line_diff

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                out.append((" ", 1 + i, 1 + j, a[i]))
                i, j = i + 1, j + 1
            elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
                out.append(("-", 1 + i, 0, a[i]))
                i += 1
            else:
                out.append(("+", 0, 1 + j, b[j]))
                j += 1
        return out

    r = random.Random(1)
    for _ in range(300):
        a, b = (r.choices("abcd", k=r.randint(0, 9)) for _ in range(2))
        assert line_diff(a, b) == plain(a, b)


def test_numbers_over_ranges(spark):
    from graphloom.functions.ordered import numbered
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("g")).repartition(7)
    got = {r.k: (r.pos, r.before) for r in numbered(df, [F.desc("g"), F.col("k")], running=F.col("k")).collect()}
    want, total = {}, 0
    for i, (g, k) in enumerate(sorted(((r.g, r.k) for r in df.collect()), key=lambda x: (-x[0], x[1])), 1):
        want[k] = (i, total)
        total += k
    assert got == want
    assert numbered(df.limit(0), [F.col("k")]).collect() == []
