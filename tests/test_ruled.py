"""Operators behind the queries of rules: churn of streams, call sites, notes, hashes, digests, insets and watched files."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from graphloom.functions.hashes import changed_leaves, digest_tree, fnv1a64
from graphloom.operators import handoff, layout, sites
from graphloom.sources import diffs, frontends
from graphloom.streaming.live import Churn


def test_a_stream_of_commits_equals_the_batch_after_each_micro_batch(spark, tmp_path):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    schema = "repo string, sha string, ts timestamp, path string"
    log = [(f"r{rng.randrange(3)}", f"s{k}", start + timedelta(hours=rng.randrange(900)), f"f{rng.randrange(6)}") for k in range(240)]
    log.sort(key=lambda r: (r[2] + timedelta(hours=rng.choice([0, 0, 0, 200])), r[1]))  # some come late
    source, seen = tmp_path / "log", []
    kept = Churn(spark, str(tmp_path / "kept"), 7)
    for part in (log[:100], log[100:101], log[101:200], log[200:]):
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        kept.follow(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "ckpt")).awaitTermination()
        last = {r: max(t for x, _, t, _ in seen if x == r) for r, *_ in seen}
        want = {}
        for r, _, t, p in seen:
            if t >= last[r] - timedelta(days=7):
                want[r, p] = want.get((r, p), 0) + 1
        assert {(r.repo, r.path): r.churn for r in kept.now().collect()} == want
    assert sorted(map(tuple, diffs.windowed(spark.createDataFrame(seen, schema), 7).collect())) == sorted((*k, n) for k, n in want.items())
    kept.apply(3, spark.createDataFrame(log[200:], schema))  # a batch that is run again
    assert {(r.repo, r.path): r.churn for r in kept.now().collect()} == want


def test_call_sites(spark):
    text = [
        "func run(x int) int {", "  // helper does it", "  y := xhelper(x)", "  return a.helper(y) + helper(1)", "}", "# late", "func (T) again() {", "}",
        "def helper(a): return", "* helper", "pass",
    ]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text, 1)], "path string, line bigint, text string")
    decls = spark.createDataFrame(
        [("run", "run", "f", 1, 5), ("again", "T.again", "f", 6, 8), ("own", "helper", "f", 9, 11), ("far", "far", "f", 9, 99), ("gone", "gone", "g", 1, 2), ("h", "M.helper", "x", 1, 1), ("T", "T", "x", 1, 1), ("z", "zebra", "x", 1, 1)],
        "id string, name string, path string, start_line bigint, end_line bigint",
    )
    calls = spark.createDataFrame([("run", "h"), ("run", "z"), ("again", "T"), ("own", "h"), ("far", "h"), ("gone", "h")], "src string, dst string")
    got = {(r.src, r.dst): tuple(r)[2:] for r in sites.call_sites(lines, decls, calls).collect()}
    assert got == {
        ("run", "h"): (4, True, 2, 5), ("run", "z"): (1, False, 1, 5), ("again", "T"): (7, True, 6, 8), ("own", "h"): (9, False, 9, 11), ("far", "h"): (9, False, None, None), ("gone", "h"): (1, False, None, None),
    }


def test_notes_are_current_outdated_or_stray(spark):
    rows = [
        ("unit", "pr:1@a", ".", False, "u@1", "f", "+", 1, ""), ("lost unit", "pr:1@b", ".", False, "u@0", "f", "+", 1, ""), ("line", "pr:1@a", ".", False, "", "f", "+", 2, "same"), ("edited", "pr:1@a", ".", False, "", "f", "-", 2, "was"),
        ("no text", "pr:1@a", ".", False, "", "f", "+", 9, ""), ("gone line", "pr:1@a", ".", False, "", "f", "+", 9, "x"), ("done", "pr:1@a", ".", True, "", "f", "+", 2, ""), ("other", "pr:2@a", ".", False, "", "f", "+", 2, ""), ("inner", "pr:1@a", "in", False, "", "f", "+", 2, ""),
    ]
    notes = spark.createDataFrame(rows, "id string, scope string, root string, resolved boolean, unit_key string, file string, side string, line bigint, text string")
    lines = spark.createDataFrame([("f", "+", 2, "same"), ("f", "-", 2, "is")], "file string, side string, line bigint, text string")
    shown = spark.createDataFrame([("f", "+", 1), ("f", "+", 2)], "file string, side string, line bigint")
    got = sites.notes_on(notes, spark.createDataFrame([("u@1",)], "unit_key string"), lines, shown, "pr:1@c", ".")
    assert {r.id: (r.status, r.stray) for r in got.collect()} == {"unit": ("current", False), "lost unit": ("outdated", False), "line": ("current", False), "edited": ("outdated", True), "no text": ("stray", True), "gone line": ("outdated", True)}


def test_fnv_of_known_texts(spark):
    want = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}

    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:x}"

    texts = [*want, "é\0日", "x" * 300, *(f"key{i}" for i in range(400))]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a64(F.col("t")).alias("f")).collect()}
    assert got == {t: plain(t) for t in texts} and {t: got[t] for t in want} == want


def test_one_changed_file_is_found_from_the_root_down(spark):
    old = spark.range(20_000).select(F.concat(F.lit("d/f"), "id").alias("path"), (F.col("id") % 7).alias("size"))
    new = old.withColumn("size", F.when(F.col("path") == "d/f77", 99).otherwise(F.col("size"))).where("path <> 'd/f78'").repartition(3)
    trees = [digest_tree(t, [], "path", F.concat_ws(" ", "path", "size")) for t in (old, new)]
    leaves = {r.node for r in changed_leaves(*trees, []).collect()}
    hashed = {r.path: r.h for r in old.where("path in ('d/f77', 'd/f78')").select("path", F.substr(F.sha2("path", 256), F.lit(1), F.lit(4)).alias("h")).collect()}
    assert leaves == set(hashed.values())
    assert changed_leaves(trees[0], trees[0], []).count() == 0


def test_small_rules(spark):
    d = spark.createDataFrame([(10.0, 20.0, 100.0, 6.0), (0.0, 0.0, 4.0, 50.0)], "x double, y double, w double, h double")
    out = d.select(*layout.inset(*map(F.col, "xywh"), F.lit(3.0)))
    assert [tuple(r) for r in out.collect()] == [(13.0, 23.0, 94.0, 0.0), (2.0, 3.0, 0.0, 44.0)]
    scopes = {"wt": "working tree", "commit:abc": "commit abc", "pr:12@a@b": "PR #12 at a@b", "pr:3": "PR #3 at ", "x": "x"}
    got = spark.createDataFrame([(s,) for s in scopes], "s string").select("s", handoff.scope_text(F.col("s")).alias("t"))
    assert {r.s: r.t for r in got.collect()} == scopes
    paths = {"a.go": True, "x/go.mod": True, "x/go.mod.bak": False, "web/a.mts": True, ".x/a.ts": False, "a/.b/c.py": False, "_a/b.rs": True, "vendor/a.go": False, "README.md": False, "b/testdata/x.go": False, "c.toml": False, "Cargo.lock": True}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", frontends.watched(F.col("path")).alias("w"))
    assert {r.path: r.w for r in got.collect()} == paths
