"""Findings from changed files alone against a full run after every batch."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import smells
from graphloom.sources import frontends
from graphloom.streaming.incremental import Incremental


def full(spark, tree):
    files = [("pyproject.toml", bytearray(b'[project]\nname = "app"\n')), *((p, bytearray(t.encode())) for p, t in tree.items())]
    g = frontends.load(spark.createDataFrame(files, "path string, content binary"), "app")
    return rows(smells.union(g))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


LONG = "def long(a, b, c, d, e, f):\n" + "".join(f"    if a > {i}:\n        b = {i}\n" for i in range(45)) + "    return b\n"
START = {
    "app/__init__.py": "",
    "app/core/__init__.py": "",
    "app/core/base.py": "LIMIT = 3\n\n\ndef helper(x):\n    return x\n\n\ndef _unused():\n    return 1\n\n\ndef quiet():\n    return 2\n",
    "app/web/__init__.py": "",
    "app/web/view.py": "from app.core.base import helper, LIMIT\n\n\ndef show():\n    return helper(LIMIT)\n\n\ndef _inner():\n    return show()\n",
    "app/util/__init__.py": "",
    "app/util/tools.py": "def other():\n    return 5\n",
    "tests/test_view.py": "from app.web.view import show\n\n\ndef test_show():\n    assert show()\n",
}
EDITS = [
    START,
    {"app/core/base.py": START["app/core/base.py"] + LONG},  # a declaration more
    {"app/core/base.py": START["app/core/base.py"].replace("helper", "renamed")},  # a name that another file uses is gone
    {
        "app/web/view.py": START["app/web/view.py"].replace("helper", "renamed") + "\n\ndef late():\n    return _unused()\n",
        "app/util/tools.py": "from app.core.base import quiet\n\n\ndef other():\n    return quiet()\n\n\ndef helper(x):\n    return other()\n",
    },
    {"app/web/more.py": "from app.util.tools import helper, other\nfrom app.core.base import quiet\n\n\ndef show():\n    return helper(other()) + quiet() + helper(1) + helper(2)\n", "tests/test_view.py": None},  # a name twice in a package
    {"app/core/base.py": None, "app/bad.py": "def broken(:\n"},  # a module is gone
    {"app/core/base.py": START["app/core/base.py"], "app/web/view.py": None, "app/web/more.py": "# Code generated by x. DO NOT EDIT.\ndef show():\n    return 1\n"},
]


def test_every_batch_equals_a_full_run(spark, tmp_path):
    kept, tree = Incremental(spark, str(tmp_path / "kept"), "app"), {}
    for n, edit in enumerate(EDITS):
        kept.apply(n, spark.createDataFrame(list(edit.items()), "path string, text string"))
        tree = {p: t for p, t in (tree | edit).items() if t is not None}
        assert rows(kept.findings()) == full(spark, tree), n
    judged = spark.read.parquet(str(tmp_path / "kept" / "judged"))
    per = {r.batch: r["count"] for r in judged.groupBy("batch").count().collect()}
    assert per[1] == 1 and per[2] < per[0]  # batches judge the packages that they touch
    assert spark.read.parquet(str(tmp_path / "kept" / "rows" / "batch=1")).select("path").distinct().count() == 1
    kept.compact(100)
    assert rows(kept.findings()) == full(spark, tree) and rows(kept.findings(100)) == rows(kept.findings())


def test_a_batch_that_was_killed_is_run_again(spark, tmp_path, monkeypatch):
    kept, tree = Incremental(spark, str(tmp_path / "kept"), "app"), dict(START)
    kept.apply(0, spark.createDataFrame(list(START.items()), "path string, text string"))
    edit = {"app/core/base.py": START["app/core/base.py"].replace("helper", "renamed") + LONG, "app/util/tools.py": None}
    write, written = Incremental._write, []

    def dies(self, name, batch, df):
        if len(written) == 4:
            raise OSError("killed")
        written.append(name)
        write(self, name, batch, df)

    changed = spark.createDataFrame(list(edit.items()), "path string, text string")
    monkeypatch.setattr(Incremental, "_write", dies)
    with pytest.raises(OSError, match="killed"):
        kept.apply(1, changed)
    monkeypatch.setattr(Incremental, "_write", write)
    assert rows(kept.findings(1)) == full(spark, tree)  # what was before the batch still stands
    Incremental(spark, str(tmp_path / "kept"), "app").apply(1, changed)
    assert rows(kept.findings()) == full(spark, {p: t for p, t in (tree | edit).items() if t is not None})


def test_a_stream_of_edits_goes_on_after_a_stop(spark, tmp_path):
    at, source = str(tmp_path / "kept"), tmp_path / "edits"
    schema, tree, n = "n bigint, path string, text string", {}, 0
    spark.createDataFrame([], schema).write.mode("append").json(str(source))
    for edit in EDITS[:3]:
        spark.createDataFrame([(n + k, p, t) for k, (p, t) in enumerate(edit.items())], schema).coalesce(1).write.mode("append").json(str(source))
        n += len(edit)
        tree = {p: t for p, t in (tree | edit).items() if t is not None}
        kept = Incremental(spark, at, "app")
        q = kept.follow(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "ckpt"))
        q.processAllAvailable()
        q.stop()
        assert rows(kept.findings()) == full(spark, tree)


def test_a_live_folder(spark, tmp_path):
    root, done = tmp_path / "src", []
    for p, t in START.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    kept = Incremental(spark, str(tmp_path / "kept"), "app")
    q = kept.watch(str(root), str(tmp_path / "ckpt"), "200 milliseconds", after=done.append)
    try:
        q.processAllAvailable()
        assert rows(kept.findings()) == full(spark, START)
        (root / "app/core/base.py").write_text(START["app/core/base.py"] + LONG)
        (root / "app/util/tools.py").unlink()
        for _ in range(600):
            time.sleep(0.1)
            if len(done) > 1:
                break
        q.processAllAvailable()
    finally:
        q.stop()
    tree = {**START, "app/core/base.py": START["app/core/base.py"] + LONG}
    del tree["app/util/tools.py"]
    assert rows(kept.findings()) == full(spark, tree)
    last = spark.read.parquet(str(tmp_path / "kept" / "paths")).where(F.col("batch") > 0).select("path").distinct().collect()
    assert {r.path for r in last} == {"app/core/base.py", "app/util/tools.py"}
