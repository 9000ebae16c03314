"""Many roots in one stream, added and removed while it runs."""

import time

from graphloom.streaming import roots


def test_roots_come_and_go(spark, tmp_path):
    table, seen = str(tmp_path / "table"), []
    at = {n: tmp_path / n for n in "abc"}
    for p in at.values():
        p.mkdir()
        (p / "x.go").write_text("package x\n")
    names = {str(p): n for n, p in at.items()}

    def until(wanted, limit=90.0):
        end = time.time() + limit
        while time.time() < end and not wanted():
            time.sleep(0.1)
        assert wanted(), seen

    roots.set_root(table, str(at["a"]), True)
    roots.set_root(table, str(at["b"]), True)
    assert [names[r] for r in roots.read_roots(table)] == ["a", "b"]
    q = roots.watch(spark, table, str(tmp_path / "ckpt"), lambda found, n: seen.extend(names[r] for r in found), every=1.0)
    try:
        until(lambda: sorted(seen) == ["a", "b"])
        (at["a"] / "y.py").write_text("x = 1\n")
        until(lambda: seen.count("a") == 2)
        (at["a"] / "notes.txt").write_text("not watched")
        roots.set_root(table, str(at["c"]), True)
        until(lambda: "c" in seen)
        roots.set_root(table, str(at["b"]), False)
        time.sleep(2)
        (at["b"] / "z.rs").write_text("fn z() {}\n")
        (at["c"] / "z.rs").write_text("fn z() {}\n")
        until(lambda: seen.count("c") == 2)
        assert seen.count("b") == 1 and seen.count("a") == 2 and q.isActive
    finally:
        q.stop()
