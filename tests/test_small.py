import json
import subprocess

import pytest

from graphloom.sources import store
from graphloom.sources.small import Baskets, Notes, Registry, parse_url, repo_id
from graphloom.streaming.events import Bus, Fresh


def test_notes_and_rows(tmp_path):
    n = Notes(str(tmp_path / "x" / "notes.json"))
    assert n.all() == []
    a, b = n.add({"text": "one", "resolved": False}), n.add({"text": "two", "resolved": False})
    n.resolve(a["id"])
    assert [(r["text"], r["resolved"]) for r in Notes(n.path).all()] == [("one", True), ("two", False)]
    n.resolve(a["id"], False)
    n.put(b | {"text": "2"})
    assert n.get(b["id"])["text"] == "2" and not n.get(a["id"])["resolved"] and n.get("?") is None
    n.delete(a["id"])
    n.delete("?")
    assert [r["text"] for r in n.all()] == ["2"]
    with pytest.raises(KeyError):
        n.resolve("?")


def test_baskets(tmp_path):
    b = Baskets(str(tmp_path / "b.json"))
    assert all(b.add("x", {"key": k}) for k in "abcd") and not b.add("x", {"key": "b", "more": 1})
    keys = lambda: "".join(x["key"] for x in b.get("x")["items"])
    for key, to, want in (("a", 2, "bcad"), ("d", -3, "dbca"), ("d", 99, "bcad"), ("?", 0, "bcad")):
        b.move("x", key, to)
        assert keys() == want
    b.remove("x", "c")
    b.introduce("x", "do this")
    assert keys() == "bad" and b.get("x")["intro"] == "do this" and b.get("y") == {"intro": "", "items": []}


def test_registry(tmp_path):
    urls = {"https://github.com/o/n.git": ("github.com", "o", "n"), "git@h.org:o/n": ("h.org", "o", "n"), "ssh://u@h:22/n/": ("h", "_", "n"), "file:///a/b": ("local", "a", "b"), "/a/b": None, "a@b/c:d": None, "https://h/": None}
    assert {u: parse_url(u) for u in urls} == urls
    assert repo_id("My Repo!", "k").startswith("my-repo-") and repo_id("中", "k").startswith("repo-") and len(repo_id("a", "k")) == 8
    origin = tmp_path / "origin" / "top"
    subprocess.run(["git", "init", "-q", str(origin)], check=True)
    r = Registry(str(tmp_path / "r.json"), str(tmp_path / "clones"))
    local, url = r.register(str(origin)), r.register(f"file://{origin}")
    assert r.register(str(origin)) == local and local["path"] == str(origin) and (tmp_path / "clones" / "local" / "origin" / "top" / ".git").exists()
    r.forget(url["id"])
    r.forget(local["id"])
    assert r.all() == [] and origin.exists() and not (tmp_path / "clones" / "local" / "origin" / "top").exists()
    with pytest.raises(ValueError):
        r.register("https://h/../n")


def test_bus_and_fresh_values():
    bus, now, loads = Bus(), [0.0], []
    with bus.listen("a") as q, bus.listen("a") as p:
        for _ in range(3):
            bus.publish("a")
        bus.publish("b")
        assert q.get(timeout=1) == "a" and q.empty() and p.qsize() == 1
    bus.publish("a")
    assert not bus._topics

    def load(key):
        loads.append(key)
        if len(loads) == 3:
            raise RuntimeError
        return len(loads)

    f = Fresh(load, 60, lambda: now[0])
    assert (f.get("k"), f.get("k")) == (1, 1)
    now[0] = 61
    assert f.get("k") == 2
    now[0] = 200
    assert f.get("k") == 2 and f.get("k") == 2 and len(loads) == 3
    f.drop("k")
    assert f.get("k") == 4


def test_julia_json(spark, tmp_path):
    decl = lambda name, module, file, refs, **more: {"Name": name, "Kind": "func", "Module": module, "File": file, "Test": False, "Lines": 2, "Start": 1, "End": 2, "Params": 1, "Complexity": 1, "Nesting": 0, "Sig": "()", "Args": "", "Shape": "s", "Refs": refs} | more
    (tmp_path / "j.json").write_text(json.dumps({
        "Module": "P", "Aliases": {}, "Modules": [{"Path": "P", "Exports": ["run"], "Imports": ["Q", "Base"], "Errors": []}, {"Path": "P.Help", "Exports": [], "Imports": [], "Errors": []}, {"Path": "Q", "Exports": ["go"], "Imports": [], "Errors": []}],
        "Files": [{"Path": "src/P.jl", "Module": "P", "Test": False, "Lines": 9}, {"Path": "src/Q.jl", "Module": "Q", "Test": False, "Lines": 3}],
        "Decls": [decl("run", "P", "src/P.jl", ["go", "icon", "nothing"]), decl("run", "P", "src/P.jl", ["Q.go"], Start=5, End=6), decl("icon", "P.Help", "src/P.jl", []), decl("go", "Q", "src/Q.jl", ["run"])],
    }))
    decls, edges, files, imports = store.julia_json(spark, str(tmp_path / "j.json"))
    assert {r.id: (r.pkg, r.name, r.exported) for r in decls.collect()} == {"P.run": ("P", "run", True), "P.run#2": ("P", "run", True), "P.Help.icon": ("P", "Help.icon", False), "Q.go": ("Q", "go", True)}
    assert {(r.src, r.dst) for r in edges.collect()} == {("P.run", "Q.go"), ("P.run", "P.Help.icon"), ("P.run#2", "Q.go")}
    assert [tuple(r) for r in imports.collect()] == [("P", "Q")] and files.count() == 2


def test_pull_requests(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"number": 3, "title": "t", "author": {"login": "a"}, "headRefName": "h", "baseRefName": "b", "isDraft": True, "updatedAt": "2026-01-01T00:00:00Z", "additions": 4}]))
    r = store.pull_requests(spark, str(tmp_path / "p.json")).first()
    assert (r.number, r.author, r.head, r.base, r.draft, r.added, r.deleted) == (3, "a", "h", "b", True, 4, None)
