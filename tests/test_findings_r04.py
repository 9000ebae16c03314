"""What the fourth round's reviewer found, on small inputs."""

import re

import __spark_entry__ as entry
from graphloom.operators import linking
from graphloom.plans import linked
from graphloom.plans.checkpoints import stored
from graphloom.sources.binding import bound


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_by_name_broadcast_no_declarations(spark, sf):
    plan = _plan(entry.queries()["jn07_named_links"](spark, sf))
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all(re.search(r"\[pkg#\d+, pkg#\d+\], \[src#\d+, dst#\d+\]", j) for j in sent)  # imports, of which there is one for two packages
    assert "BroadcastHashJoin" not in _plan(bound(spark, sf).kept("decls", "edges").imports)


def test_specifiers_broadcast_no_declarations(spark, sf):
    assert not re.search(r"BroadcastHashJoin \[\w+#\d+\], \[id#", _plan(entry.queries()["src15_import_files"](spark, sf)))
    assert "BroadcastHashJoin" not in _plan(linked._specs(bound(spark, sf).kept("decls", "edges")))


def test_names_are_not_broadcast(spark):
    refs = spark.createDataFrame([("a", "x", False, "f", "p", "n", "caller")], "src string, own string, own_member boolean, path string, pkg string, short string, kind string")
    decls = spark.createDataFrame([("b", "n", "q", "g", True, False), ("c", "n", "r", "h", True, False)], "dst string, short string, to string, at string, exported boolean, member boolean")
    got = linking.named(refs, stored(decls), spark.createDataFrame([("f", "q")], "path string, to string"))
    assert "BroadcastHashJoin" not in _plan(got)
    assert [tuple(r) for r in got.collect()] == [("a", "b", "caller")]
