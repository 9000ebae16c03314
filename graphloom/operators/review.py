"""Change units of a diff: what was touched, in which lane it belongs, and how risky it is to read past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import spans
from graphloom.functions.scalars import importable, plural
from graphloom.operators import graphdiff
from graphloom.sources.binding import Graph

CONTRACT, LOGIC, TESTS, OTHER, NOISE = range(5)
MAX_CELLS = 4_000_000


def overlap(start: Column, end: Column, at: Column, n: Column) -> Column:
    """Whether lines start..end meet a hunk of n lines at `at`; an empty hunk is the point after line `at`."""
    return F.when(n == 0, (start <= at) & (at + 1 <= end)).otherwise((at <= end) & (at + n - 1 >= start))


def touched(decls: DataFrame, hunks: DataFrame) -> DataFrame:
    """Ids of declarations that hunks (path, start, n) touch: an equi-join on blocks of a file's lines with the range as rest."""
    h = _hunk_blocks(hunks.withColumn("last", F.col("start") + F.greatest(F.col("n"), F.lit(2)) - 1))
    return _decl_blocks(decls).join(h, ["path", "block"]).where(overlap(F.col("start_line"), F.col("end_line"), F.col("at"), F.col("n"))).select("id").distinct()


def _decl_blocks(decls: DataFrame) -> DataFrame:
    return spans.by_block(decls.select("id", "path", "start_line", "end_line")).hint("merge")


def _hunk_blocks(hunks: DataFrame) -> DataFrame:
    """path, block, at and n of hunks (path, start, last, n)."""
    ends = hunks.select("path", F.col("start").alias("at"), "n", F.col("start").alias("start_line"), F.col("last").alias("end_line"))
    return spans.by_block(ends).select("path", "block", "at", "n")


def touched_lines(decls: DataFrame, hunks: DataFrame) -> DataFrame:
    """id and how many of a declaration's lines the hunks change."""
    h = _hunk_blocks(hunks.where("n > 0").withColumn("last", F.col("start") + F.col("n") - 1))
    # what a block has of both
    first = F.col("block") * spans.BLOCK
    low, high = F.greatest(F.col("start_line"), F.col("at"), first), F.least(F.col("end_line"), F.col("at") + F.col("n") - 1, first + spans.BLOCK - 1)
    return _decl_blocks(decls).join(h, ["path", "block"]).where(low <= high).groupBy("id").agg(F.sum(high - low + 1).alias("lines"))


def loose(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """Lines (path, line, text) that stand in no declaration and aren't blank or a package clause."""
    return spans.outside(lines.where((F.trim("text") != "") & ~F.col("text").startswith("package ")), decls)


def file_lane(path: Column, generated: Column, same_shape: Column) -> Column:
    """The lane of a file without declarations; the first rule that fits counts."""
    base = F.element_at(F.split(path, "/"), -1)
    go = F.endswith(path, F.lit(".go"))
    return (
        F.when(generated, NOISE).when(base == "go.sum", NOISE).when(path.isin("go.mod", "Project.toml"), CONTRACT).when(base == "Manifest.toml", NOISE)
        .when(F.startswith(path, F.lit("testdata/")) | F.contains(path, F.lit("/testdata/")), TESTS).when(base == "go.mod", OTHER)
        .when(go & same_shape, NOISE).when(go & F.endswith(path, F.lit("_test.go")), TESTS).when(go, LOGIC).otherwise(OTHER)
    ).cast("bigint")


def unit_key(id: Column, text: Column) -> Column:
    return F.concat(id, F.lit("@"), F.substring(F.sha2(text, 256), 1, 12))


def units(base: Graph, head: Graph, old_lines: DataFrame, new_lines: DataFrame, gained: DataFrame | None = None) -> DataFrame:
    """A unit for each declaration that old_lines or new_lines (id, lines) name: change, lane, risk, reasons, callers. `gained` are head's new edges, where they are known."""
    keep = ["name", "pkg", "pkg_name", "path", "kind", "exported", "test", "data", "signature", "shape", "complexity"]
    b = base.decls.select("id", *(F.col(c).alias(f"o_{c}") for c in keep), F.lit(True).alias("was"))
    h = head.decls.select("id", *(F.col(c).alias(f"n_{c}") for c in keep), F.lit(True).alias("is"))
    ids = old_lines.select("id").union(new_lines.select("id")).distinct()
    u = ids.join(b, "id", "left").join(h, "id", "left").join(old_lines.select("id", F.col("lines").alias("deleted")), "id", "left").join(new_lines.select("id", F.col("lines").alias("added")), "id", "left").na.fill(0, ["added", "deleted"])
    test_of = head.decls.select(F.col("id").alias("src"), F.col("test").alias("caller_test"), F.lit(True).alias("known"))

    def called(g: Graph, only_known: bool, prefix: str) -> DataFrame:
        c = g.edges.where("kind = 'caller'").select("src", F.col("dst").alias("id")).join(test_of, "src", "inner" if only_known else "left")
        t = F.coalesce("caller_test", F.lit(False))  # a caller that isn't known counts as production
        return c.groupBy("id").agg(F.count_if(~t).alias(f"{prefix}prod"), F.count_if(t).alias(f"{prefix}tests"))

    gained = (graphdiff.edges_added(base, head) if gained is None else gained).join(test_of, "src", "left").where(~F.coalesce("caller_test", F.lit(False))).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("gained"))
    u = u.join(called(head, False, "n_"), "id", "left").join(called(base, True, "o_"), "id", "left").join(gained, "id", "left").na.fill(0, ["n_prod", "n_tests", "o_prod", "o_tests", "gained"])
    was, here = F.coalesce("was", F.lit(False)), F.coalesce("is", F.lit(False))
    cur = lambda c: F.when(here, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    same = was & here & (F.col("o_shape") == F.col("n_shape"))
    change = F.when(~was, "added").when(~here, "removed").when(same & (F.col("o_path") != F.col("n_path")), "moved").otherwise("modified")
    resigned = was & here & (F.col("o_signature") != F.col("n_signature"))
    public = importable(cur("pkg"), cur("pkg_name"), head.module)
    lane = F.when(same, NOISE).when(cur("test"), TESTS).when(cur("exported") & public & ((change != "modified") | resigned), CONTRACT).when(cur("data"), OTHER).otherwise(LOGIC)
    prod, tests = F.when(here, F.col("n_prod")).otherwise(F.col("o_prod")), F.when(here, F.col("n_tests")).otherwise(F.col("o_tests"))
    cx, delta = F.col("n_complexity"), F.col("n_complexity") - F.col("o_complexity")
    func = here & F.col("n_kind").isin("func", "method")
    cx_points = F.floor(cx / 2) + F.when(was & (delta != 0), 2 * F.greatest(delta, F.lit(0))).otherwise(0)
    cx_reason = F.when(was & (delta != 0), F.concat(F.lit("complexity "), cx.cast("string"), F.lit(" ("), F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(")"))).when(cx > 10, F.concat(F.lit("complexity "), cx.cast("string")))
    no_test = func & ~F.coalesce(F.col("n_test"), F.lit(False)) & (F.col("n_tests") == 0)
    risk = (
        F.floor(F.least(F.col("added") + F.col("deleted"), F.lit(40)) / 4)
        + F.when(resigned, 6).otherwise(0)
        + F.when(~here, 4).otherwise(0)
        + 3 * F.least(prod, F.lit(10))
        + F.when(was & here, 2 * F.least(F.col("gained"), F.lit(5))).otherwise(0)
        + F.when(cur("exported") & ~cur("test"), 4).otherwise(0)
        + F.when(func, cx_points).otherwise(0)
        + F.when(no_test, 5).otherwise(0)
    )
    of_callers = F.concat(plural(prod + tests, "caller"), F.when(tests > 0, F.concat(F.lit(" ("), tests.cast("string"), F.lit(" in tests)"))).otherwise(""))
    reasons = F.array_compact(
        F.array(
            F.when(resigned, "signature changed"),
            F.when(prod + tests > 0, of_callers),
            F.when(was & here & (F.col("gained") > 0), plural(F.col("gained"), "new reference")),
            F.when(cur("data"), "long string literal"),
            F.when(cur("exported") & ~cur("test"), "exported"),
            F.when(func, cx_reason),
            F.when(no_test, "no direct test"),
        )
    )
    layout = F.when(change == "moved", F.array(F.concat(F.lit("moved from "), "o_path"))).otherwise(F.array(F.lit("comments or layout only")))
    return u.select(
        "id", cur("name").alias("name"), cur("path").alias("file"), cur("kind").alias("kind"), change.alias("change"), lane.cast("bigint").alias("lane"),
        F.when(same, 0).otherwise(risk).cast("bigint").alias("risk"), F.array_join(F.when(same, layout).otherwise(reasons), "; ").alias("reasons"), "added", "deleted",
    )


def ordered(units: DataFrame) -> DataFrame:
    return units.orderBy("lane", F.desc("risk"), "file", "name", "id")


def line_diff(a: list[str], b: list[str], a_start: int = 1, b_start: int = 1) -> list[tuple[str, int, int, str]]:
    """(op, old, new, text) of a longest-common-subsequence diff, deletions before insertions; 0 on a missing side."""
    if len(a) * len(b) > MAX_CELLS:
        return [("-", a_start + i, 0, t) for i, t in enumerate(a)] + [("+", 0, b_start + j, t) for j, t in enumerate(b)]
    lead = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if lead:  # equal lines at the front pair off in any case
        front = [(" ", a_start + k, b_start + k, t) for k, t in enumerate(a[:lead])]
        return front + line_diff(a[lead:], b[lead:], a_start + lead, b_start + lead)
    names = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([names[t] for t in a], np.int64), np.array([names[t] for t in b], np.int64)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        # from the right: where lines are the same one more than diagonally below, else the better of below and right
        best[i, :-1] = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i] = np.maximum.accumulate(best[i, ::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((" ", a_start + i, b_start + j, a[i]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
            out.append(("-", a_start + i, 0, a[i]))
            i += 1
        else:
            out.append(("+", 0, b_start + j, b[j]))
            j += 1
    return out


def diff_texts(pairs: DataFrame) -> DataFrame:
    """key, seq, op, old, new, text of rows (key, old_text, new_text), by Arrow batches."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in data:
            for k, a, b in zip(t["key"], t["old_text"], t["new_text"], strict=True):  # a pair at a time, as texts are long
                rows = [(k, i, *r) for i, r in enumerate(line_diff((a or "").split("\n"), (b or "").split("\n")))]
                yield pd.DataFrame(rows, columns=["key", "seq", "op", "old", "new", "text"])

    kind = pairs.schema["key"].dataType.simpleString()
    return pairs.select("key", "old_text", "new_text").mapInPandas(run, f"key {kind}, seq bigint, op string, old bigint, new bigint, text string")
