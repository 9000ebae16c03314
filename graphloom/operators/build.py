"""All units of a diff: declarations, lines outside of them, and whole files, with moves joined to one unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import spans
from graphloom.operators import graphdiff, review
from graphloom.sources import golang
from graphloom.sources.binding import Graph
from graphloom.sources.frontends import FRONTENDS, base

COLUMNS = ["id", "name", "file", "kind", "change", "lane", "risk", "reasons", "added", "deleted"]
EXTENSIONS = sorted({x for f in FRONTENDS for x in f.extensions})
#: Fixed value: lines at the top of a file that run nothing, such as imports, what closes a wrapped one, and comments.
IMPORT_OR_COMMENT = r"^(import\b|from\b|use\b|using\b|mod\b|extern crate\b|export\s*[*{]|[})\]]|[\w$]+,?$|//|#|/\*|\*)"


def extension(path: Column) -> Column:
    return F.regexp_extract(base(path), r"\.[^.]*$", 0)


def routed(files: DataFrame, old: Graph, new: Graph) -> DataFrame:
    """`files` with `path`, and whether a file is one unit (`whole`): no source, in neither snapshot, or generated."""
    b = old.files.groupBy(F.col("path").alias("old_path")).agg(F.lit(True).alias("was"))
    h = new.files.groupBy(F.col("path").alias("new_path")).agg(F.lit(True).alias("is"), F.bool_or("generated").alias("generated"))
    both = files.join(b, "old_path", "left").join(h, "new_path", "left")
    path = F.when(F.col("new_path") != "", F.col("new_path")).otherwise(F.col("old_path"))
    unknown = F.col("was").isNull() & F.col("is").isNull()
    whole = ~F.array_contains(F.array(*map(F.lit, EXTENSIONS)), extension(path)) | unknown | F.coalesce("generated", F.lit(False))
    return both.withColumns({"path": path, "whole": whole, "generated": F.coalesce("generated", F.lit(False))})


def _side(files: DataFrame, side: str) -> DataFrame:
    h = files.select(F.col(f"{side}_path").alias("path"), F.explode("hunks").alias("h")).where("path <> ''")
    return h.select("path", F.col(f"h.{side}_start").alias("start"), F.col(f"h.{side}_lines").alias("n"))


def counts() -> dict[str, Column]:
    """Lines that the hunks of a file add and delete."""
    total = lambda side: F.aggregate("hunks", F.lit(0).cast("bigint"), lambda a, h: a + h[f"{side}_lines"])
    return {"added": total("new"), "deleted": total("old")}


def touched(g: Graph, hunks: DataFrame) -> DataFrame:
    """id and changed lines of every declaration that hunks touch, 0 where only a point in it is."""
    return review.touched(g.decls, hunks).join(review.touched_lines(g.decls, hunks), "id", "left").na.fill(0, ["lines"])


def changed_lines(hunks: DataFrame, texts: DataFrame, g: Graph) -> DataFrame:
    """path, line and text of changed lines that stand in no declaration and aren't blank or a package clause."""
    at = hunks.where("n > 0").select("path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))
    lines = at.join(texts.select("path", F.split("text", "\n").alias("t")), "path").where(F.col("line") <= F.size("t"))
    lines = lines.select("path", "line", F.get("t", (F.col("line") - 1).cast("int")).alias("text"))
    return review.loose(lines.withColumn("text", F.trim("text")), g.decls)


def loose_units(files: DataFrame, old: Graph, new: Graph, old_texts: DataFrame, new_texts: DataFrame, go: bool) -> DataFrame:
    b = changed_lines(_side(files.where("was"), "old"), old_texts, old).withColumnRenamed("path", "old_path").join(files.select("old_path", F.col("path").alias("file")), "old_path")
    h = changed_lines(_side(files.where("is"), "new"), new_texts, new).withColumnRenamed("path", "new_path").join(files.select("new_path", F.col("path").alias("file")), "new_path")
    lines = b.select("file", "text", F.lit(0).alias("new")).unionByName(h.select("file", "text", F.lit(1).alias("new")))
    runs = F.bool_or(~F.col("text").rlike(IMPORT_OR_COMMENT)) & F.lit(not go)
    u = lines.groupBy("file").agg(runs.alias("runs"), F.sum("new").alias("added"), F.sum(1 - F.col("new")).alias("deleted"))
    lane = F.when(F.col("runs"), review.LOGIC).otherwise(review.NOISE)
    why = F.when(F.col("runs"), "top-level statements").otherwise("imports and file-level lines")
    return u.select(F.concat("file", F.lit("#file")).alias("id"), F.concat(base(F.col("file")), F.lit(" (file level)")).alias("name"), "file", F.lit("").alias("kind"), F.lit("modified").alias("change"), lane.cast("bigint").alias("lane"), F.lit(0).cast("bigint").alias("risk"), why.alias("reasons"), "added", "deleted")


def _compared(pairs: DataFrame) -> DataFrame:
    """key, old_n and new_n (lines), and whether two Go texts differ only in comments and layout."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = lambda text: [t.text for t in golang.tokens(text)[0] if t.text != ";"]
        for t in data:
            rows = [(k, len(a.split("\n")) if a else 0, len(b.split("\n")) if b else 0, bool(a and b and k.endswith(".go")) and shape(a) == shape(b)) for k, a, b in zip(t["key"], t["a"], t["b"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "old_n", "new_n", "same"])

    return pairs.mapInPandas(run, "key string, old_n bigint, new_n bigint, same boolean")


def file_units(files: DataFrame, old_texts: DataFrame, new_texts: DataFrame) -> DataFrame:
    a, b = (t.select(F.col("path").alias(f"{s}_path"), F.col("text").alias(s)) for t, s in ((old_texts, "old"), (new_texts, "new")))
    f = files.join(a, "old_path", "left").join(b, "new_path", "left").na.fill("", ["old", "new"])
    f = f.join(_compared(f.select(F.col("path").alias("key"), F.col("old").alias("a"), F.col("new").alias("b"))).withColumnRenamed("key", "path"), "path")
    path, name = F.col("path"), base(F.col("path"))
    lane = review.file_lane(path, F.col("generated"), F.col("same"))
    go = F.endswith(path, F.lit(".go"))
    fixture = F.startswith(path, F.lit("testdata/")) | F.contains(path, F.lit("/testdata/"))
    why = (
        F.when(F.col("generated"), "generated").when(name == "go.sum", "checksums").when(path.isin("go.mod", "Project.toml"), "dependencies").when(name == "Manifest.toml", "resolved versions")
        .when(fixture, "test fixture").when(name == "go.mod", "dependencies; in another module").when(go & F.col("same"), "comments or layout only").when(go, "in another module")
    )
    large = F.col("old_n") * F.col("new_n") > review.MAX_CELLS
    reasons = F.array_compact(F.array(F.when(F.col("status") == "renamed", F.concat(F.lit("renamed from "), "old_path")), F.when(F.col("binary"), "binary").when(large, "too large to show"), why))
    change = F.when(F.col("status") == "added", "added").when(F.col("status") == "deleted", "removed").when(F.col("status") == "renamed", "moved").otherwise("modified")
    f = f.withColumns(counts())
    risk = F.floor(F.least(F.col("added") + F.col("deleted"), F.lit(40)) / 4).cast("bigint")
    return f.select(path.alias("id"), path.alias("name"), path.alias("file"), F.lit("").alias("kind"), change.alias("change"), lane.alias("lane"), risk.alias("risk"), F.array_join(reasons, "; ").alias("reasons"), "added", "deleted")


def lines_of(texts: DataFrame) -> DataFrame:
    """path, line (from 1) and text of whole texts (path, text)."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("bigint") + 1)


def _texts_of(units: DataFrame, g: Graph, lines: DataFrame) -> DataFrame:
    """id and the source lines of units' declarations, joined."""
    d = g.decls.select("id", "path", "start_line", "end_line").hint("merge").join(units.select("id"), "id", "left_semi")
    own = spans.inside(lines, d).groupBy("id", "start_line", "end_line").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("l"))  # a declaration's
    return own.where(F.size("l") == F.col("end_line") - F.col("start_line") + 1).select("id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("own"))


def merged_moves(units: DataFrame, old: Graph, new: Graph, old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    """`units` with a removed and an added one that are one declaration as one: those the graphs pair, then those whose name and kind stand once on each side.

    old_lines and new_lines are the lines (path, line, text) of both versions' files.
    """
    gone, come = units.where("change = 'removed' and kind <> ''"), units.where("change = 'added' and kind <> ''")
    first = graphdiff.moved(old, new).select(F.col("from_id").alias("r"), F.col("to_id").alias("u")).join(gone.select(F.col("id").alias("r")), "r", "left_semi").join(come.select(F.col("id").alias("u")), "u", "left_semi")

    def lone(df: DataFrame, paired: str, to: str) -> DataFrame:
        left = df.join(first.select(F.col(paired).alias("id")), "id", "left_anti")
        return left.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(to)).where("n = 1").select("name", "kind", to)

    pairs = first.select("r", "u").unionByName(lone(gone, "r", "r").join(lone(come, "u", "u"), ["name", "kind"]).select("r", "u"))
    a = _texts_of(gone, old, old_lines).select(F.col("id").alias("r"), F.col("own").alias("old_text"))
    b = _texts_of(come, new, new_lines).select(F.col("id").alias("u"), F.col("own").alias("new_text"))
    pairs = pairs.hint("merge").join(a, "r").hint("merge").join(b, "u").hint("merge").join(gone.select(F.col("id").alias("r"), F.col("file").alias("from_file")), "r")
    ops = review.diff_texts(pairs.select(F.col("u").alias("key"), "old_text", "new_text")).groupBy(F.col("key").alias("u")).agg(F.count_if(F.col("op") == "+").alias("plus"), F.count_if(F.col("op") == "-").alias("minus"))
    pairs = pairs.join(ops, "u").select("r", F.col("u").alias("id"), "from_file", (F.col("old_text") == F.col("new_text")).alias("same"), "plus", "minus")
    rest = units.join(pairs.select(F.col("r").alias("id")), "id", "left_anti").join(pairs.drop("r"), "id", "left")
    told = F.concat(F.lit("moved from "), "from_file")
    edited = F.when(F.col("reasons") == "", told).otherwise(F.concat(told, F.lit("; "), "reasons"))
    pick = lambda moved, merged, own: F.when(F.col("same"), moved).when(~F.col("same"), merged).otherwise(own)
    return rest.withColumns(
        {
            "change": pick(F.lit("moved"), F.lit("modified"), F.col("change")), "lane": pick(F.lit(review.NOISE).cast("bigint"), F.col("lane"), F.col("lane")), "risk": pick(F.lit(0).cast("bigint"), F.col("risk"), F.col("risk")),
            "reasons": pick(told, edited, F.col("reasons")), "added": F.when(~F.col("same"), F.col("plus")).otherwise(F.col("added")), "deleted": F.when(~F.col("same"), F.col("minus")).otherwise(F.col("deleted")),
        }
    ).select(COLUMNS)


def build(old: Graph, new: Graph, files: DataFrame, old_texts: DataFrame, new_texts: DataFrame, go: bool = True) -> DataFrame:
    """Units of file diffs, given the texts (path, text) of both sides; `go` is whether the project's language is Go."""
    known = routed(files, old, new)
    whole, some = known.where("whole"), known.where("not whole")
    of_decls = review.units(old, new, touched(old, _side(some, "old")), touched(new, _side(some, "new")))
    made = merged_moves(of_decls, old, new, lines_of(old_texts), lines_of(new_texts))
    for more in (loose_units(some, old, new, old_texts, new_texts, go), file_units(whole, old_texts, new_texts)):
        made = made.unionByName(more.select(COLUMNS))
    return made
