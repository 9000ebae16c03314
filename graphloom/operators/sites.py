"""Where callers name what they call, and notes on lines: joins of source lines with spans, through words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How comments and declarations begin, and the lines shown around a call.
COMMENTS = ("//", "#", "/*", "*")
DECLARES = ("func ", "def ", "fn ", "pub fn ", "function ", "export function ", "async function ", "export async function ")
CONTEXT = 2


def _begins(text: Column, heads: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(text, F.lit(h))
    return out


def short_name(name: Column) -> Column:
    """The last part of a name, without what an argument list adds."""
    return F.substring_index(F.substring_index(name, ".", -1), "(", 1)


def call_sites(lines: DataFrame, decls: DataFrame, calls: DataFrame) -> DataFrame:
    """src, dst, line, found, first, last: where each caller of calls (src, dst) names its callee, and the lines to show.

    lines are (path, line, text), decls (id, name, path, start_line, end_line). The first line of the caller's own that has the callee's name as a word and is
    neither comment nor declaration; else a declaration that has it besides the caller's own name; else the caller's start, not found. A caller that
    goes beyond its file isn't found either.

    Lines are an index of their words, joined by path and name: no pattern is tried on lines without the name.
    """
    t = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    kept = lines.select("path", "line", t.alias("t")).where(~_begins(F.col("t"), COMMENTS)).withColumn("declares", _begins(F.col("t"), DECLARES))
    words = kept.select("path", "line", "declares", F.when(F.col("declares"), F.col("t")).alias("t"), F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"\w+"), F.lit(0)))).alias("callee"))
    ends = lines.groupBy("path").agg(F.max("line").alias("length"))
    d = decls.select("id", short_name(F.col("name")).alias("short"), "path", "start_line", "end_line")
    # words and declarations grow with the sources, whatever size Spark expects of them
    pairs = calls.select("src", "dst").distinct().hint("merge").join(d.withColumnRenamed("id", "src").withColumnRenamed("short", "own"), "src").hint("merge").join(d.select(F.col("id").alias("dst"), F.col("short").alias("callee")), "dst")
    pairs = pairs.join(ends, "path", "left").withColumn("inside", (F.col("start_line") >= 1) & (F.col("end_line") <= F.coalesce("length", F.lit(0))))
    met = pairs.where("inside").hint("merge").join(words, ["path", "callee"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    # a declaration counts if the name is there besides the caller's own, whose first place goes
    own = F.concat("own", F.lit("("))
    at = F.instr("t", own)
    rest = F.when(at > 0, F.concat(F.substr("t", F.lit(1), at - 1), F.lit("("), F.substr("t", at + F.length(own)))).otherwise(F.col("t"))
    names = ~F.col("declares") | F.array_contains(F.regexp_extract_all(rest, F.lit(r"\w+"), F.lit(0)), F.col("callee"))
    best = met.where(names).groupBy("src", "dst").agg(F.min(F.struct("declares", "line")).alias("x")).select("src", "dst", F.col("x.line").alias("line"))
    out = pairs.hint("merge").join(best, ["src", "dst"], "left").withColumn("found", F.col("line").isNotNull())
    at = F.coalesce("line", "start_line")
    # nothing is shown of a caller that goes beyond its file
    first = F.when(F.col("inside"), F.when(F.col("found"), F.greatest(at - CONTEXT, F.col("start_line"))).otherwise(F.col("start_line")))
    last = F.when(F.col("inside"), F.least(F.when(F.col("found"), at + CONTEXT).otherwise(F.col("start_line") + 2 * CONTEXT), F.col("end_line")))
    return out.select("src", "dst", at.alias("line"), "found", first.alias("first"), last.alias("last"))


def same_change(a: Column, b: Column) -> Column:
    """Whether two scopes are one change: equal, or of one pull request at any head of it."""
    head = lambda s: F.substring_index(s, "@", 1)
    return (a == b) | (F.contains(a, F.lit("@")) & F.contains(b, F.lit("@")) & (head(a) == head(b)))


def notes_on(notes: DataFrame, units: DataFrame, lines: DataFrame, shown: DataFrame, scope: str, root: str) -> DataFrame:
    """id, file, side, line and status of the open notes of a change: current, outdated, or stray (its line isn't shown), outdated first.

    notes are (id, scope, root, resolved, unit_key, file, side, line, text), units the keys (unit_key) of the change, lines (file, side, line, text) of both
    sides, shown (file, side, line). A note on a unit is outdated if no unit has its key now, another if its line's text is another now.
    """
    own = notes.where(same_change(F.col("scope"), F.lit(scope)) & (F.col("root") == root) & ~F.col("resolved"))
    now = lines.select("file", "side", "line", F.col("text").alias("now"))
    seen = own.join(units.select("unit_key", F.lit(True).alias("here")).distinct(), "unit_key", "left").join(now, ["file", "side", "line"], "left")
    seen = seen.join(shown.select("file", "side", "line", F.lit(True).alias("on_page")).distinct(), ["file", "side", "line"], "left")
    stale = F.when(F.col("unit_key") != "", F.col("here").isNull()).otherwise((F.col("text") != "") & (F.coalesce("now", F.lit("")) != F.col("text")))
    status = F.when(stale, "outdated").when(F.col("on_page").isNull(), "stray").otherwise("current")
    return seen.select("id", "file", "side", "line", status.alias("status"), F.col("on_page").isNull().alias("stray"))
