"""Changes of many repositories, each read over all its roots: what an inbox lists, and a card a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ordered import numbered, prefixes
from graphloom.operators import items, review

CHANGE = ["repo", "change"]


def scoped(files: DataFrame, roots: DataFrame) -> DataFrame:
    """`files` of a diff by `root`, with paths below it; a path that another root holds is empty there.

    A path belongs to the deepest of `roots` (dir) that it lies in, found by an equi-join on its own folders. A file
    moved between roots is a row in each; one that lies in no root is in none.
    """
    rest = [c for c in files.columns if c not in ("old_path", "new_path")]
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_path").alias("path")) for s in ("old", "new")))
    paths = files.select("old_path", "new_path", F.explode(sides).alias("s")).select("old_path", "new_path", "s.*").where("path <> ''")
    # the top folder holds every path, so it is no key of the join
    known = roots.where("dir <> '.'").select("dir", F.lit(True).alias("known")).distinct()
    within = paths.withColumn("dir", F.explode_outer(prefixes(F.col("path")))).join(known, "dir", "left")
    deepest = within.groupBy("old_path", "new_path", "side", "path").agg(F.max_by("dir", F.when(F.col("known"), F.length("dir"))).alias("dir"))
    top = roots.agg(F.coalesce(F.bool_or(F.col("dir") == "."), F.lit(False)).alias("top"))  # one row
    held = deepest.crossJoin(F.broadcast(top)).withColumn("root", F.coalesce("dir", F.when(F.col("top"), "."))).where("root is not null")
    below = F.when(F.col("root") == ".", F.col("path")).otherwise(F.substr("path", F.length("root") + 2))
    relative = {s: F.coalesce(F.max(F.when(F.col("side") == s, below)), F.lit("")).alias(f"{s}_below") for s in ("old", "new")}
    at = held.groupBy("old_path", "new_path", "root").agg(*relative.values())
    return files.join(at, ["old_path", "new_path"]).select("root", F.col("old_below").alias("old_path"), F.col("new_below").alias("new_path"), *rest)


def readings(units: DataFrame, introduced: DataFrame, files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """What each change of a repository asks of a reader: a row per repo and change.

    units are (repo, change, root, key, lane, risk), introduced findings and files (added, deleted) have repo, change and
    root, reviewed marks are (repo, key). Counts: units, done (reviewed), contract and logic (not reviewed, in these lanes),
    max_risk over all units, introduced; added and deleted as `items.summaries` has them; roots: (dir, units), also those without units.
    """
    u = units.join(reviewed.select("repo", "key").distinct().withColumn("mark", F.lit(True)), ["repo", "key"], "left")
    waits = lambda lane: F.count_if(F.col("mark").isNull() & (F.col("lane") == lane))
    per = u.groupBy(*CHANGE, "root").agg(F.count(F.lit(1)).alias("n"), F.count_if("mark").alias("done"), waits(review.CONTRACT).alias("contract"), waits(review.LOGIC).alias("logic"), F.max("risk").alias("max_risk"))
    per = per.join(files.select(*CHANGE, "root").distinct(), [*CHANGE, "root"], "full").na.fill(0)
    total = [F.sum(c).alias(c) for c in ("done", "contract", "logic")]
    roots = F.array_sort(F.collect_list(F.struct(F.col("root").alias("dir"), F.col("n").alias("units")))).alias("roots")  # a row a root
    read = per.groupBy(*CHANGE).agg(*total, F.max("max_risk").alias("max_risk"), roots)
    summed = items.summaries(units, introduced, files, CHANGE).drop("roots")
    return summed.join(read, CHANGE, "left").na.fill(0).withColumn("roots", F.coalesce("roots", F.array().cast("array<struct<dir:string,units:bigint>>")))


def inbox(changes: DataFrame, repos: DataFrame, read: DataFrame) -> DataFrame:
    """Changes by how much they need reading: those with open contract or logic first, the riskiest of them first, then by the repository's name.

    changes are (repo, change, number), without a number for a working tree, which is listed only with units in it; a pull
    request is listed before it is read, too (`ready` false). Ties go by repo and number.
    """
    listed = changes.join(read.withColumn("ready", F.lit(True)), CHANGE, "left").na.fill(0, [c for c, t in read.dtypes if t == "bigint"]).na.fill(False, ["ready"])
    listed = listed.where(F.col("number").isNotNull() | (F.col("units") > 0)).join(repos.select(F.col("repo"), F.col("name").alias("repo_name")), "repo")
    listed = listed.withColumn("needs_reading", F.col("contract") + F.col("logic") > 0)
    return numbered(listed, [F.desc("needs_reading"), F.desc("max_risk"), F.asc("repo_name"), F.asc("repo"), F.asc_nulls_first("number"), F.asc("change")])


def cards(repos: DataFrame, roots: DataFrame, prognoses: DataFrame, pulls: DataFrame) -> DataFrame:
    """repo, name, langs, ready, prognoses by level and open pull requests of each repository.

    roots are (repo, dir, lang, ready), prognoses (repo, level), pulls (repo). langs has each language once, in the order of
    roots, with how far its links are to be trusted; a repository is ready once one of its roots is.
    """
    first = roots.groupBy("repo", "lang").agg(F.min("dir").alias("dir"), F.bool_or("ready").alias("ready"))
    trusted = F.concat(F.col("lang"), F.when(F.col("lang") == "go", " (typed)").otherwise(" (named)"))
    langs = F.transform(F.array_sort(F.collect_list(F.struct("dir", trusted.alias("lang")))), lambda x: x["lang"])
    known = first.groupBy("repo").agg(langs.alias("langs"), F.bool_or("ready").alias("ready"))
    names = {3: "fix_first", 2: "fix_soon", 1: "convenient"}
    census = prognoses.groupBy("repo").agg(*(F.count_if(F.col("level") == n).alias(c) for n, c in names.items()))
    out = repos.join(known, "repo", "left").join(census, "repo", "left").join(pulls.groupBy("repo").agg(F.count(F.lit(1)).alias("pulls")), "repo", "left")
    return out.select("repo", "name", F.coalesce("langs", F.array().cast("array<string>")).alias("langs"), F.coalesce("ready", F.lit(False)).alias("ready"), *(F.coalesce(c, F.lit(0)).alias(c) for c in (*names.values(), "pulls")))
