"""Persisted state: snapshots by repository, root and revision, small keyed tables, and JSON files."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = 4


def write_json(path: str, value: object) -> None:
    """Whole or not at all: written beside and renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "w") as f:
        json.dump(value, f, indent=2)
    os.replace(name, path)


def read_json(path: str, missing: object = None) -> object:
    return json.loads(Path(path).read_text()) if os.path.exists(path) else missing


def save(df: DataFrame, at: str, repo: str, root: str, rev: str, basis: str, used: int) -> None:
    """One snapshot's table; its partition is replaced."""
    keyed = df.withColumns({"repo": F.lit(repo), "root": F.lit(root), "rev": F.lit(rev), "basis": F.lit(basis), "used": F.lit(used)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "root", "rev").parquet(at)


def load(spark: SparkSession, at: str, repo: str, root: str, rev: str, basis: str) -> DataFrame | None:
    """The snapshot, None where there is none of this basis."""
    if not os.path.exists(at) and "://" not in at:
        return None
    found = spark.read.parquet(at).where((F.col("repo") == repo) & (F.col("root") == root) & (F.col("rev") == rev) & (F.col("basis") == basis))
    return None if found.isEmpty() else found.drop("repo", "root", "rev", "basis", "used")


def prunable(index: DataFrame, keep: int = KEPT) -> DataFrame:
    """Snapshots (repo, root, rev, used) beyond the newest of a root; the working tree's is never one."""
    order = Window.partitionBy("repo", "root").orderBy(F.desc("used"), "rev")
    return index.where("rev <> ''").withColumn("r", F.row_number().over(order)).where(F.col("r") > keep).drop("r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def move_each(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Ordered tables (basket, pos, key, …) with one row of each at another place: moves are (basket, key, to), a basket once.

    Places are counted from 1; one beyond the basket is its nearest.
    """
    names = items.columns
    to = moves.select("basket", F.col("key").alias("moved_key"), F.col("to").alias("moved_to"))
    in_basket = Window.partitionBy("basket")
    rows = items.join(to, "basket", "left").withColumn("is_moved", F.coalesce(F.col("key") == F.col("moved_key"), F.lit(False)))
    others = F.sum((~F.col("is_moved")).cast("int")).over(in_basket.orderBy("pos"))  # the place among the rows that stay
    at = F.least(F.greatest("moved_to", F.lit(1)), F.count(F.lit(1)).over(in_basket))
    rows = rows.withColumn("place", F.when(F.col("is_moved"), at - 0.5).otherwise(others.cast("double")))
    return rows.withColumn("pos", F.row_number().over(in_basket.orderBy("place")).cast("bigint")).select(names)


def move(basket: DataFrame, key: str, to: int) -> DataFrame:
    """One ordered table (pos, key, …) with one row at another place."""
    items = basket.withColumn("basket", F.lit(0))
    moves = basket.sparkSession.range(1).select(F.lit(0).alias("basket"), F.lit(key).alias("key"), F.lit(to).alias("to"))
    return move_each(items, moves).drop("basket")


def snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Declarations of a snapshot that another program wrote as lines of JSON."""
    schema = "id string, name string, kind string, pkg string, path string, test boolean, exported boolean, start_line bigint, end_line bigint, lines bigint, complexity bigint, nesting bigint, params bigint, signature string, shape string"
    return spark.read.schema(schema).json(path)


def repo_id(name: str, key: str):
    """A slug and six hexadecimal digits of the key's hash, as a column expression of literals."""
    slug = F.trim(F.regexp_replace(F.lower(F.lit(name)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.when(slug == "", F.lit("repo")).otherwise(slug), F.lit("-"), F.substring(F.sha2(F.lit(key), 256), 1, 6))


def julia_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """decls, edges, files and imports of what a Julia extractor prints: one JSON value for each project, which is its module.

    A reference is a declaration's name, or one behind a module's (`Mod.name`); it is linked to the same module's first,
    else to an imported one's; a name of several methods links to the first.
    """
    schema = (
        "Module string, Aliases map<string,string>, Modules array<struct<Path:string,Exports:array<string>,Imports:array<string>,Errors:array<string>>>, Files array<struct<Path:string,Module:string,Test:boolean,Lines:bigint>>, "
        "Decls array<struct<Name:string,Kind:string,Module:string,File:string,Test:boolean,Lines:bigint,Start:bigint,End:bigint,Params:bigint,Complexity:bigint,Nesting:bigint,Sig:string,Args:string,Shape:string,Refs:array<string>>>"
    )
    whole = spark.read.schema(schema).option("multiLine", "true").json(path)
    modules = whole.select(F.explode("Modules").alias("m")).select("m.*")
    files = whole.select(F.explode("Files").alias("f")).select("f.*")
    owners = files.select(F.col("Module").alias("owner")).distinct()
    d = whole.select(F.posexplode("Decls").alias("ord", "d")).select("ord", "d.*")
    # a submodule of another module's file stays in that module's package, its names qualified
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("Module", r"\."))), lambda n: F.array_join(F.slice(F.split("Module", r"\."), 1, n), "."))
    near = d.select("ord", F.explode(up).alias("owner")).join(owners, "owner").groupBy("ord").agg(F.max_by("owner", F.length("owner")).alias("pkg"))
    d = d.join(near, "ord", "left").withColumn("pkg", F.coalesce("pkg", "Module"))
    name = F.when(F.col("Module") == F.col("pkg"), F.col("Name")).otherwise(F.concat(F.substr("Module", F.length("pkg") + 2), F.lit("."), F.col("Name")))
    again = F.row_number().over(Window.partitionBy("pkg", "qualified").orderBy("File", "Start", "ord"))
    d = d.withColumn("qualified", name).withColumn("n", again)
    exports = modules.select(F.col("Path").alias("Module"), F.explode("Exports").alias("Name")).distinct().withColumn("exported", F.lit(True))
    d = d.join(exports, ["Module", "Name"], "left").withColumn("id", F.concat("pkg", F.lit("."), "qualified", F.when(F.col("n") > 1, F.concat(F.lit("#"), "n")).otherwise("")))
    decls = d.select(
        "id", F.col("qualified").alias("name"), F.col("Kind").alias("kind"), "pkg", F.col("File").alias("path"), F.col("Test").alias("test"), F.coalesce("exported", F.lit(False)).alias("exported"), F.col("Start").alias("start_line"), F.col("End").alias("end_line"),
        F.col("Lines").alias("lines"), F.col("Complexity").alias("complexity"), F.col("Nesting").alias("nesting"), F.col("Params").alias("params"), F.col("Sig").alias("signature"), F.col("Shape").alias("shape"), F.col("ord").cast("bigint").alias("ord"),
    )
    imports = modules.select(F.col("Path").alias("src"), F.explode("Imports").alias("dst")).distinct().join(owners.withColumnRenamed("owner", "dst"), "dst").where("src <> dst").select("src", "dst")
    refs = d.select(F.col("id").alias("src"), "pkg", F.explode("Refs").alias("ref")).withColumn("short", F.element_at(F.split("ref", r"\."), -1))
    target = d.where("n = 1").select(F.col("id").alias("dst"), F.col("pkg").alias("to"), F.col("Name").alias("short"))
    seen = imports.select(F.col("src").alias("pkg"), F.col("dst").alias("to")).unionByName(owners.select(F.col("owner").alias("pkg"), F.col("owner").alias("to")))
    hits = refs.join(target, "short").join(seen, ["pkg", "to"]).where("src <> dst")
    best = Window.partitionBy("src", "ref").orderBy((F.col("pkg") != F.col("to")).cast("int"), "to", "dst")
    edges = hits.withColumn("r", F.row_number().over(best)).where("r = 1").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).select("src", "dst", F.lit("caller").alias("kind"), "n")
    return decls, edges, files.select(F.col("Module").alias("pkg"), F.col("Path").alias("path"), F.col("Test").alias("test"), F.col("Lines").alias("lines")), imports


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests as `gh pr list --json` prints them, under the names that pages use."""
    schema = "number bigint, title string, author struct<login:string>, headRefName string, baseRefName string, headRefOid string, baseRefOid string, isDraft boolean, updatedAt timestamp, url string, additions bigint, deletions bigint"
    p = spark.read.schema(schema).option("multiLine", "true").json(path)
    return p.select("number", "title", F.col("author.login").alias("author"), F.col("headRefName").alias("head"), F.col("baseRefName").alias("base"), F.col("headRefOid").alias("head_sha"), F.col("baseRefOid").alias("base_sha"), F.col("isDraft").alias("draft"), F.col("updatedAt").alias("updated"), "url", F.col("additions").alias("added"), F.col("deletions").alias("deleted"))
