"""Unified diffs as tables: one row per file, and hunks by side."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "diff_id string, old_path string, new_path string, status string, binary boolean, hunks array<struct<old_start:bigint,old_lines:bigint,new_start:bigint,new_lines:bigint>>"
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unquoted(path: str) -> str:
    """A path as git quotes it, with its escapes read: octal bytes of UTF-8, and those of C."""
    known = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, '"': 34, "\\": 92}
    one = lambda m: bytes([int(m[1], 8) if m[1][0].isdigit() else known.get(m[1], ord(m[1]))]).decode("latin1")
    return re.sub(r"\\([0-7]{3}|.)", one, path.encode().decode("latin1")).encode("latin1").decode(errors="replace")


_HEAD = re.compile(r'diff --git (?:"a/((?:\\.|[^"\\])*)"|a/(.*?)) (?:"b/((?:\\.|[^"\\])*)"|b/(.*?))\n')


def parse(text: str) -> Iterator[tuple[str, str, str, bool, list[dict[str, int]]]]:
    """(old path, new path, status, binary, hunks) of each file of a diff as git prints it; a missing side's path is empty."""
    for part in re.split(r"(?m)^(?=diff --git )", text):
        if not part.startswith("diff --git "):
            continue
        head = _HEAD.match(part)
        old, new = (unquoted(head[1]) if head[1] is not None else head[2], unquoted(head[3]) if head[3] is not None else head[4]) if head else ("", "")
        status, binary, hunks = "modified", False, []
        for line in part.split("\n")[1:]:
            if (found := HUNK.match(line)) and not line.startswith("@@@"):
                a, b, c, d = found.groups()
                hunks.append({"old_start": int(a), "old_lines": int(b or 1), "new_start": int(c), "new_lines": int(d or 1)})
            elif hunks:
                continue
            elif line.startswith("new file"):
                status, old = "added", ""
            elif line.startswith("deleted file"):
                status, new = "deleted", ""
            elif line.startswith("rename from "):
                status, old = "renamed", _path(line[12:])
            elif line.startswith("rename to "):
                new = _path(line[10:])
            elif line.startswith(("Binary files", "GIT binary patch")):
                binary = True
        yield old, new, status, binary, hunks


def _path(said: str) -> str:
    return unquoted(said[1:-1]) if said.startswith('"') else said


def file_diffs(diffs: DataFrame) -> DataFrame:
    """Files of rows (diff_id, text)."""

    def run(data: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in data:
            yield pd.DataFrame([(k, *r) for k, x in zip(t["diff_id"], t["text"], strict=True) for r in parse(x or "")], columns=["diff_id", "old_path", "new_path", "status", "binary", "hunks"])

    return diffs.select("diff_id", "text").mapInPandas(run, SCHEMA)


def hunks(files: DataFrame, side: str) -> DataFrame:
    """path, start, n of one side (old or new)."""
    h = files.select(F.col(f"{side}_path").alias("path"), F.explode("hunks").alias("h")).where("path <> ''")
    return h.select("path", F.col(f"h.{side}_start").alias("start"), F.col(f"h.{side}_lines").alias("n"))


def from_git(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """file_diffs between two revisions of a repository that the driver can read."""
    text = subprocess.run(["git", "-C", repo, "diff", "-U0", "-M", base, head], check=True, capture_output=True, text=True).stdout
    return file_diffs(spark.createDataFrame([(f"{base}..{head}", text)], "diff_id string, text string"))


def windowed(log: DataFrame, days: int) -> DataFrame:
    """repo, path and churn: commits of a log (repo, sha, ts, path) in the days up to their repository's last one.

    Commits are counted once a repository, path and time before repositories' ends are joined, a row each.
    """
    last = log.groupBy("repo").agg(F.max("ts").alias("last"))
    own = log.select("repo", "path", "ts", "sha").distinct().groupBy("repo", "path", "ts").agg(F.count(F.lit(1)).alias("n"))
    inside = own.join(last, "repo").where(F.col("ts") >= F.col("last") - F.expr(f"interval {days} days"))
    return inside.groupBy("repo", "path").agg(F.sum("n").alias("churn"))


def commits(spark: SparkSession, repo: str, rev: str = "HEAD", days: int = 90) -> DataFrame:
    """path and commits that touched it in the days up to the last commit."""
    out = subprocess.run(["git", "-C", repo, "log", "--no-renames", "--format=%x00%H%x00%cI", "--name-only", rev], check=True, capture_output=True, text=True).stdout
    rows, now = [], ("", "")
    for line in out.split("\n"):
        if line.startswith("\0"):
            _, sha, ts = line.split("\0")
            now = sha, ts
        elif line:
            rows.append((*now, line))
    log = spark.createDataFrame(rows, "sha string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    return windowed(log.withColumn("repo", F.lit(repo)), days).drop("repo")
