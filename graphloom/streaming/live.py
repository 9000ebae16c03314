"""Live analysis: a streaming source of a folder's fingerprint, and batches that recompute what is cached.

A change is a new fingerprint (paths, sizes and modification times of watched files). A result whose
load began before a later change is not committed: that is the only kind of late data here, so there
is no event time and no watermark.
"""

from __future__ import annotations

import hashlib
import os
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.sources import diffs
from graphloom.sources.frontends import FRONTENDS, PROJECT_FILES, SKIPPED

#: Endings of sources that are watched.
EXTENSIONS = tuple(x for f in FRONTENDS for x in f.extensions)


def watched(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, modification time in ns) of watched files, by path."""
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and d[0] != ".")
        for name in sorted(files):
            if name.endswith(EXTENSIONS) or name in PROJECT_FILES:
                s = os.stat(os.path.join(folder, name))
                yield os.path.relpath(os.path.join(folder, name), root), s.st_size, s.st_mtime_ns


def fingerprint(root: str) -> str:
    h = hashlib.sha256()
    for row in watched(root):
        h.update(repr(row).encode())
    return h.hexdigest()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"fingerprint": "", "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = fingerprint(self.root)
        if now == start["fingerprint"]:
            return iter([]), start
        end = {"fingerprint": now, "n": start["n"] + 1}
        return iter([(self.root, now, end["n"])]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(self.root, end["fingerprint"], end["n"])] if end["n"] > start["n"] else [])


class FingerprintSource(DataSource):
    """`spark.readStream.format("fingerprint").option("root", …)`: a row (root, fingerprint, change) for each change."""

    @classmethod
    def name(cls) -> str:
        return "fingerprint"

    def schema(self) -> str:
        return "root string, fingerprint string, change bigint"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["root"])


class Epochs:
    """The number of changes of each repository; a result is current if none came since its load began."""

    def __init__(self) -> None:
        self._lock, self._now = threading.Lock(), {}

    def bump(self, repo: str) -> int:
        with self._lock:
            self._now[repo] = self._now.get(repo, 0) + 1
            return self._now[repo]

    def current(self, repo: str) -> int:
        with self._lock:
            return self._now.get(repo, 0)


def watch(spark: SparkSession, root: str, load: Callable[[str], DataFrame], commit: Callable[[str, DataFrame], None], checkpoint: str, every: str = "1 second", epochs: Epochs | None = None) -> StreamingQuery:
    """Loads a folder again at each change and commits the result, unless another change came meanwhile."""
    spark.dataSource.register(FingerprintSource)
    epochs = epochs or Epochs()

    def batch(changes: DataFrame, _: int) -> None:
        if not changes.take(1):
            return
        began, seen = epochs.bump(root), fingerprint(root)
        result = load(root)
        # a save during the load makes another change, whose batch comes next
        if epochs.current(root) == began and fingerprint(root) == seen:
            commit(root, result)

    stream = spark.readStream.format("fingerprint").option("root", root).load()
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Churn:
    """Commits per path in the window that ends at each repository's last commit, kept from a stream of commits (repo, sha, ts, path).

    Commits stand by day in a shared folder, a file for each batch that had some, and a batch that is run again writes its own
    anew. A late commit goes to its day; the window moves when a repository's last commit does. Reading takes the days that the oldest window can reach alone, and
    `expire` drops those that none can.
    """

    SCHEMA = "repo string, sha string, ts timestamp, path string, day date"

    def __init__(self, spark: SparkSession, at: str, days: int = 90) -> None:
        self.spark, self.at, self.days = spark, at, days

    def apply(self, batch: int, commits: DataFrame) -> None:
        rows = commits.select("repo", "sha", F.col("ts").cast("timestamp").alias("ts"), "path").distinct().withColumn("day", F.to_date("ts"))
        rows.write.mode("overwrite").partitionBy("day").option("compression", "zstd").parquet(f"{self.at}/batch={batch}")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, batch int").parquet(self.at)

    def now(self) -> DataFrame:
        """repo, path and churn after the batches so far."""
        last = self._all().groupBy("repo").agg(F.max("ts").alias("last"))
        oldest = last.agg(F.to_date(F.min("last") - F.expr(f"interval {self.days} days"))).first()[0]  # one date, so that older days aren't read
        rows = self._all() if oldest is None else self._all().where(F.col("day") >= F.lit(oldest))
        return diffs.windowed(rows, self.days)

    def follow(self, commits: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follows a stream; without a trigger's time, what is there now."""
        out = commits.writeStream.foreachBatch(lambda rows, n: self.apply(n, rows)).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
