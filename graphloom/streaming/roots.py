"""Many watched roots in one stream: each is walked by a task of its own, and roots come and go with a table.

`spark.readStream.format("roots").option("table", …)`: at every tick, a partition a root of the table walks it and gives (root, fingerprint).
What has changed is told by state: `changes` keeps the last fingerprint of each root, and forgets a root that hasn't been
seen for some ticks, so that one that is added again counts as changed.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from graphloom.streaming.live import fingerprint

FORGET = 3


def read_roots(table: str) -> list[str]:
    """Roots in a folder of JSON files (lines of {"root", "watched"}): those whose last line, by the files' names, says that they are watched."""
    last: dict[str, bool] = {}
    for name in sorted(os.listdir(table)) if os.path.isdir(table) else []:
        if name.endswith(".json"):
            with open(os.path.join(table, name)) as f:
                for line in f:
                    if line.strip():
                        row = json.loads(line)
                        last[row["root"]] = row["watched"]
    return sorted(r for r, on in last.items() if on)


def set_root(table: str, root: str, watched: bool) -> None:
    """Adds or removes a root; a table keeps all that was said of it."""
    os.makedirs(table, exist_ok=True)
    name = f"{time.time_ns():020d}.json"
    with open(os.path.join(table, name + ".new"), "w") as f:
        f.write(json.dumps({"root": root, "watched": watched}) + "\n")
    os.replace(os.path.join(table, name + ".new"), os.path.join(table, name))  # whole, or not there


@dataclass
class _Root(InputPartition):
    root: str
    tick: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.table, self.every = options["table"], float(options.get("every", "1"))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() / self.every)}

    def partitions(self, start: dict, end: dict) -> list[_Root]:
        return [_Root(r, end["tick"]) for r in read_roots(self.table)] if end["tick"] > start["tick"] else []

    def read(self, partition: _Root) -> Iterator[tuple]:
        yield partition.root, fingerprint(partition.root), partition.tick

    def commit(self, end: dict) -> None:
        pass


class RootsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roots"

    def schema(self) -> str:
        return "root string, fingerprint string, tick bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def changes(seen: DataFrame, every: float = 1.0) -> DataFrame:
    """root, fingerprint and change (from 1) where a root's fingerprint is another than the one before."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else ("", 0)
        found = pd.concat(list(rows)).sort_values("tick")["fingerprint"].iloc[-1]
        state.setTimeoutDuration(int(FORGET * max(every, 1.0) * 1000))
        if found == last:
            state.update((last, n))
            return
        state.update((found, n + 1))
        yield pd.DataFrame({"root": [key[0]], "fingerprint": [found], "change": [n + 1]})

    return seen.groupBy("root").applyInPandasWithState(run, "root string, fingerprint string, change bigint", "fingerprint string, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(spark: SparkSession, table: str, checkpoint: str, changed: Callable[[list[str], int], None], every: float = 1.0) -> StreamingQuery:
    """Calls `changed` with the roots that differ, once a batch that has some."""
    spark.dataSource.register(RootsSource)
    seen = spark.readStream.format("roots").option("table", table).option("every", str(every)).load()

    def batch(rows: DataFrame, n: int) -> None:
        found = sorted(r.root for r in rows.select("root").collect())  # names of roots
        if found:
            changed(found, n)

    return changes(seen, every).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").start()
