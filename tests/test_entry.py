"""The flagship query as the first of a session, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

FIRST = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "{0}").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
df = __spark_entry__.entry(spark)
rows = df.collect()
print("rows", len(rows), ",".join(df.columns))
"""


@pytest.mark.parametrize("partitions", [8, 200])
def test_entry_is_the_first_query(partitions):
    done = subprocess.run([sys.executable, "-c", FIRST.format(partitions)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 240 " in done.stdout, done.stdout
