"""Metrics of runs: counted while a stage writes, by Spark's observations, and appended to a table; no second pass over the data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, run string, seconds double, metrics map<string,double>"


def measured(df: DataFrame, write: Callable[[DataFrame], None], stage: str, table: str, run: str = "", **counts: Column) -> dict[str, float]:
    """Hand df to write(), which has to read it once, and append a row to the metrics at the path `table`: seconds, rows, and aggregates by name.

    Aggregates are those that need no distinct values; each is null without rows (rows is 0) and left out then. If the
    write fails, nothing is appended. Rows of tasks that Spark runs again are counted once, in the attempt that counts.
    """
    seen = Observation()
    began = time.monotonic()
    write(df.observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in counts.items()]))
    found = {k: float(v) for k, v in seen.get.items() if v is not None}
    row = [(stage, run, time.monotonic() - began, found)]
    df.sparkSession.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(table)
    return found


def read_metrics(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(table)
