"""Shared folder, lineage cuts and Arrow batch helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task works on at once; a single longer document is still taken whole.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local one is set; a cluster must name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="cellweave-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, and keeps columns prunable."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table from materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that don't clash with df's own, whatever those are (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_cw_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, object]) -> DataFrame:
    """docs without the rows whose keys are in dropped (null keys match nulls).

    keys: column of dropped -> expression over docs. A plain left anti join: Spark broadcasts dropped only when it has
    measured it to be small, else it sorts and merges, and AQE splits hot keys.
    """
    names = fresh(docs, *keys)
    right = dropped.select([F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    on = None
    for expr, n in zip(keys.values(), names, strict=True):
        one = expr.eqNullSafe(right[n])
        on = one if on is None else on & one
    return docs.join(right, on, "left_anti")


def slices(batch: pa.RecordBatch, column: int = 0, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Sub-batches of at most `most` bytes in a string column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()
