"""Token ids as Parquet list columns: dictionary-coded ids, delta-coded positions, small pages with indexes.

Files are in ascending order of doc_id and number their documents' ids from their own start; a table of file totals
turns that into positions in the corpus, so neither writing nor reading needs one global running sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import PieceEncoder, byte_bpe_path

#: Text bytes encoded at once; a row group is a few of these.
SLICE_BYTES = 2 << 20
STORED = "file_no int, doc_id long, file_start long, n_tokens int, ids array<int>"
#: Writer settings: dictionary pages for ids, delta coding for sorted numbers, row groups and pages small enough to read few documents.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}

def write_token_store(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, end_id after each, and write the ids in ascending order of doc_id (null ids first; rows of one id by their texts' hash).

    Null texts count as empty: end_id alone. Repeated ids are kept row by row; columns besides id and text are left out,
    whatever their names; no documents give files without rows. The sort is by range, so any number of files are written
    side by side, and rows are numbered so that those of one id and text don't have to share a file.
    """
    vocabulary = vocabulary or byte_bpe_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    files = max(1, docs.rdd.getNumPartitions())  # as many as the input has splits, so they grow with it
    order = ["doc_id", "h", "row"]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file_no, at_id = PieceEncoder.of(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                flat, at = encoder.ids(part.column(1))
                n = len(part)
                ends = at[1:] + np.arange(1, n + 1)
                ids = np.insert(flat.astype("<i4"), at[1:], end_id)
                begins = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([pa.array(np.full(n, file_no), pa.int32()), part.column(0), pa.array(begins[:-1] + at_id, pa.int64()), pa.array(np.diff(begins), pa.int32()), lists], ["file_no", "doc_id", "file_start", "n_tokens", "ids"])
                at_id += int(begins[-1])
                pa.default_memory_pool().release_unused()  # what a slice has freed doesn't stay with the worker

    ordered.mapInArrow(encode, STORED).write.options(**FORMAT).parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored columns; doc_id ranges and single columns prune pages and chunks."""
    return spark.read.schema(STORED).parquet(path)


def tokens_of(store: DataFrame, low: int, high: int) -> DataFrame:
    """doc_id and ids of the documents low to high: a range over sorted rows, so page and row-group bounds skip the rest."""
    return store.where(F.col("doc_id").between(low, high)).select("doc_id", "ids")


def lengths(store: DataFrame) -> DataFrame:
    """doc_id, n_tokens: two columns, no ids are read."""
    return store.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def positions(store: DataFrame) -> DataFrame:
    """file_no, file_base: ids in all earlier files. One row per file, the only thing summed in one place."""
    totals = store.groupBy("file_no").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    return totals.select("file_no", (F.sum("total").over(Window.orderBy("file_no")) - F.col("total")).alias("file_base"))


def digest(store: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False).view(np.uint8)
            ends = lists.offsets.to_numpy() * 4
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends) // 4, pa.int64()), pa.array(sums, pa.int64())], ["file_no", "doc_id", "file_start", "n_tokens", "ids_crc32"])

    rows = store.select("file_no", "doc_id", "file_start", "ids").mapInArrow(crc, "file_no int, doc_id long, file_start long, n_tokens long, ids_crc32 long")
    return rows.join(positions(store), "file_no").select("doc_id", (F.col("file_base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
