"""Token counts by a dynamic programme over prefixes: any truncation or budget question is a look into its stored table.

The table holds, for each text, the exact tokens of its first 1, 2, ... characters. Counts hardly differ from one
character to the next, so Parquet's delta coding stores an entry in about a bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .prefixes import PrefixCounter
from .tokens import word_bpe_path

TABLE = "doc_id long, n_bytes long, prefix_tokens array<int>"
#: Delta-coded integers; row groups small enough that a reader holds few long texts' tables at once.
FORMAT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10)}
#: Text bytes whose table is built at once: four bytes an entry, a few times over.
SLICE_BYTES = 2 << 20
#: Entries of a table in which the last one within a budget mostly lies, from the first one at the budget on.
NEAR = 64


def prefix_table(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), prefix_tokens: the tokens of the text's first 1, 2, ... characters, each as the library has them for that prefix alone.

    Null texts count as empty: no bytes, an empty table. Special strings inside a text count as the library's default has
    it. Null and repeated ids are kept row by row, an empty input gives no rows, other columns are left out whatever their
    names. Where docs are read the table is made; nothing is shuffled.
    """
    path = vocabulary or word_bpe_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(path)
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).fill_null("")
                tokens, at = counter.table(texts)
                yield pa.record_batch([part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens, pa.int32()))], ["doc_id", "n_bytes", "prefix_tokens"])
                pa.default_memory_pool().release_unused()  # what a slice has freed doesn't stay with the worker

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, TABLE)


def write_prefix_table(docs: DataFrame, path: str, **how) -> None:
    prefix_table(docs, **how).write.options(**FORMAT).parquet(path)


def read_prefix_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path)


def within(table: DataFrame, budget: int) -> DataFrame:
    """Per row of the table: doc_id, n_bytes, n_tokens, over_limit (n_tokens > budget), fit_chars and fit_tokens: characters and tokens of the longest prefix of at most `budget` tokens.

    Counts may fall from one prefix to the next (when a special string or a longer word is completed), so the last entry
    within the budget is taken, not the first beyond it. A budget below the first character's tokens fits no character.
    """

    chars = F.size("prefix_tokens")
    n_tokens = F.when(chars > 0, F.element_at("prefix_tokens", F.greatest(chars, F.lit(1)))).otherwise(0)
    # texts beyond the budget only: steps over the few entries from the first one at the budget on, where no later one is
    # within it; else one pass over all that holds no second array
    start = lambda at: F.struct(at.alias("at"), F.lit(0).alias("fit"), F.lit(0).alias("tokens"))
    take = lambda acc, n: F.when(n <= budget, F.struct((acc["at"] + 1).alias("at"), (acc["at"] + 1).alias("fit"), n.alias("tokens"))).otherwise(F.struct((acc["at"] + 1).alias("at"), acc["fit"].alias("fit"), acc["tokens"].alias("tokens")))
    last = lambda entries, at: F.aggregate(entries, start(at), take, lambda acc: F.struct(acc["fit"].alias("fit"), acc["tokens"].alias("tokens")))
    first = F.array_position("prefix_tokens", F.lit(budget)).cast("int")
    part = lambda at, n: F.when((F.col("n_tokens") > budget) & (F.col("first") > 0), F.slice("prefix_tokens", F.greatest(at, F.lit(1)), n))
    later = F.array_min(part(F.col("first") + NEAR, chars))
    fit = (
        F.when(F.col("n_tokens") <= budget, F.struct(chars.alias("fit"), F.col("n_tokens").alias("tokens")))
        .when((F.col("first") > 0) & (F.coalesce(F.col("later"), F.lit(budget + 1)) > budget), last(F.col("near"), F.col("first") - 1))
        .otherwise(last(F.col("prefix_tokens"), F.lit(0)))
    )
    rows = table.select("doc_id", "n_bytes", "prefix_tokens", n_tokens.alias("n_tokens"))
    rows = rows.withColumn("first", F.when(F.col("n_tokens") > budget, first))
    rows = rows.withColumns({"near": part(F.col("first"), F.lit(NEAR)), "later": later}).withColumn("fit", fit)
    return rows.select("doc_id", "n_bytes", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("n_tokens") > budget).alias("over_limit"), F.col("fit.fit").cast("long").alias("fit_chars"), F.col("fit.tokens").cast("long").alias("fit_tokens"))


def tokens_up_to(table: DataFrame, n_chars: int) -> DataFrame:
    """doc_id, n_tokens of each text's first n_chars characters (of all, where it has no more)."""
    k = F.least(F.lit(n_chars), F.size("prefix_tokens"))
    return table.select("doc_id", F.when(k > 0, F.element_at("prefix_tokens", F.greatest(k, F.lit(1)))).otherwise(0).cast("long").alias("n_tokens"))


def truncate(docs: DataFrame, budget: int, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and the longest prefix of its text, ending at any character, of at most `budget` tokens.

    Cut where the row's prefix counts are made, so null and repeated ids are kept row by row and nothing is joined; null
    texts become empty, other columns are left out, an empty input gives no rows.
    """
    path = vocabulary or word_bpe_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(path)
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).fill_null("")
                tokens, at = counter.table(texts)
                fits = [np.flatnonzero(tokens[a:b] <= budget) for a, b in zip(at[:-1], at[1:], strict=True)]
                kept = [t[: int(f[-1]) + 1] if len(f) else "" for t, f in zip(texts.to_pylist(), fits, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, text string")


def truncated(table: DataFrame, docs: DataFrame, budget: int) -> DataFrame:
    """doc_id and the longest prefix of each text, ending at any character, of at most `budget` tokens; no text is encoded again. Ids are unique and not null."""
    ends = within(table, budget).select("doc_id", F.col("fit_chars").cast("int").alias("_cw_end"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(ends, "doc_id").select("doc_id", F.col("text").substr(F.lit(1), F.col("_cw_end")).alias("text"))
