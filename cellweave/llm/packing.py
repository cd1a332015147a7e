"""Best-fit packing of documents into fixed-length training sequences.

Best fit is planned over a histogram of piece lengths (at most `capacity` numbers, whatever the corpus), so the plan is
a bounded list of runs: "ranks a..b of length n go q to a sequence, from sequence s on". Documents then take their slots
by their rank within their length. Ranks come from counts by (length, salt), so no length, however common, meets in one
task; the plan's runs are cut to the same salts and joined there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import PieceEncoder, byte_bpe_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Text bytes encoded at once.
SLICE_BYTES = 2 << 20
#: Pieces of one length that are ranked in one window; a commoner length is dealt over as many as it takes. Windows whose counts are summed at once.
RANKED_AT_ONCE, SUMMED_AT_ONCE = 500, 1000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only those over capacity are cut; the first piece takes the remainder."""
    rest = n % capacity
    return [rest] * (rest > 0) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", release: bool = False) -> DataFrame:
    """One row per piece of each document's ids (end_id after each document); the ids themselves stay as a checksum.

    Null texts count as empty (a piece with end_id alone); null or repeated ids are kept row by row.
    release: workers give known pieces back after each task, as other work follows; it costs some encoding.
    """
    path = vocabulary or byte_bpe_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = PieceEncoder.of(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in common.slices(batch, 1, SLICE_BYTES):
                flat, at = encoder.ids(part.column(1))
                doc, piece, start, length, crc = [], [], [], [], []
                for k, key in enumerate(part.column(0).to_pylist()):
                    ids, begun = flat[at[k] : at[k + 1]].tobytes() + end, 0
                    for i, n in enumerate(cut_lengths(len(ids) >> 2, capacity)):
                        doc.append(key)
                        piece.append(i)
                        start.append(begun)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * begun : 4 * (begun + n)]))
                        begun += n
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
                pa.default_memory_pool().release_unused()  # what a slice has freed doesn't stay with the worker
        if release:
            encoder.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encode, PIECES)


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram: (length, first rank, ranks, first sequence, ranks a sequence, offset).

    Open sequences are kept as (room, first sequence, number) of neighbouring sequences filled alike; the longest
    lengths go first, each into the least room that takes it. Each length splits two such groups at most, so their
    number is below 2 * capacity + 2 and doesn't depend on the corpus.
    """
    runs, groups, opened = [], [], 0  # groups: sorted by room, then first sequence
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if length > capacity or length <= 0:
            raise ValueError(f"no sequence of {capacity} takes a piece of {length}")
        while left:
            k = bisect_left(groups, (length,))
            if k == len(groups):
                per = capacity // length
                room, first, number, new = capacity, opened, -(-left // per), True
                opened += number
            else:
                room, first, number = groups.pop(k)
                per, new = room // length, False
            offset = capacity - room
            full = min(number, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, offset))
                rank, left = rank + full * per, left - full * per
                if room - per * length:
                    insort(groups, (room - per * length, first, full))
            rest = number - full
            if rest and left and left < per:  # one more sequence takes what is left
                runs.append((length, rank, left, first + full, left, offset))
                insort(groups, (room - left * length, first + full, 1))
                rank, left, rest, full = rank + left, 0, rest - 1, full + 1
            if rest:
                assert not new
                insort(groups, (room, first + full, rest))
    return runs


def assign_slots(pieces: DataFrame, capacity: int = 2048, ranked_at_once: int = RANKED_AT_ONCE) -> DataFrame:
    """pieces (doc_id, piece, length, ...; materialised, as it is read three times) with sequence_id and offset.

    Each length has as many salts as its count asks for, dealt by the number that a piece has in its table, so neither
    the windows nor the counts by salt depend on how common a length is or on what the ids are, null or repeated ones
    included. Pieces of a length may take each other's slots; every piece has exactly one. An empty input gives no rows.
    """
    spark = pieces.sparkSession
    bucket, salts, local, base, row = common.fresh(pieces, "bucket", "salts", "local", "base", "row")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    of_length = spark.createDataFrame([(n, max(1, -(-k // ranked_at_once))) for n, k in histogram.items()], f"length long, {salts} long")
    numbered = pieces.withColumn(row, F.monotonically_increasing_id())  # the same in each read of a written table
    dealt = numbered.join(F.broadcast(of_length), "length").withColumn(bucket, F.pmod(F.xxhash64(row), F.col(salts)))
    counts = dealt.groupBy("length", bucket).agg(F.count("*").alias("n"))
    counts = common.materialize(counts, "pack-counts")
    runs = spark.createDataFrame(plan_runs(histogram, capacity), "length long, run_rank long, run_n long, run_sequence long, per long, run_offset long")
    group = F.floor(F.col(bucket) / SUMMED_AT_ONCE).alias("group")
    groups = counts.groupBy("length", group).agg(F.sum("n").alias("group_n"))
    groups = groups.withColumn("group_base", F.sum("group_n").over(Window.partitionBy("length").orderBy("group")) - F.col("group_n")).drop("group_n")
    before = Window.partitionBy("length", "group").orderBy(bucket)
    bases = counts.withColumn("group", group).join(groups, ["length", "group"]).withColumn(base, F.col("group_base") + F.sum("n").over(before) - F.col("n"))
    cut = (
        bases.join(runs, "length")
        .where((F.col("run_rank") < F.col(base) + F.col("n")) & (F.col("run_rank") + F.col("run_n") > F.col(base)))
        .select("length", bucket, base, "run_rank", "run_n", "run_sequence", "per", "run_offset")
    )
    ranked = dealt.withColumn(local, F.row_number().over(Window.partitionBy("length", bucket).orderBy(row)) - 1)
    at = F.col(base) + F.col(local)
    keys = ["length", bucket]
    taken = ranked.join(cut.select(*keys, base, *[F.col(c) for c in ("run_rank", "run_n", "run_sequence", "per", "run_offset")]), keys)
    taken = taken.where((at >= F.col("run_rank")) & (at < F.col("run_rank") + F.col("run_n")))
    nth = at - F.col("run_rank")
    return taken.select(
        *pieces.columns,
        (F.col("run_sequence") + F.expr(f"({base} + {local} - run_rank) div per")).alias("sequence_id"),
        (F.col("run_offset") + nth % F.col("per") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, release: bool = False) -> DataFrame:
    """All documents packed into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty (a
    piece of end_id alone); null and repeated ids are packed row by row; columns of docs besides doc_id and text are left
    out, whatever their names; no documents give no rows.
    """
    pieces = common.materialize(token_pieces(docs, capacity, end_id, vocabulary, release=release), "pieces")
    return assign_slots(pieces, capacity)
