"""Exact dedup by deterministic block naming.

A text's bytes are cut into fixed-size blocks; distinct blocks are sorted into integer names; neighbouring names are
paired and pairs are named again, until one name is left for each text. Names are ranks in a sorted order of what they
name, so two texts of as many blocks share their last name exactly if they are equal: hashes only deal the work out,
and blocks (or pairs) whose hashes meet are told apart by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4096
#: Hash ranges that names are ranked in; a power of two. Each holds so small a share of the distinct hashes.
RANGES = 1 << 12


def _ranges() -> Column:
    return F.shiftrightunsigned("h", 64 - (RANGES.bit_length() - 1)).cast("int")


def _contents(content: DataFrame, keys: list[str]) -> DataFrame:
    """content (h, *keys), repeats and all, to (h, n): how many contents share a hash.

    Repeats fall out before the shuffle. Where n is 1, as it nearly always is, the hash stands for the content from here on.
    """
    distinct = content.groupBy("h", *keys).agg(F.lit(1).alias("one"))
    return distinct.groupBy("h").agg(F.count("one").alias("n"))


def _ranked(counts: DataFrame) -> DataFrame:
    """(h, n) to (h, n, name): the number of contents in earlier hash order. Counted by ranges of the hash first, so no task sorts more than a range."""
    dealt = counts.withColumn("range", _ranges())
    sizes = dealt.groupBy("range").agg(F.sum("n").alias("size"))  # RANGES rows at most
    bases = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("range").orderBy("h")) - F.col("n")
    return dealt.withColumn("within", within).join(bases, "range").select("h", "n", (F.col("base") + F.col("within")).alias("name"))


def _named(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """rows (uid, i, k, h, ...; materialised) with the name of each row's content in place of h.

    counts: contents by hash. rows have the content (keys) wherever several contents share a hash; there it decides.
    """
    named = rows.join(_ranked(counts), "h")
    rest = [c for c in keys if c in rows.columns]
    if counts.where("n > 1").isEmpty():
        return named.drop("h", "n", *rest)
    met = named.where("n > 1")
    ties = met.select("h", *keys).distinct().withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy(*keys)) - 1)
    out = named.where("n = 1").withColumn("tie", F.lit(0)).unionByName(met.join(ties, ["h", *keys]))
    return out.withColumn("name", F.col("name") + F.col("tie")).drop("h", "n", "tie", *rest)


def block_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", hashed: Column | None = None) -> DataFrame:
    """Per row of docs: uid (a number of its own), doc_id, text_sha256, k (blocks) and name; (k, name) is the text's identity.

    Null texts count as empty: one empty block. hashed: the 64-bit hash of `block`, for tests of colliding hashes.
    Numbers of rows are given in one place, a table that is written before it is used, so a lost executor can't change
    them. Tables of single levels are deleted once the identities are written.
    """
    hash_of = F.xxhash64("block") if hashed is None else hashed
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("uid", "doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("text").cast("binary").alias("bytes"))
    rows = rows.withColumn("k", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int"))
    cut = F.expr(f"transform(sequence(0, k - 1), i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))")
    blocks = rows.select("uid", "doc_id", "text_sha256", "k", F.posexplode(cut).alias("i", "block")).withColumn("h", hash_of)
    blocks = blocks.select("uid", "doc_id", "k", "i", "h", F.when(F.col("i") == 0, F.col("text_sha256")).alias("text_sha256"), "block")
    made = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(common.materialize(df, name))
        return made[-1]

    base = written(blocks.drop("block"), "blocks")
    counts = written(_contents(blocks.select("h", "block"), ["block"]), "names-0")
    met = counts.where("n > 1").select("h", F.lit(True).alias("met"))
    if not met.isEmpty():  # hardly ever: all rows are numbered and written anew, with the blocks whose hash isn't theirs alone
        base = written(blocks.join(met, "h", "left").withColumn("block", F.when(F.col("met"), F.col("block"))).drop("met"), "met-blocks")
    most = base.agg(F.max("k")).first()[0] or 0
    level = written(_named(base.drop("doc_id", "text_sha256"), counts, ["block"]), "level-0")
    done, number = [level.where("k = 1").select("uid", "name")], 0
    left = 1
    while left < most:
        number, left = number + 1, left * 2
        # k blocks have ceil(k / 2^number) names at this level; a last one without neighbour is paired with -1
        pairs = (
            level.where(F.col("k") > left // 2)
            .groupBy("uid", "k", F.expr("i div 2").alias("i"))
            .agg(F.max(F.expr("if(i % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(i % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
            .withColumn("h", F.xxhash64("a", "b"))
        )
        pairs = written(pairs, f"pairs-{number}")
        counts = written(_contents(pairs.select("h", "a", "b"), ["a", "b"]), f"names-{number}")
        level = written(_named(pairs, counts, ["a", "b"]), f"level-{number}")
        done.append(level.where((F.col("k") > left // 2) & (F.col("k") <= left)).select("uid", "name"))
    ends = done[0]
    for more in done[1:]:
        ends = ends.unionByName(more)
    out = common.materialize(base.where("i = 0").select("uid", "doc_id", "text_sha256", "k").join(ends, "uid"), "identities")
    for table in made:
        common.drop_materialized(table)
    return out


def exact_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (hex of the UTF-8), repeated.

    Of equal texts the row with the largest doc_id stays (null ids are the smallest; of rows that share that id, one).
    repeated: another row has this doc_id and this text. Null texts count as empty; columns besides id and text are left
    out, whatever their names; an empty input gives no rows.
    """
    rows = block_identities(docs, **how)
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), "uid")
    groups = rows.groupBy("k", "name").agg(F.max(order).alias("last"), F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = common.materialize(groups, "groups")  # so that both sides of the join are plain shuffles, whose hot keys AQE can split
    same = rows.groupBy("k", "name", "doc_id").agg(F.count("*").alias("same")).where("same > 1")
    out = rows.join(groups, ["k", "name"])
    if same.isEmpty():
        out = out.withColumn("repeated", F.lit(False))
    else:
        other = same.select(F.col("k").alias("k2"), F.col("name").alias("name2"), F.col("doc_id").alias("id2"))
        on = (F.col("k") == F.col("k2")) & (F.col("name") == F.col("name2")) & F.col("doc_id").eqNullSafe(F.col("id2"))
        out = out.join(other, on, "left").withColumn("repeated", F.col("k2").isNotNull())
    return out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("last.uid")).alias("kept"), "text_sha256", "repeated")


def drop_exact_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs, with one row of each text: the one with the largest doc_id (null ids are the smallest).

    Null texts count as empty; of rows that share id and text one stays, with its own values of all other columns, or
    values of its repeats where those differ. An empty input gives no rows.
    """
    found = common.materialize(exact_duplicates(docs, **how), "duplicates")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    keys = {"doc_id": F.col("doc_id").cast("long"), "text_sha256": sha}
    kept = common.without(docs, gone, keys)
    again = found.where("repeated and kept").select("doc_id", "text_sha256")
    if again.isEmpty():
        return kept
    # rows that share id and text: one of them stays
    one = common.fresh(docs, "sha")[0]
    repeated = docs.withColumn(one, sha).join(again.withColumnsRenamed({"doc_id": "_cw_id2", "text_sha256": "_cw_sha2"}), F.col("doc_id").cast("long").eqNullSafe(F.col("_cw_id2")) & (F.col(one) == F.col("_cw_sha2")), "left_semi")
    columns = [F.first(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    single = repeated.groupBy("doc_id", "text").agg(*columns) if columns else repeated.select("doc_id", "text").distinct()
    return common.without(kept, again, keys).unionByName(single.select(*docs.columns))
