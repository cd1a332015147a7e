"""URL filters: a blocked Bloom filter of listed canonical URL prefixes, then an exact hash join.

A rule is a host and the start of a path; it fits its host and all subdomains. A URL asks for each of its host's
suffixes with each of its path's prefixes whose length occurs among the rules. A key's block is one row of the filter
(eight 64-bit words), so probing is one equi-join on the block number and eight bit tests; what passes is joined to the
rules themselves. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits set for a key: one in each 64-bit word of its 512-bit block.
WORDS = 8
#: Keys a block takes on average; about 1 false positive in 2,000.
KEYS_A_BLOCK = 24
#: Rules, and bytes of their hosts and paths, up to which filter and rules are sent to all executors; larger lists are joined by shuffles.
SENT_RULES, SENT_BYTES = 100_000, 8 << 20
#: The named rules of the production filter: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; both empty for null or where there is no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _key(host: Column | str, path: Column | str) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int")


def bloom_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7: a row per block that a rule falls in."""
    key = _key("host", "path")
    words = [F.bit_or(F.expr(f"shiftleft(1L, bit{w})")).alias(f"w{w}") for w in range(WORDS)]
    return rules.select(_block(key, blocks).alias("block"), *[_bit(key, w).alias(f"bit{w}") for w in range(WORDS)]).groupBy("block").agg(*words)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (like net/; null where none fits) and verdict, a row per row of pages.

    The longest rule wins: by host and path together, then by host; of repeated rules (hosts compare without A-Z case),
    the least verdict. Rules with a null host or path never fit; a null verdict counts as the default. A null url, or one
    without ://, has an empty host and path. Null and repeated ids are judged row by row; other columns of pages are left
    out, whatever their names; no pages give no rows. Filter and rules are counted first and sent to all executors if
    they are small (SENT_RULES, SENT_BYTES). Empty rules give the default.
    """
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host")
    stated = rules.where("host is not null and path is not null").select(lower, "path", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    listed = stated.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))  # once hosts are lower-cased: ORG and org are one rule
    bytes_ = F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))
    depth, longest = F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)), F.coalesce(F.max(F.length("host")), F.lit(0))
    shape = listed.agg(F.count("*").alias("n"), bytes_.alias("bytes"), F.collect_set(F.length("path")).alias("lengths"), depth.alias("depth"), longest.alias("longest")).first()
    sent = F.broadcast if shape["n"] <= SENT_RULES and shape["bytes"] <= SENT_BYTES else lambda side: side
    blocks = max(1, -(-shape["n"] // KEYS_A_BLOCK))
    lengths = F.array(*[F.lit(int(x)) for x in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<int>")

    host, path = split_url(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # no more suffixes than the deepest rule has labels, and none longer than the longest: work per url doesn't grow with its host
    labels = F.slice(F.reverse(F.split("host", r"\.")), F.lit(1), F.lit(max(shape["depth"], 1)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i)), "."))
    suffixes = F.filter(suffixes, lambda s: F.length(s) <= shape["longest"])
    starts = F.filter(lengths, lambda n: n <= F.length("path"))
    asked = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.struct(s.alias("ask_host"), F.col("path").substr(F.lit(1), n).alias("ask_path")))))
    asked = rows.select("*", F.explode_outer(asked).alias("ask")).select("uid", "page_id", "host", "path", "ask.*")
    key = _key("ask_host", "ask_path")
    probes = asked.select("*", _block(key, blocks).alias("block"), *[_bit(key, w).alias(f"bit{w}") for w in range(WORDS)])
    passes = F.lit(True)
    for w in range(WORDS):
        passes = passes & (F.expr(f"shiftright(w{w}, bit{w}) & 1L") == 1)
    possible = probes.join(sent(bloom_filter(listed, blocks)), "block", "left").withColumn("possible", F.coalesce(passes, F.lit(False)))
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    hit = possible.join(sent(exact), F.col("possible") & (F.col("ask_host") == F.col("rule_host")) & (F.col("ask_path") == F.col("rule_path")), "left")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hit.groupBy("uid", "page_id", "host", "path").agg(F.max(F.when(F.col("rule_host").isNotNull(), rank)).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def drop_blocked(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages whose verdict isn't block; page_id tells rows apart (rows that share one share the strictest verdict)."""
    gone = judge_urls(pages, rules, default).where("verdict = 'block'").select("page_id").distinct()
    return common.without(pages, gone, {"page_id": F.col("page_id")})
