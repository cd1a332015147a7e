"""Queries of size populations: mixtures fitted to log sizes, their thresholds, and the labels beyond them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, mixture
from ..sources import adapters as A
from ..sources.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rounds of the registered fits; fixed, so that SQL takes as many.
ROUNDS = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _em(k: int, rounds: int = ROUNDS) -> str:
    """WITH RECURSIVE clause: sizes of nuclei, and `fitted` (w0, m0, s0, ...), the components after all rounds."""
    each = lambda text: ", ".join(text.replace("#", str(i)) for i in range(k))
    start = ", ".join(f"{1 / k}::DOUBLE AS w{i}, quantile_cont(ln(n), {(i + 0.5) / k}) AS m{i}, var_pop(ln(n)) + 1e-6 AS s{i}" for i in range(k))
    new = each("sum(c * r#) / sum(c) AS w#, any_value(m#) + sum(c * r# * (v - m#)) / sum(c * r#) AS m#, greatest(sum(c * r# * pow(v - m#, 2)) / sum(c * r#) - pow(sum(c * r# * (v - m#)) / sum(c * r#), 2), 0) + 1e-6 AS s#")
    top = f"greatest({each('l#')})" if k > 1 else "l0"
    total = " + ".join(f"exp(l{i} - top)" for i in range(k))
    return f"""{with_views('px', 'nuc').replace('WITH', 'WITH RECURSIVE', 1)}, sizes AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY cell_id), h AS (SELECT ln(n) AS v, count(*) AS c FROM sizes GROUP BY 1),
        em AS (SELECT 0 AS it, {start} FROM sizes UNION ALL
            SELECT it + 1, {new} FROM (SELECT *, {each('exp(l# - top) / total AS r#')} FROM (SELECT *, {total} AS total FROM (SELECT *, {top} AS top FROM
                (SELECT *, {each('ln(w#) - 0.5 * ln(2 * pi() * s#) - pow(v - m#, 2) / (2 * s#) AS l#')} FROM em, h WHERE it < {rounds})))) GROUP BY it),
        fitted AS (SELECT * FROM em WHERE it = {rounds})"""


def _sizes(spark, d):
    return labels.label_sizes(A.nuclei(A.pixels(spark, d)))


_INTERVAL = "exp(m - 1.959963984540054 * sqrt(s)) AS low, exp(m + 1.959963984540054 * sqrt(s)) AS high"


def _kept(k: int, column: str, order: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS k, w{i} AS w, m{i} AS m, s{i} AS s FROM fitted" for i in range(k))
    return f"kept AS (SELECT {_INTERVAL} FROM ({rows}) ORDER BY {column} {order}, k LIMIT 1)"


@query(f"{_em(3)} SELECT * FROM ({' UNION ALL '.join(f'SELECT {i} AS k, round(w{i}, 6) AS weight, round(m{i}, 6) AS mean, round(s{i}, 6) AS variance FROM fitted' for i in range(3))})")
def a7_mixture_components(spark, d):
    """Three Gaussians over the log sizes of nuclei."""
    parts = mixture.fit(_sizes(spark, d), F.log("n"), 3, ROUNDS, None)
    return spark.createDataFrame([(k, round(c.weight, 6), round(c.mean, 6), round(c.variance, 6)) for k, c in enumerate(parts)], "k int, weight double, mean double, variance double")


@query(f"{_em(2)}, {_kept(2, 'w', 'DESC')} SELECT cell_id, n FROM sizes, kept WHERE n < low OR n > high")
def f8_mixture_outliers(spark, d):
    """Nuclei beyond the central 95 % of the commoner of two populations."""
    return labels.size_outliers(A.nuclei(A.pixels(spark, d)), components=2, keep="mostcommon", rounds=ROUNDS, tolerance=None)


@query(f"{_em(2)}, {_kept(2, 'm', 'ASC')} SELECT image_id, y, x, cell_id FROM nuc WHERE cell_id IN (SELECT cell_id FROM sizes, kept WHERE n BETWEEN low AND high)")
def f20_population_mask(spark, d):
    """The mask of nuclei of the smaller population."""
    return labels.filter_sizes(A.nuclei(A.pixels(spark, d)), components=2, keep="smallest", rounds=ROUNDS, tolerance=None)


@query(f"{with_views('px', 'nuc')}, sizes AS (SELECT cell_id, count(*) AS n FROM nuc GROUP BY cell_id) SELECT image_id, y, x, cell_id FROM nuc WHERE cell_id IN (SELECT cell_id FROM sizes WHERE n >= 12)")
def f19_size_limits(spark, d):
    """given limits, the upper one left open."""
    return labels.filter_sizes(A.nuclei(A.pixels(spark, d)), (12, None))
