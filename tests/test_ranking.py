import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import ranking
from cellweave.operators import metrics, plates


@pytest.mark.parametrize("slices", [64, 1024, 4096])
def test_running_sum_in_any_number_of_slices(spark, tmp_path, slices):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([rng.gauss(0, 1e6), rng.randint(0, 5)])), rng.randint(0, 9)) for k in range(3000)]
    spark.createDataFrame(rows, "id long, o double, v long").write.parquet(str(tmp_path / "rows"))
    got = ranking.running_sum(spark.read.parquet(str(tmp_path / "rows")), "o", "v", slices=slices, ties=["id"]).collect()
    total, want = 0, {}
    for k, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k], total = total, total + v
    assert {r["id"]: r["before"] for r in got} == want
    assert ranking.running_sum(spark.createDataFrame([], "id long, o double"), "o").count() == 0


def test_curve_tells_close_scores_apart(spark, tmp_path):
    """Scores that differ in the ninth place: every one is a threshold."""
    rows = [(k % 2, 1e-9 * k) for k in range(100)]
    spark.createDataFrame(rows, "truth long, score double").write.parquet(str(tmp_path / "rows"))
    got = metrics.roc_pr_auc(spark.read.parquet(str(tmp_path / "rows"))).first()
    wins = sum(a > b for t, a in rows if t for u, b in rows if not u)
    assert abs(got["roc_auc"] - wins / 2500) < 1e-12


def test_measurements_in_order_of_time_then_name(spark):
    names = ["b-2024-01-02T03_04_05", "a-2024-01-02T03_04_05", "z-2023-12-31T23_59_59", "no time", "c-2025-01-01T00_00_00"]
    got = plates.measurement_order(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [r["path"] for r in sorted(got, key=lambda r: r["rank"])] == ["no time", names[2], names[1], names[0], names[4]]


def test_an_order_is_worked_out_once_a_row(spark):
    """the bounds are compared with a value, not each with the expression behind it."""
    rows = spark.range(300).select(F.date_format(F.timestamp_seconds(1_500_000_000 + F.col("id") * 977), "yyyy-MM-dd'T'HH_mm_ss").alias("path"))
    out = plates.measurement_order(rows)
    assert [r["rank"] for r in out.orderBy("path").collect()] == list(range(300))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    compared = plan[plan.index("filter([") : plan.index("AS _slice")]
    assert "_seconds" not in compared and "timestamp" not in compared
