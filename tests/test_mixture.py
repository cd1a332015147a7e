import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import labels, mixture


def brute(x, k, rounds, tolerance=None, floor=1e-6):
    """EM over every value, no histogram."""
    mean = np.quantile(x, [(i + 0.5) / k for i in range(k)])
    var, weight, last = np.full(k, x.var() + floor), np.full(k, 1 / k), -math.inf
    for _ in range(rounds):
        logs = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = logs.max(1)
        total = np.exp(logs - top[:, None]).sum(1)
        ll = (top + np.log(total)).mean()
        r = np.exp(logs - top[:, None]) / total[:, None]
        s = r.sum(0)
        mean = (r * x[:, None]).sum(0) / s
        var, weight = (r * (x[:, None] - mean) ** 2).sum(0) / s + floor, s / len(x)
        if tolerance is not None and abs(ll - last) < tolerance:
            break
        last = ll
    return weight, mean, var


@pytest.fixture(scope="module")
def sizes(spark):
    rng = np.random.default_rng(2)
    n = np.concatenate([rng.lognormal(3, 0.2, 300), rng.lognormal(5, 0.3, 900), rng.lognormal(6.5, 0.1, 100)]).astype(int).clip(1)
    return n, spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "cell_id long, n long").repartition(3)


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("how", [{"rounds": 12, "tolerance": None}, {"rounds": 100, "tolerance": 1e-3}])
def test_equals_em_over_all_values(sizes, k, how):
    n, df = sizes
    weight, mean, var = brute(np.log(n), k, **how)
    got = mixture.fit(df, F.log("n"), k, **how)
    np.testing.assert_allclose([c.weight for c in got], weight, rtol=1e-7)
    np.testing.assert_allclose([c.mean for c in got], mean, rtol=1e-7)
    np.testing.assert_allclose([c.variance for c in got], var, rtol=1e-6)


def test_populations_are_found(sizes):
    _, df = sizes
    parts = mixture.fit(df, F.log("n"), 3)
    for keep, at in (("smallest", 3), ("mostcommon", 5), ("largest", 6.5), ("leastcommon", 6.5)):
        assert abs(mixture.pick(parts, keep).mean - at) < 0.2
    with pytest.raises(ValueError):
        mixture.pick(parts, "middle")


def test_one_component_is_the_closed_form(sizes):
    _, df = sizes
    row = labels.size_thresholds(df).first()
    low, high = mixture.thresholds(df, 1)
    assert math.isclose(low, row["low"], rel_tol=1e-6) and math.isclose(high, row["high"], rel_tol=1e-6)


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "cell_id long, n long")
    assert mixture.fit(none, F.log("n"), 2) == [] and mixture.thresholds(none, 2) is None
    same = spark.createDataFrame([(i, 7) for i in range(5)] + [(9, None)], "cell_id long, n long")
    parts = mixture.fit(same, F.log("n"), 2)
    assert all(math.isclose(c.mean, math.log(7)) and 0 < c.variance < 1e-5 for c in parts) and math.isclose(sum(c.weight for c in parts), 1)
    with pytest.raises(ValueError):
        mixture.fit(same, F.col("n"), 0)


def test_open_sides_and_limits(spark):
    mask = spark.createDataFrame([(0, x, c) for c, n in ((1, 3), (2, 10), (3, 10), (4, 40)) for x in range(n)], "y int, x int, cell_id long")
    assert {r.cell_id for r in labels.filter_sizes(mask, (5, 20)).collect()} == {2, 3}
    assert {r.cell_id for r in labels.filter_sizes(mask, (None, 20)).collect()} == {1, 2, 3}
    wide = labels.size_outliers(mask, 0.5, upper=False, components=2, rounds=5, tolerance=None)
    assert 4 not in {r.cell_id for r in wide.collect()}
