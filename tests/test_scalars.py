import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.functions import scalar as S
from terraquant.operators.solvers import check
from terraquant.operators.sums import cdf, pdf


def test_normal_cdf_matches_the_error_function(spark):
    x = np.linspace(-9, 9, 721)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(cdf(x) - exact).max() < 1e-14
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(S.normal_cdf(F.col("x"))).collect()])
    assert np.abs(got - exact).max() < 1e-12


def test_smoothed_loss_has_its_score_as_derivative(spark):
    u = np.linspace(-3, 3, 61)
    tau, h, d = 0.3, 0.4, 1e-5
    loss = lambda v: v * (tau - 1 + cdf(v / h)) + h * pdf(v / h)
    assert np.abs((loss(u + d) - loss(u - d)) / (2 * d) - (tau - 1 + cdf(u / h))).max() < 1e-5
    df = spark.createDataFrame([(float(v),) for v in u], "u double")
    got = [r[0] for r in df.select(S.smooth_loss(F.col("u"), tau, h)).collect()]
    assert np.allclose(got, loss(u), atol=1e-12)


def test_check_loss_and_density(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "u double")
    rows = df.select(S.check_loss(F.col("u"), 0.25).alias("r"), S.ald_density(F.col("u"), 2.0, 0.25).alias("f")).collect()
    assert [r["r"] for r in rows] == [1.5, 0.0, 0.75, None]
    assert rows[0]["f"] == pytest.approx(0.25 * 0.75 / 2 * math.exp(-0.75))
    assert check(np.array([-2.0, 3.0]), 0.25).tolist() == [1.5, 0.75]


def test_softmax_is_stable_and_entropy_is_relative(spark):
    df = spark.createDataFrame([(0.0, 0.0), (800.0, -800.0)], "a double, b double")
    p = S.softmax([F.col("a"), F.col("b")])
    rows = df.select(F.array(*p).alias("p"), S.entropy(p).alias("h"), S.first_max(p).alias("k")).collect()
    assert rows[0]["p"] == pytest.approx([1 / 3] * 3) and rows[0]["h"] == pytest.approx(1.0) and rows[0]["k"] == 1
    assert rows[1]["p"] == pytest.approx([0, 1, 0]) and rows[1]["k"] == 2


def test_matern_validates(spark):
    with pytest.raises(ValueError):
        S.matern(F.lit(1.0), 0.0, 0.5)
    with pytest.raises(ValueError):
        S.matern(F.lit(1.0), 1.0, 2.5)


def test_interval_is_credible_only_with_a_finite_error(spark):
    df = spark.createDataFrame([(2.0, 0.5), (2.0, 5.0), (2.0, None), (2.0, float("nan"))], "e double, s double")
    assert [r[0] for r in df.select(S.interval(F.col("e"), F.col("s"), 1.96)[2]).collect()] == [True, False, False, False]
