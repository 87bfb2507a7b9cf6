"""Simulated tables with known truth, generated on the executors: draws depend on seed and row number alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquant.functions.scalar import ald_draw, normal_draw, softmax, uniform_draw


def _centred_noise(df: DataFrame, tau: float, sd: float, seed: int, error: str) -> DataFrame:
    """Adds eps, shifted so that its empirical tau-quantile is 0."""
    raw = normal_draw(F.col("row"), seed) * sd if error == "normal" else ald_draw(uniform_draw(F.col("row"), seed), tau, sd)
    df = df.withColumn("eps", raw)
    shift = df.agg(F.percentile("eps", F.lit(tau)).alias("q")).first()["q"]
    return df.withColumn("eps", F.col("eps") - (shift or 0.0))


def _choose(probs: list[Column], u: Column) -> Column:
    out, run = None, F.lit(0.0)
    for k, p in enumerate(probs[:-1], 1):
        run = run + p
        out = F.when(u < run, k) if out is None else out.when(u < run, k)
    return F.lit(1) if out is None else out.otherwise(len(probs))


def mixture(spark: SparkSession, n: int = 400, G: int = 2, tau: float = 0.5, gate_slope: float = 2.0, coef_slope: float = 0.0, sep: float = 3.0, sd: float = 0.4, crossing: bool = False, error: str = "normal", seed: int = 1) -> DataFrame:
    """row, s1, s2, x, x2, z (regime), q (its quantile), y: a mixture whose shares and slopes vary over the unit square."""
    df = spark.range(n).withColumnRenamed("id", "row").select("row", uniform_draw(F.col("row"), seed).alias("s1"), uniform_draw(F.col("row"), seed + 1).alias("s2"), normal_draw(F.col("row"), seed + 2).alias("x"), normal_draw(F.col("row"), seed + 3).alias("x2"), uniform_draw(F.col("row"), seed + 4).alias("u"))
    scores = [F.lit(-0.3) + gate_slope * 2 * (F.col("s1") - 0.5), F.lit(-0.3) + gate_slope * 2 * (F.col("s2") - 0.5)][: G - 1]
    df = df.withColumn("z", _choose(softmax(scores), F.col("u")))
    first, s = F.col("z") == 1, F.col("s1")
    if crossing:
        slope = F.when(first, coef_slope * (2 * s - 1) + 1).otherwise(-coef_slope * (2 * s - 1) + 2)
    else:
        slope = F.when(first, 0.5 + coef_slope * s).otherwise(-2 - coef_slope * s)
    df = df.withColumn("slope_x", slope).withColumn("q", (F.col("z") - 1) * sep + F.col("slope_x") * F.col("x") + 0.5 * F.col("x2"))
    return _centred_noise(df, tau, sd, seed + 5, error).withColumn("y", F.col("q") + F.col("eps")).drop("u", "eps")


def lattice_precision(side: int, alpha: float = 0.95) -> np.ndarray:
    n = side * side
    w = np.zeros((n, n))
    for r in range(side):
        for c in range(side):
            i = r * side + c
            for a, b in ((r + 1, c), (r, c + 1)):
                if a < side and b < side:
                    w[i, a * side + b] = w[a * side + b, i] = 1
    return alpha * (np.diag(w.sum(1)) - w) + (1 - alpha) * np.eye(n)


def car_lattice(spark: SparkSession, n: int = 600, side: int = 8, G: int = 1, tau: float = 0.5, alpha: float = 0.95, spread: float = 1.5, sep: float = 3.0, sd: float = 0.4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, truth): rows row, unit, y, x, x2, z; truth unit, x, y (lattice), phi_1..phi_G drawn from the Leroux field."""
    rng = np.random.default_rng(seed)
    value, vector = np.linalg.eigh(lattice_precision(side, alpha))
    phi = (vector / np.sqrt(value)) @ vector.T @ rng.normal(size=(side * side, G))
    phi = (phi - phi.mean(0)) / phi.std(0, ddof=1) * spread
    cells = [(i + 1, i % side + 1, i // side + 1, *map(float, phi[i])) for i in range(side * side)]
    truth = spark.createDataFrame(cells, "unit long, x int, y int, " + ", ".join(f"phi_{k + 1} double" for k in range(G)))
    df = spark.range(n).withColumnRenamed("id", "row").select("row", (F.floor(uniform_draw(F.col("row"), seed) * side * side) + 1).cast("long").alias("unit"), normal_draw(F.col("row"), seed + 1).alias("x"), normal_draw(F.col("row"), seed + 2).alias("x2"), (F.floor(uniform_draw(F.col("row"), seed + 3) * G) + 1).cast("int").alias("z"))
    slopes = [0.8] if G == 1 else [0.8, -1.2, 0.3][:G]
    k = F.col("z") - 1
    df = df.join(F.broadcast(truth.drop("x", "y")), "unit")
    field = F.element_at(F.array(*(F.col(f"phi_{g + 1}") for g in range(G))), F.col("z"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("z"))
    df = df.withColumn("q", k * sep + slope * F.col("x") + 0.5 * F.col("x2") + field)
    df = _centred_noise(df, tau, sd, seed + 4, "normal").withColumn("y", F.col("q") + F.col("eps"))
    return df.select("row", "unit", "y", "x", "x2", "z"), truth


def confounded(spark: SparkSession, n: int = 400, beta: float = 1.0, confound: float = 1.0, amp: float = 2.0, freq: float = 6.0, sd: float = 0.4, seed: int = 1) -> DataFrame:
    """row, s1, s2, f, x, y: a covariate that follows the unmeasured surface f."""
    df = spark.range(n).withColumnRenamed("id", "row").select("row", uniform_draw(F.col("row"), seed).alias("s1"), uniform_draw(F.col("row"), seed + 1).alias("s2"), normal_draw(F.col("row"), seed + 2).alias("e1"), normal_draw(F.col("row"), seed + 3).alias("e2"))
    df = df.withColumn("f", F.sin(freq * F.col("s1")) + F.cos(freq * F.col("s2"))).withColumn("x", confound * F.col("f") + 0.6 * F.col("e1"))
    return df.withColumn("y", 1 + beta * F.col("x") + amp * F.col("f") + sd * F.col("e2")).drop("e1", "e2")


def laplace(spark: SparkSession, n: int, tau: float = 0.5, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), ald_draw(uniform_draw(F.col("id"), seed), tau, sigma).alias("e"))
