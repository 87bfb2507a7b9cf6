"""Permutation test of Moran's I."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraquant.session import reachable


def statistic(z: np.ndarray, w: np.ndarray) -> float:
    c = z - z.mean()
    return float(len(z) / w.sum() * (c @ w @ c) / (c @ c))


def _usable(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    ok = np.isfinite(z)
    z, w = z[ok], w[np.ix_(ok, ok)]
    return z, w, len(z) >= 3 and w.sum() > 0 and z.std() > 0


def permutation_test(z: np.ndarray, w: np.ndarray, nsim: int = 999, seed: int = 1) -> tuple[float | None, float | None, int]:
    """(statistic, p, units): two-sided by absolute value; None where there are under three units or no weights."""
    z, w, fine = _usable(z, w)
    if not fine:
        return None, None, len(z)
    rng, got = np.random.default_rng(seed), statistic(z, w)
    hits = sum(abs(statistic(rng.permutation(z), w)) >= abs(got) - 1e-15 for _ in range(nsim))
    return got, (1 + hits) / (nsim + 1), len(z)


def distributed_test(spark, z: np.ndarray, w: np.ndarray, nsim: int = 999, seed: int = 1) -> DataFrame:
    """One row per permutation (sim, statistic), permutations spread over tasks; the units' graph is broadcast (dense, for up to a few thousand units)."""
    z, w, fine = _usable(z, w)
    shared = reachable(spark).sparkContext.broadcast((z, w))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zz, ww = shared.value
        for pdf in parts:
            yield pd.DataFrame({"sim": pdf["id"], "statistic": [statistic(np.random.default_rng([seed, int(i)]).permutation(zz), ww) for i in pdf["id"]]})

    return spark.range(nsim if fine else 0).mapInPandas(run, "sim long, statistic double")


def permutation_statistics(values: DataFrame, edges: DataFrame, nsim: int = 999, seed: int = 1) -> DataFrame:
    """(sim, statistic): Moran's I of values (unit, z) over edges (i, j, w) as they are (sim 0) and permuted nsim times.

    A permutation deals the values by the checksums of seed, permutation and unit, so any partitioning gives the same. Units
    whose value is null or not a number are left out with their edges. One task sorts the units of one permutation.
    """
    known = values.where("z IS NOT NULL AND NOT isnan(z)").select("unit", F.col("z").cast("double").alias("z"))
    each = known.select(F.explode(F.sequence(F.lit(0), F.lit(nsim))).alias("sim"), "unit", "z")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("unit").cast("string")).cast("binary"))
    numbered = each.withColumn("own", F.row_number().over(Window.partitionBy("sim").orderBy("unit"))).withColumn("dealt", F.row_number().over(Window.partitionBy("sim").orderBy(mark, "unit")))
    numbered = numbered.withColumn("dealt", F.when(F.col("sim") == 0, F.col("own")).otherwise(F.col("dealt")))
    dealt = numbered.select("sim", "unit", F.col("dealt").alias("at")).join(numbered.select("sim", F.col("own").alias("at"), "z"), ["sim", "at"])
    means = known.agg(F.avg("z").alias("m"), F.count("*").alias("n"))
    centred = dealt.crossJoin(F.broadcast(means)).select("sim", "unit", (F.col("z") - F.col("m")).alias("c"), "n")  # one row
    used = edges.select("i", "j", F.col("w").cast("double").alias("w"))
    left, right = centred.select("sim", F.col("unit").alias("i"), F.col("c").alias("ci"), "n"), centred.select("sim", F.col("unit").alias("j"), F.col("c").alias("cj"))
    cross = left.join(used, "i").join(right, ["sim", "j"]).groupBy("sim").agg(F.sum(F.col("ci") * F.col("w") * F.col("cj")).alias("a"), F.sum("w").alias("s0"), F.first("n").alias("n"))
    spread = centred.groupBy("sim").agg(F.sum(F.col("c") * F.col("c")).alias("q"))
    return cross.join(spread, "sim").where("s0 > 0 AND q > 0").select("sim", (F.col("n") / F.col("s0") * F.col("a") / F.col("q")).alias("statistic"))


def permutation_p(statistics: DataFrame) -> DataFrame:
    """One row (statistic, p_value, nsim) from permutation_statistics: two-sided by absolute value; none without statistics."""
    seen = statistics.where("sim = 0").select(F.col("statistic").alias("seen"))
    both = statistics.where("sim > 0").crossJoin(F.broadcast(seen))  # one row
    hits = F.sum((F.abs("statistic") >= F.abs("seen") - 1e-15).cast("int"))
    return both.groupBy(F.col("seen").alias("statistic")).agg(((1 + hits) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("nsim"))
