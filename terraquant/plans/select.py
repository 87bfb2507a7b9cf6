"""Grid search over the number of regimes and penalties, by information criterion or cross-validation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquant.functions.scalar import check_loss
from terraquant.operators.rows import balanced_folds, normalize_weights
from terraquant.plans.model import Fitted, SpatialQuantileMixture
from terraquant.session import stored


@dataclass
class Selection:
    fit: Fitted
    best: tuple
    criterion: str
    table: DataFrame


def select_model(base: SpatialQuantileMixture, df: DataFrame, key: str, G_grid=(2, 3), lambda_gate_grid=(1.0,), lambda_coef_grid=(1.0,), lambda_error_grid=(0.1, 1.0, 10.0), criterion: str = "bic", folds: int = 5) -> Selection:
    """Fit every cell of the grid, score it (BIC, or weighted check loss over folds by a hash of key), refit the best.

    A fold whose fit fails scores infinity. The kernel density method has no likelihood and uses folds. A prebuilt
    graph cannot be cut into folds, so it needs bic.
    """
    if criterion not in ("bic", "cv"):
        raise ValueError("criterion must be bic or cv")
    if base.method == "kde":
        criterion = "cv"
    if criterion == "cv" and base.spatial_error is not None and base.spatial_error.edges is not None and not base.region:
        raise ValueError("cross-validation cannot use a prebuilt graph of points")
    if base.spatial_error is not None and base.spatial_gate is None:
        base = replace(base, spatial_gate=False)
    errors = lambda_error_grid if base.spatial_error is not None else (None,)
    if criterion == "cv":
        df = stored(balanced_folds(df, folds, key), "folds")
    rows, kept = [], (None, math.inf)  # the first fit with the least criterion, which need not be made again
    for g, lg, lc, le in product(G_grid, lambda_gate_grid, lambda_coef_grid, errors):
        spec = replace(base, G=g, lambda_gate=lg, lambda_coef=lc, lambda_error=le, variance="none")
        score = 0.0
        try:
            if criterion == "bic":
                tried = spec.fit(df)
                score = tried.edf["bic"]
                kept = (tried, score) if score < kept[1] else kept
            else:
                for f in range(1, folds + 1):
                    fit = spec.fit(df.where(F.col("fold") != f))
                    score += _loss(fit, df.where(F.col("fold") == f))
        except (RuntimeError, ArithmeticError, ValueError) as e:
            if criterion == "bic":
                raise e
            score = float("inf")
        rows.append((g, lg, lc, le, float(score)))
    table = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell int, G int, lambda_gate double, lambda_coef double, lambda_error double, score double")
    best = rows[best_cells(table, [], "score", "cell").first()["best"]]
    fit = kept[0]
    if fit is None or base.variance != "none":
        fit = replace(base, G=best[0], lambda_gate=best[1], lambda_coef=best[2], lambda_error=best[3]).fit(df)
    return Selection(fit, best, criterion, table.drop("cell"))


def fold_losses(df: DataFrame, fold: str, residual: Column, tau: float, weight: Column | None = None) -> DataFrame:
    """(fold, loss): weighted check loss of the residuals in every fold."""
    loss = check_loss(residual, tau)
    return df.groupBy(F.col(fold).alias("fold")).agg(F.sum(loss if weight is None else weight * loss).alias("loss"))


def best_cells(scores: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """(by, best): key of the row with the least score in each group, the least key of equal ones; the whole table without by."""
    return scores.groupBy(*by).agg(F.min(F.struct(score, key))[key].alias("best"))


def _loss(fit: Fitted, test: DataFrame) -> float:
    y = fit.formula.response_column()[0]
    if fit.spec.weights:
        test = normalize_weights(test, fit.spec.weights.replace("~", "").strip(), "_cv_w")
    else:
        test = test.withColumn("_cv_w", F.lit(1.0))
    row = fold_losses(fit.predict(test).withColumn("_all", F.lit(0)), "_all", y - F.col("quantile"), fit.spec.tau, F.col("_cv_w")).first()
    return (row["loss"] if row else None) or 0.0
