from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import solvers
from terraquant.operators.sums import Chunk, LocalRows, SparkRows
from terraquant.plans.formula import Formula
from terraquant.plans.model import Control, FieldSpec, SpatialQuantileMixture, align
from terraquant.plans.select import select_model
from terraquant.sources import simulate
from terraquant.streaming.scoring import score_stream

FAST = Control(nstart=3, k=8, maxit=40)


def rows_of(rng, n=300, p=3):
    x = np.c_[np.ones(n), rng.normal(size=(n, p - 1))]
    y = x @ np.arange(1, p + 1) + rng.standard_t(4, size=n)
    return Chunk(y, x, np.ones((n, 1)), rng.uniform(0.5, 2, n), np.full(n, -1), np.ones((n, 1)))


def plain(p, tau):
    return solvers.State(np.zeros((p, 1)), np.zeros((0, 1)), np.zeros((1, 0)), [], tau)


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_exact_quantile_regression_is_a_minimum(tau):
    rng = np.random.default_rng(2)
    c = rows_of(rng)
    b, _, _ = solvers.smooth_quantile(LocalRows(c), 0, plain(3, tau), np.zeros((3, 3)), 0.4)
    exact = solvers.exact_quantile(c.x, c.y, c.w, tau, b)
    loss = lambda v: (c.w * solvers.check(c.y - c.x @ v, tau)).sum()
    assert (np.abs(c.y - c.x @ exact) < 1e-8).sum() == 3
    assert all(loss(exact + rng.normal(size=3) * s) >= loss(exact) - 1e-9 for s in (1e-4, 1e-2, 1) for _ in range(300))
    near, _, _ = solvers.smooth_quantile(LocalRows(c), 0, plain(3, tau), np.zeros((3, 3)), 0.4, target=0.02)
    assert np.abs(near - exact).max() < 0.06


@pytest.mark.parametrize("tau", [0.3, 0.5])
def test_exact_quantile_regression_passes_copies_and_ties(tau):
    """Copies of rows and rounded responses meet many rows at a vertex; moves must not go in circles there."""
    rng = np.random.default_rng(8)
    x = np.c_[np.ones(600), rng.integers(0, 10, 600)]
    y, w = np.round(rng.normal(size=600), 2), rng.uniform(0.1, 0.9, 600)
    at = np.tile(np.arange(600), 5)
    loss = lambda v: (w[at] * solvers.check(y[at] - x[at] @ v, tau)).sum()
    pivots = 40
    got = solvers.exact_quantile(x[at], y[at], w[at], tau, np.array([0.5, -0.2]), pivots)
    again = solvers.exact_quantile(x[at], y[at], w[at], tau, got, pivots)
    assert np.abs(got - again).max() < 1e-9 or loss(got) == pytest.approx(loss(again), abs=1e-9)
    assert all(loss(got + rng.normal(size=2) * s) >= loss(got) - 1e-7 for s in (1e-4, 1e-3, 1e-2, 1e-1) for _ in range(300))


def test_exact_steps_start_from_the_step_before(monkeypatch):
    """Smoothed fits only lead the first exact ones; later steps take a few passes over the rows each."""
    rng = np.random.default_rng(9)
    n = 400
    x = np.c_[np.ones(n), rng.uniform(size=n)]
    y = np.where(rng.uniform(size=n) < 0.5, 3 * x[:, 1] + 4, -3 * x[:, 1]) + 0.3 * rng.normal(size=n)
    rows = LocalRows(Chunk(y, x, np.ones((n, 1)), np.ones(n), np.full(n, -1), np.full((n, 2), 0.5), rng.uniform(size=(n, 2))))
    smoothed, keep = [], solvers.smooth_quantile
    monkeypatch.setattr(solvers, "smooth_quantile", lambda *a, **b: smoothed.append(1) or keep(*a, **b))
    start = solvers.RandomStart(2, 1)
    got = solvers.mixture_em(rows, 2, 0.5, np.zeros((2, 2)), 1e-3 * np.eye(1), 0.4, False, None, 1.0, maxit=60, start=start)
    assert got["iterations"] > 2 and len(smoothed) == 2
    c, final = rows.chunk, got["state"]
    p = final.posterior(c)
    fresh = solvers.softmax_rows(c.z, final.gamma) * final.densities(c)
    assert np.abs(p - fresh / fresh.sum(1, keepdims=True)).max() < 1e-9


def test_a_heavy_penalty_shrinks():
    c = rows_of(np.random.default_rng(3))
    pen = np.diag([0.0, 1e6, 1e6])
    b, _, _ = solvers.smooth_quantile(LocalRows(c), 0, plain(3, 0.5), pen, 0.4)
    assert np.abs(b[1:]).max() < 1e-2


def test_gate_newton_reaches_a_zero_gradient():
    rng = np.random.default_rng(5)
    n = 200
    z = np.c_[np.ones(n), rng.normal(size=n)]
    p = rng.dirichlet([1, 1, 1], n)
    c = Chunk(np.zeros(n), np.ones((n, 1)), z, rng.uniform(0.5, 2, n), np.full(n, -1), p)
    pen = 0.1 * np.eye(2)
    gamma, hess = solvers.gate_fit(LocalRows(c), plain(1, 0.5), pen, 3)
    grad = z.T @ (c.w[:, None] * (p - solvers.softmax_rows(z, gamma))[:, 1:]) - pen @ gamma
    assert np.abs(grad).max() < 1e-6 and np.linalg.eigvalsh(hess).max() < 0


def test_executors_and_driver_take_the_same_steps(spark):
    rng = np.random.default_rng(6)
    c = rows_of(rng, 120)
    df = spark.createDataFrame([(float(c.y[i]), c.x[i].tolist(), [1.0], float(c.w[i]), -1, [1.0]) for i in range(120)], "y double, x array<double>, z array<double>, w double, unit long, p array<double>").repartition(3)
    args = (0, plain(3, 0.4), np.zeros((3, 3)), 0.4)
    a, _, h = solvers.smooth_quantile(LocalRows(c), *args, target=0.3, maxit=4)
    b, _, k = solvers.smooth_quantile(SparkRows(df), *args, target=0.3, maxit=4)
    assert np.abs(a - b).max() < 1e-5 and h == k


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 2.0, "b"), (3.0, 4.0, "a"), (5.0, 6.0, "c")], "y double, x double, g string")
    d = Formula.parse("log(y) ~ x + I(x^2) + g").design(df)
    assert d.names == ["(Intercept)", "x", "I(x^2)", "gb", "gc"]
    assert [list(r) for r in df.select(*d.columns).collect()] == [[1, 2, 4, 1, 0], [1, 4, 16, 0, 0], [1, 6, 36, 0, 1]]
    for bad in ("y ~ 0 + x", "y + x", "y ~ system(x)"):
        with pytest.raises(ValueError):
            f = Formula.parse(bad)
            f.design(df)


def test_mixture_recovers_classes_and_gate(spark):
    df = simulate.mixture(spark, 400, 2, seed=3).persist()
    fit = SpatialQuantileMixture("y ~ x", G=2, coords=("s1", "s2"), spatial_coef=False, control=FAST).fit(df)
    got = fit.transform(df).select("z", "s1", "posterior", "prior").toPandas()
    label = np.stack(got["posterior"]).argmax(1) + 1
    acc = (label == got["z"]).mean()
    assert max(acc, 1 - acc) > 0.75
    assert abs(np.corrcoef(np.stack(got["prior"])[:, 1], got["s1"])[0, 1]) > 0.7
    assert (np.diff(fit.coef[1]) > 0).all()  # regimes in the order of their slopes
    for kind in ("prob", "class", "posterior", "quantile", "quantile_byclass"):
        assert fit.predict(df, kind).count() == 400
    assert set(fit.gate_surface(df).columns) == {"regime", "prob", "coord1", "coord2"}
    assert fit.coef_surface(df).count() == 800
    sand = fit.sandwich()
    assert all(np.isfinite(v).all() for v in sand["coef"]) and np.isfinite(sand["gate"]).all()


def test_spatial_effect_is_recovered(spark):
    df, truth = simulate.car_lattice(spark, 600, 6, 1, seed=2)
    df = df.join(truth.select("unit", F.col("x").alias("sx"), F.col("y").alias("sy")), "unit").persist()
    base = SpatialQuantileMixture("y ~ x", G=1, coords=("sx", "sy"), spatial_coef=False, spatial_error=FieldSpec(k=4), variance="sandwich", control=FAST)
    fit = base.fit(df)
    place = {(int(r["x"]), int(r["y"])): r["phi_1"] for r in truth.collect()}
    u = fit.units.orderBy("unit").toPandas()
    phi = np.array([place[int(a), int(b)] for a, b in zip(u["x"], u["y"])])
    assert np.corrcoef(phi, fit.state.phi[:, 0])[0, 1] > 0.85
    assert abs(fit.coef[1, 0] - 0.8) < 0.12 and abs(fit.state.phi.sum()) < 1e-6
    surface = fit.phi_surface(spark).toPandas()
    wide = (surface["lower"] > 0) | (surface["upper"] < 0)
    assert (surface["credible"] == wide).all()
    near = fit.transform(df.withColumn("sx", F.col("sx") + 0.01)).agg(F.count("quantile")).first()[0]
    assert near == 600
    flat = replace(base, lambda_error=1e8, variance="none").fit(df)
    assert np.abs(flat.state.phi).max() < 1e-4
    moran = fit.moran(spark, nsim=99).toPandas().set_index("stage")
    assert moran.loc["before", "p_value"] < 0.05


def test_spatial_plus_reduces_confounding(spark):
    df = simulate.confounded(spark, 400, seed=2).persist()
    base = SpatialQuantileMixture("y ~ x", G=1, coords=("s1", "s2"), spatial_coef=False, control=FAST)
    plain_bias, plus = base.fit(df).coef[1, 0] - 1, replace(base, spatial_plus=True).fit(df)
    assert abs(plus.coef[1, 0] - 1) < abs(plain_bias)
    again = plus.transform(df).select("quantile").toPandas()["quantile"]
    assert np.isfinite(again).all()


def test_unit_weights_and_missing_rows_change_nothing(spark):
    df = simulate.mixture(spark, 150, 1, seed=4).withColumn("k", F.lit(2.0)).persist()
    base = SpatialQuantileMixture("y ~ x", G=1, spatial_coef=False, control=FAST)
    a = base.fit(df)
    b = replace(base, weights="k").fit(df)
    assert np.abs(a.coef - b.coef).max() < 1e-9
    extra = df.limit(1).withColumn("x", F.lit(None).cast("double"))
    assert np.abs(base.fit(df.unionByName(extra)).coef - a.coef).max() < 1e-6
    n = replace(base, weights="k", weights_type="frequency", variance="sandwich").fit(df)
    p = replace(base, weights="k", weights_type="precision", variance="sandwich").fit(df)
    assert np.allclose(n.vcov["coef"][0], p.vcov["coef"][0] / 2)


def test_guardrails(spark):
    df = simulate.mixture(spark, 60, 1, seed=1)
    with pytest.raises(ValueError, match="not separately identified"):
        SpatialQuantileMixture("y ~ x", coords=("s1", "s2"), spatial_error=FieldSpec(), spatial_gate=True).fit(df)
    for bad in ({"tau": 1.5}, {"method": "x"}, {"variance": "x"}):
        with pytest.raises(ValueError):
            SpatialQuantileMixture("y ~ x", **bad).fit(df)


def test_bootstrap_selection_and_kernel_density(spark):
    df = simulate.mixture(spark, 150, 2, seed=3).persist()
    base = SpatialQuantileMixture("y ~ x", G=1, coords=("s1", "s2"), spatial_coef=False, control=FAST)
    fit = base.fit(df)
    assert fit.bootstrap(8)["draws"] == 8 and len(fit.confint()) == 2
    sel = select_model(replace(base, spatial_gate=False), df, "row", G_grid=(1, 2))
    assert sel.best[0] == 2 and sel.table.count() == 2
    kde = replace(base, G=2, method="kde", spatial_gate=False).fit(df)
    assert np.isfinite(kde.coef).all() and np.isnan(kde.run["loglik"])


def test_fits_by_weights_formula_labels_and_knobs(spark):
    df = simulate.mixture(spark, 150, 2, seed=4).withColumn("k", F.lit(2.0)).persist()
    base = SpatialQuantileMixture("y ~ x", G=1, coords=("s1", "s2"), spatial_coef=False, control=FAST)
    assert np.abs(replace(base, weights="~ k").fit(df).coef - base.fit(df).coef).max() < 1e-9
    with pytest.raises(ValueError, match="name one column"):
        replace(base, weights="~ nothing").fit(df)
    with pytest.raises(ValueError, match="need a covariate"):
        SpatialQuantileMixture("y ~ 1", G=1, coords=("s1", "s2")).fit(df)
    two = replace(base, G=2, control=replace(FAST, label_order="intercept")).fit(df)
    assert two.coef[0, 0] <= two.coef[0, 1] and "regime 2" in repr(two)
    assert two.gate_table(spark).count() == 1 and two.diagnostics(spark).first()["gate_cond"] >= 1
    assert two.nobs == 150 and two.aic() == pytest.approx(-2 * two.loglik + 2 * two.edf["total"])
    assert two.class_map(df).count() == 150 and two.density_table(spark, 64).count() == 128
    d = two.density_table(spark, 256).toPandas().query("regime == 1")
    assert np.trapezoid(d["density"], d["residual"]) == pytest.approx(1, abs=0.02)
    got = two.residuals(df).toPandas()
    assert np.allclose(got["y"] - got["fitted"], got["residual"])
    kde = replace(two.spec, method="kde").fit(df).transform(df).select("posterior").toPandas()
    assert np.allclose(np.stack(kde["posterior"]).sum(1), 1)


def test_moran_without_an_effect_and_slope_stability(spark):
    from terraquant.operators import graph

    df = simulate.mixture(spark, 150, 2, coef_slope=2.0, seed=4).persist()
    fit = SpatialQuantileMixture("y ~ x", G=2, coords=("s1", "s2"), control=replace(FAST, nstart=1, maxit=8)).fit(df)
    units = graph.spatial_units(df, "s1", "s2", "row")
    with pytest.raises(ValueError, match="needs edges"):
        fit.moran(spark)
    got = fit.moran(spark, graph.knn_graph(units, 4), 19, df, units).first()
    assert got["stage"] == "single" and got["n_units"] == 150 and 0 < got["p_value"] <= 1
    assert 0 <= fit.stability(df).first()[0] <= 1


def test_labels_align():
    ref = np.array([[0.0, 5.0, 9.0], [1.0, 1.0, 1.0]])
    assert align(ref[:, [2, 0, 1]], ref).tolist() == [1, 2, 0]


def test_streams_are_scored(spark, tmp_path):
    df = simulate.mixture(spark, 80, 1, seed=4).persist()
    fit = SpatialQuantileMixture("y ~ x", G=1, spatial_coef=False, control=FAST).fit(df)
    df.select("row", "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row long, x double, y double").parquet(str(tmp_path / "in"))
    q = score_stream(fit, stream).select("row", "quantile").writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").count() == 80
    with pytest.raises(ValueError):
        score_stream(fit, df)


def test_streams_of_points_take_the_nearest_effect(spark, tmp_path):
    df, truth = simulate.car_lattice(spark, 150, 4, 1, seed=2)
    df = df.join(truth.select("unit", F.col("x").alias("sx"), F.col("y").alias("sy")), "unit").persist()
    fit = SpatialQuantileMixture("y ~ x", G=1, coords=("sx", "sy"), spatial_coef=False, spatial_error=FieldSpec(k=3), control=FAST).fit(df)
    moved = df.select("row", "x", "y", (F.col("sx") + 0.1).alias("sx"), "sy")
    moved.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(moved.schema).parquet(str(tmp_path / "in"))
    q = score_stream(fit, stream).select("row", "quantile").writeStream.format("memory").queryName("points").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {r["row"]: r["quantile"] for r in fit.transform(moved).collect()}
    got = {r["row"]: r["quantile"] for r in spark.table("points").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_selection_by_criterion_fits_the_best_cell_once(spark, monkeypatch):
    df = simulate.mixture(spark, 120, 2, seed=3).persist()
    fitted, keep = [], SpatialQuantileMixture.fit
    monkeypatch.setattr(SpatialQuantileMixture, "fit", lambda self, d: fitted.append(self.G) or keep(self, d))
    got = select_model(SpatialQuantileMixture("y ~ x", coords=("s1", "s2"), spatial_coef=False, control=Control(nstart=1, k=5, maxit=2)), df, "s1")
    assert fitted == [2, 3] and got.fit.spec.G == got.best[0] and got.fit.edf["bic"] == min(r["score"] for r in got.table.collect())
