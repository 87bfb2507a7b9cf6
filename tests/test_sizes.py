"""Tables beyond LOCAL_ROWS take the same steps on the executors: LOCAL_ROWS is set to 0."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import solvers
from terraquant.operators.sums import Chunk, LocalRows, SparkRows
from terraquant.plans import model
from terraquant.plans.model import Control, FieldSpec, SpatialQuantileMixture
from terraquant.sources import simulate


def both(spark, c: Chunk, parts: int = 3) -> tuple[LocalRows, SparkRows]:
    place = [] if c.place is None else [c.place.tolist()]
    rows = list(zip(c.y.tolist(), c.x.tolist(), c.z.tolist(), c.w.tolist(), c.unit.tolist(), c.p.tolist(), *place))
    schema = "y double, x array<double>, z array<double>, w double, unit long, p array<double>" + (", place array<double>" if place else "")
    return LocalRows(c), SparkRows(spark.createDataFrame(rows, schema).repartition(parts))


def some_rows(n=400, p=3, seed=2, ties=False):
    rng = np.random.default_rng(seed)
    x = np.c_[np.ones(n), rng.normal(size=(n, p - 1))]
    y = x @ np.arange(1, p + 1) + rng.standard_t(4, size=n)
    if ties:
        y = np.round(y, 1)
    return Chunk(y, x, np.ones((n, 1)), rng.uniform(0.5, 2, n), np.full(n, -1), np.ones((n, 1)), rng.uniform(size=(n, 2)))


@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_are_exact(spark, ties):
    here, there = both(spark, some_rows(101, ties=ties))
    probs = [0.0, 0.03, 0.25, 0.5, 0.77, 1.0]
    assert np.abs(here.quantiles(probs, lambda c: c.y) - there.quantiles(probs, lambda c: c.y)).max() < 1e-12
    assert there.gather(lambda c: c.y).shape == (101,)


@pytest.mark.parametrize(("tau", "band"), [(0.5, 60), (0.1, 40), (0.9, 1000)])
def test_exact_quantile_regression_over_a_band(spark, tau, band):
    c = some_rows()
    here, there = both(spark, c)
    state = solvers.State(np.zeros((3, 1)), np.zeros((0, 1)), np.zeros((1, 0)), [], tau)
    far = np.array([0.5, 2.5, 2.0])
    want = solvers.exact_over(here, 0, state, tau, far)
    loss = lambda b: (c.w * solvers.check(c.y - c.x @ b, tau)).sum()
    rng = np.random.default_rng(1)
    assert all(loss(want + rng.normal(size=3) * s) >= loss(want) - 1e-9 for s in (1e-3, 0.1) for _ in range(100))
    assert np.abs(solvers.exact_over(there, 0, state, tau, far, band) - want).max() < 1e-6


@pytest.mark.parametrize("kind", ["blocked", "resid", "random"])
def test_starts_agree(spark, kind):
    c = some_rows(200)
    c.y[:100] += 8
    here, there = both(spark, c)
    a, b = (solvers.start_of(rows, 2, 0.5, kind, 5, (3, 1), True) for rows in (here, there))
    p, q = a(c), b(c)
    assert np.abs(p - q).max() < 1e-6 and np.allclose(p.sum(1), 1) and 0.2 < p[:, 0].mean() < 0.8


def fits(spark, monkeypatch, spec, df):
    here = spec.fit(df)
    monkeypatch.setattr(model, "LOCAL_ROWS", 0)
    there = spec.fit(df)
    monkeypatch.undo()
    assert isinstance(here.rows, LocalRows) and isinstance(there.rows, SparkRows)
    return here, there


def test_exact_median_regression_and_inference(spark, monkeypatch):
    df = simulate.mixture(spark, 400, 1, seed=4).persist()
    here, there = fits(spark, monkeypatch, SpatialQuantileMixture("y ~ x", G=1, spatial_coef=False, variance="sandwich"), df)
    assert np.abs(here.coef - there.coef).max() < 1e-6
    assert np.abs(here.vcov["coef"][0] - there.vcov["coef"][0]).max() < 1e-6
    assert here.edf["loglik"] == pytest.approx(there.edf["loglik"], abs=1e-6)
    assert there.posterior().shape == (400, 1)
    assert there.bootstrap(2)["draws"] == 2 and np.isfinite(there.vcov["coef"][0]).all()
    got = there.residuals(df).agg(F.avg((F.col("residual") < 0).cast("int"))).first()[0]
    assert abs(got - 0.5) < 0.02


def test_mixture_takes_all_starts(spark, monkeypatch):
    df = simulate.mixture(spark, 240, 2, seed=3).persist()
    c = Control(nstart=3, k=6, maxit=1, sm_floor=0.3)
    here, there = fits(spark, monkeypatch, SpatialQuantileMixture("y ~ x", G=2, coords=("s1", "s2"), spatial_coef=False, control=c), df)
    assert here.run["objective"] == pytest.approx(there.run["objective"], abs=1e-5)
    assert np.abs(here.coef - there.coef).max() < 1e-6 and np.abs(here.state.gamma - there.state.gamma).max() < 1e-5


def test_deconfounding(spark, monkeypatch):
    df = simulate.confounded(spark, 300, seed=2).persist()
    spec = SpatialQuantileMixture("y ~ x", G=1, coords=("s1", "s2"), spatial_coef=False, spatial_plus=True)
    here, there = fits(spark, monkeypatch, spec, df)
    assert np.abs(here.coef - there.coef).max() < 1e-6
    assert here.deconfounding(spark).first()[1] == pytest.approx(there.deconfounding(spark).first()[1], abs=1e-9)


def test_spatial_effect(spark, monkeypatch):
    df, truth = simulate.car_lattice(spark, 200, 4, 1, seed=2)
    df = df.join(truth.select("unit", F.col("x").alias("sx"), F.col("y").alias("sy")), "unit").persist()
    spec = SpatialQuantileMixture("y ~ x", G=1, coords=("sx", "sy"), spatial_coef=False, spatial_error=FieldSpec(k=4), control=Control(sm_floor=0.1))
    here, there = fits(spark, monkeypatch, spec, df)
    assert np.abs(here.coef - there.coef).max() < 1e-5 and np.abs(here.state.phi - there.state.phi).max() < 1e-5
    a, b = (f.moran(spark, nsim=19).toPandas()["statistic"] for f in (here, there))
    assert np.abs(a - b).max() < 1e-5
    assert there.bootstrap(2)["draws"] == 2


def test_blocks_of_coordinates(spark, monkeypatch):
    df = simulate.mixture(spark, 120, 2, seed=3).persist()
    c = Control(nstart=1, k=5, maxit=1, sm_floor=0.3, boot_block=2)
    here, there = fits(spark, monkeypatch, replace(SpatialQuantileMixture("y ~ x", G=2, coords=("s1", "s2"), spatial_coef=False), control=c), df)
    a, b = here._blocks(), there._blocks()
    assert (a(here.rows.chunk) == b(here.rows.chunk)).all() and len(set(a(here.rows.chunk).tolist())) == 4


@pytest.mark.parametrize("kind", ["nngp", "proper"])
def test_a_field_over_many_units_is_solved_sparsely(spark, monkeypatch, kind):
    df, truth = simulate.car_lattice(spark, 120, 4, 1, seed=2)
    df = df.join(truth.select("unit", F.col("x").alias("sx"), F.col("y").alias("sy")), "unit").persist()
    spec = SpatialQuantileMixture("y ~ x", G=1, coords=("sx", "sy"), spatial_coef=False, spatial_error=FieldSpec(kind=kind, k=4, m=4), control=Control(sm_floor=0.1))
    dense = spec.fit(df)
    monkeypatch.setattr(model, "MAX_UNITS", 10)
    sparse = spec.fit(df)
    assert isinstance(sparse.field.q, solvers.Sparse) and sparse.field.size > 10
    assert np.abs(dense.coef - sparse.coef).max() < 1e-6 and np.abs(dense.state.phi - sparse.state.phi).max() < 1e-6
    assert sparse.edf["total"] == pytest.approx(dense.edf["total"], abs=1e-6)
    assert sparse.phi_surface(spark, ci=False).count() == sparse.field.size


def test_a_sparse_system_is_solved_without_iterations(monkeypatch):
    """Conjugate gradients took more rounds the more units there were; with a factor too large for the driver they remain."""
    rng = np.random.default_rng(6)
    n = 700
    xy = np.vstack([rng.normal(size=(n - 20, 2)), np.zeros((20, 2))])
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    w = np.zeros((n, n))
    w[np.repeat(np.arange(n), 6), np.argsort(d, axis=1)[:, :6].ravel()] = 1
    w[rng.integers(0, n, 60), rng.integers(0, n, 60)] = 1  # links across the plane
    w[0], w[:, 0] = 0, 0  # a unit on its own
    w = np.maximum(w, w.T)
    dense = np.diag(w.sum(1) + 0.01) - w
    i, j = np.nonzero(dense)
    diagonal, right = rng.uniform(size=n), rng.normal(size=(n, 3))
    products = []
    plain = solvers.Sparse.__matmul__
    monkeypatch.setattr(solvers.Sparse, "__matmul__", lambda self, x: products.append(1) or plain(self, x))
    cross, a, g = rng.normal(size=(n, 2)), np.eye(2) * n, rng.normal(size=n + 2)
    q = solvers.Sparse(i, j, dense[i, j], n, xy)
    got = solvers.Bordered(a, cross, diagonal, q, 2.0).solve(g)
    assert not products and len(q.fronts) > 10
    assert np.abs(got - np.linalg.solve(np.block([[a, cross.T], [cross, 2 * dense + np.diag(diagonal)]]), g)).max() < 1e-9
    assert np.abs(q.solve(2.0, diagonal, right) - np.linalg.solve(2 * dense + np.diag(diagonal), right)).max() < 1e-9
    monkeypatch.setattr(solvers, "FACTOR_VALUES", 1000)
    q = solvers.Sparse(i, j, dense[i, j], n, xy)
    assert q.fronts is None and np.abs(solvers.Bordered(a, cross, diagonal, q, 2.0).solve(g) - got).max() < 1e-8 and products
