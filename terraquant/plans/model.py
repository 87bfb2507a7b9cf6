"""Spatial mixtures of quantile regressions: estimator, fitted model, prediction, surfaces, inference.

fit() turns a formula into column expressions, drops incomplete rows, numbers the spatial units, evaluates the
basis, and runs the EM over sums of rows (operators/solvers.py). Tables up to sums.LOCAL_ROWS rows are fitted
on the driver, larger ones on the executors from a stored table of designs, by the same code: starts, steps, exact
quantile regressions, deconfounding, bootstrap and inference are all sums over rows. transform() and predict() are lazy column plans
and also accept streaming DataFrames where no basis or field has to be looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquant.functions import scalar
from terraquant.operators import graph, nngp, solvers
from terraquant.operators.basis import Basis, point_basis, region_basis, smooth_by_sums
from terraquant.operators.rows import complete_cases, label_stability, normalize_weights
from terraquant.operators.sums import LOCAL_ROWS, Chunk, Few, LocalRows, SparkRows, cdf, mixed, pdf, uniforms
from terraquant.plans.formula import Formula, expression
from terraquant.session import reachable, stored

#: Units of a spatial field up to which its system is dense; beyond, it is sparse and solved by conjugate gradients.
MAX_UNITS = 4_000
#: Starts of a mixture that run at the same time.
AT_ONCE = 5


@dataclass(frozen=True)
class Control:
    """Tuning scalars."""

    nstart: int = 5
    maxit: int = 200
    tol: float = 1e-5
    basis: str = "tp"
    k: int = 20
    gate_ridge: float = 1e-3
    gate_maxit: int = 50
    gate_tol: float = 1e-8
    sm_scale: float = 1.0
    sm_floor: float = 1e-3
    coef_maxit: int = 50
    coef_tol: float = 1e-7
    kde_grid: int = 512
    boot_B: int = 200
    boot_block: int = 4
    boot_areal_blocks: int = 8
    min_sites: int = 12
    lambda_error: float = 1.0
    seed: int = 1
    label_order: str = "slope"
    scale_coords: bool = True
    bandwidth: float | None = None
    car_alpha_grid: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)


@dataclass
class Layout:
    """Column layout of the component and gate designs with their penalties."""

    p: int
    r: int
    spatial_gate: bool
    spatial_coef: bool
    const_rows: list[int]
    blocks: list[range]
    pen_beta: np.ndarray
    pen_gamma: np.ndarray

    @classmethod
    def build(cls, p: int, qw: int, basis: Basis | None, spatial_gate: bool, spatial_coef: bool, lam_gate: float, lam_coef: float, ridge: float) -> Layout:
        r = basis.r if basis else 0
        const, blocks, pos = [0], [], 1
        for _ in range(1, p):
            const.append(pos)
            pos += 1
            if spatial_coef and basis:
                blocks.append(range(pos, pos + r))
                pos += r
        pen = np.zeros((pos, pos))
        for b in blocks:
            pen[b.start : b.stop, b.start : b.stop] = lam_coef * basis.omega
        q = qw + (r if spatial_gate and basis else 0)
        gate = ridge * np.eye(q)
        if spatial_gate and basis:
            gate[qw:, qw:] += lam_gate * basis.omega
        return cls(p, r, spatial_gate and basis is not None, spatial_coef and basis is not None, const, blocks, pen, gate)

    def component(self, x: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        if not self.blocks:
            return x
        parts = [x[:, :1]]
        for j in range(1, self.p):
            parts += [x[:, j : j + 1], x[:, j : j + 1] * b]
        return np.hstack(parts)

    def gate(self, z: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        return np.hstack([z, b]) if self.spatial_gate else z


@dataclass
class FieldSpec:
    """Where a spatial effect comes from: edges over units (unit ids), or a nearest-neighbour process on coordinates."""

    edges: DataFrame | None = None
    kind: str = "proper"
    alpha: float = 0.95
    k: int = 5
    m: int = nngp.NEIGHBOURS
    reach: float | None = None
    nu: float = 0.5


def field_of(units: DataFrame, spec: FieldSpec) -> solvers.Field:
    """Precision and components over units 1..L, dense up to MAX_UNITS."""
    n = units.count()
    near = None
    if spec.kind == "nngp":
        placed = stored(nngp.ordered_units(units), "ordered")
        links = stored(nngp.earlier_neighbours(placed, spec.m), "neighbours")
        q_edges, comp = nngp.assemble_precision(stored(nngp.conditional_weights(placed, links, spec.reach or nngp.default_range(units), spec.nu), "weights")), None
        if n <= MAX_UNITS:
            e = links.select("i", "j").toPandas()
            near = np.zeros((n, n))
            near[e["i"].to_numpy() - 1, e["j"].to_numpy() - 1] = 1
            near = np.maximum(near, near.T)
    else:
        edges = spec.edges if spec.edges is not None else graph.knn_graph(units, min(spec.k, n - 1))
        q_edges = graph.car_precision(edges, units, spec.alpha, "icar" if spec.kind == "icar" else "proper")
        comp = graph.unit_components(edges, units).orderBy("unit").toPandas()["component"].to_numpy()
    e = q_edges.toArrow()
    if n > MAX_UNITS:
        place = units.select("unit", F.col("x").cast("double"), F.col("y").cast("double")).orderBy("unit").drop("unit").toPandas().to_numpy()
        i, j, v, own = e["i"].to_numpy() - 1, e["j"].to_numpy() - 1, e["v"].to_numpy() / 2, np.arange(n)
        q = solvers.Sparse(np.concatenate([i, j, own]), np.concatenate([j, i, own]), np.concatenate([v, v, np.full(n, 1e-6)]), n, place)
        return solvers.Field(q, np.zeros(n, int) if comp is None else comp, spec.kind != "nngp")
    q = np.zeros((n, n))
    np.add.at(q, (e["i"].to_numpy() - 1, e["j"].to_numpy() - 1), e["v"].to_numpy())
    return solvers.Field((q + q.T) / 2 + 1e-6 * np.eye(n), np.zeros(n, int) if comp is None else comp, spec.kind != "nngp", near)


@dataclass
class SpatialQuantileMixture:
    """Estimator. coords names two coordinate columns, region one region column; row numbers rows for unit order."""

    formula: str
    G: int = 2
    tau: float = 0.5
    gating: str = "~ 1"
    coords: tuple[str, str] | None = None
    region: str | None = None
    spatial_gate: bool | None = None
    spatial_coef: bool = True
    spatial_error: FieldSpec | None = None
    spatial_plus: bool = False
    spatial_plus_k: int | None = None
    method: str = "ald"
    lambda_gate: float = 1.0
    lambda_coef: float = 1.0
    lambda_error: float | None = None
    variance: str = "none"
    weights: str | None = None
    weights_type: str = "sampling"
    basis: Basis | None = None
    region_edges: list[tuple[str, str]] | None = None
    order_var: int = 1
    control: Control = field(default_factory=Control)

    def _checked(self) -> bool:
        if not 0 < self.tau < 1:
            raise ValueError("tau must be between 0 and 1")
        if self.method not in ("ald", "kde"):
            raise ValueError("method must be ald or kde")
        if self.variance not in ("none", "sandwich", "boot"):
            raise ValueError("variance must be none, sandwich or boot")
        if self.control.label_order not in ("slope", "intercept"):
            raise ValueError("label_order must be slope or intercept")
        if self.spatial_error is not None and self.spatial_gate:
            raise ValueError("a spatial gate and a spatial error are not separately identified")
        if self.spatial_error is not None and self.spatial_error.kind == "nngp" and self.region:
            raise ValueError("a nearest-neighbour process needs coordinates")
        return (self.spatial_error is None) if self.spatial_gate is None else self.spatial_gate

    def fit(self, df: DataFrame) -> Fitted:
        gate_on = self._checked()
        reachable(df.sparkSession)
        c = self.control
        formula, gating = Formula.parse(self.formula), Formula.parse(self.gating if self.gating.strip().startswith("~") else "~" + self.gating)
        y, y_used = formula.response_column()
        weight = self.weights.replace("~", "").strip() if self.weights else None
        if weight is not None and weight not in df.columns:
            raise ValueError("weights must name one column of the table")
        coef_on = self.spatial_coef and bool(formula.terms) and (self.coords is not None or self.region is not None)
        gate_on = gate_on and self.G > 1 and (self.coords is not None or self.region is not None)
        used = sorted(formula.used() | gating.used() | y_used | set(self.coords or ()) | ({self.region} if self.region else set()) | ({weight} if weight else set()))
        if self.spatial_coef and not formula.terms:
            raise ValueError("spatial slopes need a covariate; set spatial_coef=False")
        df = complete_cases(df, used)
        xd, zd = formula.design(df), gating.design(df)
        if weight:
            df = normalize_weights(df, weight, "_w")
            sum_raw = df.agg(F.sum(weight)).first()[0]
        else:
            df, sum_raw = df.withColumn("_w", F.lit(1.0)), None
        place = [F.col(self.coords[0]).cast("double").alias("c1"), F.col(self.coords[1]).cast("double").alias("c2")] if self.coords else [F.col(self.region).cast("string").alias("region")] if self.region else []
        rows = df.select(y.cast("double").alias("y"), F.array(*xd.columns).alias("x"), F.array(*zd.columns).alias("z"), F.col("_w").alias("w"), *place)
        n = rows.count()
        units = fld = None
        if self.spatial_error is not None:
            if self.region:
                names = rows.select("region").distinct() if self.spatial_error.edges is None else self.spatial_error.edges.select(F.col("i").cast("string").alias("region")).union(self.spatial_error.edges.select(F.col("j").cast("string").alias("region"))).distinct()
                ids = [r[0] for r in names.orderBy("region").limit(MAX_UNITS + 1).collect()]
                if len(ids) > MAX_UNITS:
                    raise ValueError(f"a spatial effect takes at most {MAX_UNITS} regions")
                at = {v: k + 1 for k, v in enumerate(ids)}
                spark = df.sparkSession
                units = spark.createDataFrame([(k, v) for v, k in at.items()], "unit long, region string")
                missing = rows.join(units, "region", "left_anti").limit(1).count()
                if missing:
                    raise ValueError("a region is not among the units of the graph")
                e = self.spatial_error.edges.select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), "w")
                e = e.join(units.select(F.col("unit").alias("i"), F.col("region").alias("a")), "a").join(units.select(F.col("unit").alias("j"), F.col("region").alias("b")), "b").select("i", "j", "w")
                fld = field_of(units, replace(self.spatial_error, edges=e))
                rows = rows.join(F.broadcast(units), "region")  # at most MAX_UNITS rows
            else:
                units = graph.spatial_units(rows.withColumn("_row", F.monotonically_increasing_id()), "c1", "c2", "_row")
                units = stored(units, "units")
                fld = field_of(units, self.spatial_error)
                rows = graph.with_unit(rows, F.broadcast(units) if fld.size <= MAX_UNITS else units, "c1", "c2")
            rows = rows.withColumn("unit", F.col("unit") - 1)
        else:
            rows = rows.withColumn("unit", F.lit(-1).cast("long"))
        basis = self.basis
        if basis is None and (gate_on or coef_on):
            if self.coords:
                basis = point_basis(_some_places(rows), "gp" if c.basis == "gp" else "tp", c.k, scale=c.scale_coords)
            else:
                basis = region_basis(_regions(rows), self.region_edges or [], c.k)
        layout = Layout.build(len(xd.columns), len(zd.columns), basis, gate_on, coef_on, self.lambda_gate, self.lambda_coef, c.gate_ridge)
        raw = rows.toPandas() if n <= LOCAL_ROWS else rows
        plus = self._deconfound(raw, rows, xd.names) if self.spatial_plus else {}
        everything = self._rows(raw, lambda x, z, w: (layout.component(x, w), layout.gate(z, w)), basis, plus)
        best = self._starts(everything, layout, fld)
        state = best["state"]
        ordered_by = 0 if c.label_order == "intercept" else min(self.order_var, layout.p - 1)
        slope = state.beta[layout.const_rows[ordered_by]]
        order = np.argsort(slope, kind="stable")
        state = replace(state, beta=state.beta[:, order], phi=state.phi[:, order] if len(state.phi) else state.phi, density=[state.density[k] for k in order], start=None)
        post_order = order

        def relabelled(ch: Chunk) -> np.ndarray:
            return best["state"].posterior(ch)[:, post_order]

        class _Old:
            tau = self.tau
            posterior = staticmethod(relabelled)

        gamma, hess = solvers.gate_fit(everything, _Old, layout.pen_gamma, self.G, c.gate_maxit, c.gate_tol)
        state = replace(state, gamma=gamma)
        out = Fitted(self, formula, gating, xd.levels | zd.levels, xd.names, zd.names, layout, basis, fld, units, state, best, hess, everything, n, sum_raw, plus)
        if fld is not None and isinstance(fld.q, solvers.Sparse):
            if self.variance != "none":
                raise ValueError(f"variances with a spatial effect take at most {MAX_UNITS} units")
            out.edf = Later(out)
        else:
            out.information()
        if self.variance == "sandwich":
            out.sandwich()
        elif self.variance == "boot":
            out.bootstrap()
        return out

    def _rows(self, raw, designs, basis: Basis | None, plus: dict | None = None):
        """Rows with their designs: designs maps raw designs and basis columns to those of components and gate. A pandas frame stays on the driver; a DataFrame is designed on the executors and stored."""
        coords, region, g = self.coords, self.region, self.G

        def design(part: pd.DataFrame) -> dict[str, np.ndarray]:
            x, z = np.stack(part["x"].to_numpy()).astype(float), np.stack(part["z"].to_numpy()).astype(float)
            place = part[["c1", "c2"]].to_numpy(float) if coords else None
            where = place if coords else part["region"].to_numpy() if region else None
            if plus:
                a = plus["basis"](where)
                a = np.hstack([np.ones((len(a), 1)), a])
                for j, (coef, _) in plus["fits"].items():
                    x[:, j] -= a @ coef
            x, z = designs(x, z, basis(where) if basis is not None else None)
            out = {"y": part["y"].to_numpy(float), "x": x, "z": z, "w": part["w"].to_numpy(float), "unit": part["unit"].to_numpy(), "p": np.full((len(x), g), 1 / g)}
            return out if place is None else out | {"place": place}

        if isinstance(raw, pd.DataFrame):
            return LocalRows(Chunk(**design(raw), key=mixed(np.arange(len(raw), dtype=np.uint64))))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            at = TaskContext.get().partitionId() << 40
            for part in parts:
                if len(part):
                    made = {k: list(v) if v.ndim > 1 else v for k, v in design(part).items()}
                    yield pd.DataFrame(made | {"key": mixed(np.arange(at, at + len(part), dtype=np.uint64)).view(np.int64)})
                    at += len(part)

        place = ", place array<double>" if coords else ""
        made = raw.mapInPandas(run, f"y double, x array<double>, z array<double>, w double, unit long, p array<double>{place}, key long")
        return SparkRows(stored(made, "designed"))

    def _deconfound(self, raw, rows: DataFrame, names: list[str]) -> dict:
        """Smooths of every covariate over space, by restricted likelihood from cross products; constant ones have none."""
        if self.coords:
            n_sites = rows.select("c1", "c2").distinct().count()
            basis = point_basis(_some_places(rows), "tp", self.spatial_plus_k or min(100, max(30, n_sites // 4)), scale=self.control.scale_coords)
        else:
            basis = region_basis(_regions(rows), self.region_edges or [], self.spatial_plus_k or 100)
        both = self._rows(raw, lambda x, z, b: (x, b), basis)

        def sums(c: Chunk):
            a = np.hstack([np.ones((len(c), 1)), c.z])
            wa = c.w[:, None] * a
            return float(len(c)), wa.T @ a, wa.T @ c.x, (c.w[:, None] * c.x**2).sum(0)

        n, aa, ax, xx = both.reduce(sums)
        coefs = {j: smooth_by_sums(n, aa, ax[:, j], float(xx[j]), basis.omega) for j in range(1, len(xx))}
        coefs = {j: v for j, v in coefs.items() if v is not None}

        def spread(c: Chunk):
            a = np.hstack([np.ones((len(c), 1)), c.z])
            v = np.stack([f for j, b in coefs.items() for f in (c.x[:, j], c.x[:, j] - a @ b)], 1) if coefs else np.zeros((len(c), 0))
            return v.sum(0), (v * v).sum(0)

        one, two = both.reduce(spread)
        var = two - one**2 / n
        return {"basis": basis, "fits": {j: (b, 1 - float(var[2 * i + 1] / var[2 * i])) for i, (j, b) in enumerate(coefs.items())}, "names": names}

    def _run(self, rows, layout: Layout, fld: solvers.Field | None, start) -> dict:
        c = self.control
        n = rows.reduce(lambda ch: (np.array(float(len(ch))),))[0]
        rate = scalar.smooth_bandwidth(float(n), c.sm_scale)
        lam = c.lambda_error if self.lambda_error is None else self.lambda_error
        return solvers.mixture_em(rows, self.G, self.tau, layout.pen_beta, layout.pen_gamma, rate, layout.spatial_coef, fld, lam, self.method, c.maxit, c.tol, c, start)

    def _starts(self, rows, layout: Layout, fld) -> dict:
        """The best of nstart runs, some at a time; the first of equal ones."""
        kinds, best = ("blocked", "resid", "random"), None
        sizes = len(layout.pen_beta), len(layout.pen_gamma)

        def run(i: int) -> dict | None:
            try:
                start = solvers.start_of(rows, self.G, self.tau, kinds[i % 3], self.control.seed + i, sizes, self.coords is not None)
                return self._run(rows, layout, fld, start)
            except (np.linalg.LinAlgError, FloatingPointError):
                return None

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for got in pool.map(run, range(self.control.nstart if self.G > 1 else 1)):
                if got is not None and (best is None or got["objective"] > best["objective"]):
                    best = got
        if best is None:
            raise RuntimeError("every start failed")
        return best


def _some_places(rows: DataFrame) -> np.ndarray:
    """Distinct locations, at most 4,000 by hash: what a basis is built on."""
    return rows.select("c1", "c2").distinct().orderBy(F.xxhash64("c1", "c2")).limit(4000).toPandas().to_numpy()


def _regions(rows: DataFrame) -> list[str]:
    names = [r[0] for r in rows.select("region").distinct().orderBy("region").limit(MAX_UNITS + 1).collect()]
    if len(names) > MAX_UNITS:
        raise ValueError(f"a basis over regions takes at most {MAX_UNITS} of them")
    return names


class Later(dict):
    """Criteria that are computed when one is asked for: over many units they take as many solutions as there are units."""

    def __init__(self, fit: Fitted):
        self.fit = fit

    def __missing__(self, key: str):
        self.fit.information()
        return self.fit.edf[key]


@dataclass
class Fitted:
    spec: SpatialQuantileMixture
    formula: Formula
    gating: Formula
    levels: dict
    x_names: list[str]
    z_names: list[str]
    layout: Layout
    basis: Basis | None
    field: solvers.Field | None
    units: DataFrame | None
    state: solvers.State
    run: dict
    gate_hessian: np.ndarray
    rows: object
    n: int
    sum_raw: float | None
    plus: dict
    vcov: dict | None = None
    edf: dict = field(default_factory=dict)

    # -- accessors
    @property
    def coef(self) -> np.ndarray:
        """Constant coefficients, one row per term and one column per regime."""
        return self.state.beta[self.layout.const_rows]

    def coef_frame(self, spark) -> DataFrame:
        rows = [(k + 1, name, float(self.coef[i, k])) for k in range(self.spec.G) for i, name in enumerate(self.x_names)]
        return spark.createDataFrame(rows, "regime int, term string, estimate double")

    def posterior(self) -> np.ndarray:
        """Responsibilities of the fitted rows, gathered on the driver; transform() has them as a column."""
        return self.rows.gather(self.state.posterior)

    # -- criteria
    @property
    def loglik(self) -> float:
        return self.edf["loglik"]

    @property
    def nobs(self) -> int:
        return self.n

    def aic(self, k: float = 2.0) -> float:
        """nan where the method has no likelihood."""
        return -2 * self.edf["loglik"] + k * self.edf["total"]

    @property
    def bic(self) -> float:
        return self.edf["bic"]

    def information(self) -> None:
        """Effective degrees of freedom, log-likelihood criteria, occupancy and entropy."""
        st, lay, g = self.state, self.layout, self.spec.G
        comp = 0.0
        m = self.field.size if self.field else 0
        lam = self.spec.control.lambda_error if self.spec.lambda_error is None else self.spec.lambda_error
        for k in range(g):
            s = self.rows.reduce(solvers._least_squares, k, st, m)
            if m and isinstance(self.field.q, solvers.Sparse):
                h, a = solvers._system(s, lay.pen_beta, self.field, lam, 1e-8), solvers.Bordered(s[0], s[3], s[2], self.field.q, 0.0)
                for at in np.array_split(np.arange(len(h)), -(-len(h) // 16)):
                    comp += float(solvers._constrained(h, a.columns(at), self.field, len(lay.pen_beta))[at, np.arange(len(at))].sum())
                continue
            zero = np.zeros_like(lay.pen_beta)
            a = solvers._system(s, zero, replace(self.field, q=np.zeros_like(self.field.q)) if m else None, 0.0, 0.0)
            h = solvers._system(s, lay.pen_beta, self.field, lam, 1e-8)
            if m and self.field.constrained:
                free = self._free(len(lay.pen_beta))
                a, h = free.T @ a @ free, free.T @ h @ free
            comp += float(np.trace(solvers.robust_solve(h, a)))
        gate = 0.0
        if g > 1:
            ag = -self.gate_hessian
            gate = float(np.trace(solvers.robust_solve(ag, ag - np.kron(np.eye(g - 1), lay.pen_gamma))))
        n_const = g * len(lay.const_rows) if lay.blocks or m else 0
        occupancy, entropy = self.rows.reduce(lambda c: (lambda p: (p.sum(0), np.array(-(p * np.log(np.maximum(p, 1e-300))).sum())))(st.posterior(c)))
        ll, n_eff = self.run["loglik"], float(self.n)
        total = comp + gate + g
        if self.spec.weights_type == "frequency" and self.sum_raw:
            ll, n_eff = ll * self.sum_raw / self.n, self.sum_raw
        self.edf = {
            "total": total, "component": comp, "gate": gate, "spatial": max(0.0, comp - n_const), "loglik": ll, "nobs": n_eff, "aic": -2 * ll + 2 * total, "bic": -2 * ll + math.log(n_eff) * total,
            "occupancy": occupancy.tolist(), "class_entropy": float(entropy) / self.n / math.log(g) if g > 1 else 0.0,
        }

    def _free(self, p: int) -> np.ndarray:
        """Orthonormal basis of (b, phi) under the sum-to-zero constraints."""
        a = self.field.constraints()
        q, _ = np.linalg.qr(a.T, mode="complete")
        t = q[:, len(a) :]
        out = np.zeros((p + len(t), p + t.shape[1]))
        out[:p, :p] = np.eye(p)
        out[p:, p:] = t
        return out

    # -- prediction
    def transform(self, df: DataFrame) -> DataFrame:
        """df with prior, quantiles (arrays over regimes), regime and quantile; posterior too where the response is there.

        New points take the spatial effect of the unit at their place, else of the nearest; unknown regions raise.
        Rows with missing inputs get nulls.
        """
        lay, st, g = self.layout, self.state, self.spec.G
        xs, zs = self.formula.design(df, self.levels).columns, self.gating.design(df, self.levels).columns
        out = df
        bcols: list[Column] = []
        if self.plus:
            out = self._residualized(out, xs)
            xs = [xs[0], *(F.get("_plus", F.lit(j)) for j in range(len(xs) - 1))]
        if self.basis is not None:
            out = out.withColumn("_b", self._basis_column())
            bcols = [F.get("_b", F.lit(i)) for i in range(lay.r)]
        comp = list(xs)
        if lay.blocks:
            comp = [xs[0]]
            for x in xs[1:]:
                comp += [x, *(x * b for b in bcols)]
        gate = [*zs, *bcols] if lay.spatial_gate else zs
        if self.field is not None:
            out = self._with_phi(out)
        q = [scalar.dot(comp, st.beta[:, k]) + (F.get("_phi", F.lit(k)) if self.field is not None else F.lit(0.0)) for k in range(g)]
        pi = scalar.softmax([scalar.dot(gate, st.gamma[:, a]) for a in range(g - 1)])
        out = out.withColumn("prior", F.array(*pi)).withColumn("quantiles", F.array(*q))
        p_at, q_at = [F.get("prior", F.lit(k)) for k in range(g)], [F.get("quantiles", F.lit(k)) for k in range(g)]
        out = out.withColumn("quantile", scalar.mixture_mean(p_at, q_at)).withColumn("regime", scalar.first_max(p_at))
        if self.formula.response and expression_columns(self.formula.response) <= set(df.columns):
            y = self.formula.response_column()[0]
            density = lambda e, d: scalar.ald_density(e, d.sigma, self.spec.tau) if self.spec.method == "ald" else scalar.floored(scalar.interpolated(e, d.grid, d.value))
            joint = [scalar.floored(p * density(y - b, d)) for p, b, d in zip(p_at, q_at, st.density)]
            out = out.withColumn("posterior", F.array(*scalar.normalized(joint)))
        return out.drop("_b", "_phi", "_plus")

    def predict(self, df: DataFrame, kind: str = "quantile") -> DataFrame:
        """df with one column named kind: prob, class, posterior, quantile or quantile_byclass."""
        source = {"prob": "prior", "class": "regime", "posterior": "posterior", "quantile": "quantile", "quantile_byclass": "quantiles"}
        if kind not in source:
            raise ValueError("unknown kind of prediction")
        out = self.transform(df)
        if source[kind] not in out.columns:
            raise ValueError("posterior needs the response")
        return out.select(*df.columns, F.col(source[kind]).alias(kind))

    def _basis_column(self) -> Column:
        basis, coords = self.basis, self.spec.coords

        @F.pandas_udf("array<double>")
        def evaluate(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                where = np.stack([s.to_numpy(float) for s in part], 1) if coords else part[0].to_numpy()
                yield pd.Series(list(basis(where)))

        return evaluate(*(F.col(c).cast("double") for c in coords)) if coords else evaluate(F.col(self.spec.region).cast("string"), F.lit(0))

    def _residualized(self, df: DataFrame, xs: list[Column]) -> DataFrame:
        basis, fits, coords = self.plus["basis"], self.plus["fits"], self.spec.coords

        @F.pandas_udf("array<double>")
        def less_smooth(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.stack(part[0].to_numpy()).astype(float)
                b = basis(np.stack([s.to_numpy(float) for s in part[1:]], 1) if coords else part[1].to_numpy())
                a = np.hstack([np.ones((len(b), 1)), b])
                for j, (coef, _) in fits.items():
                    x[:, j - 1] -= a @ coef
                yield pd.Series(list(x))

        where = [F.col(c).cast("double") for c in coords] if coords else [F.col(self.spec.region).cast("string")]
        return df.withColumn("_plus", less_smooth(F.array(*xs[1:]), *where))

    def _with_phi(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        table = spark.createDataFrame([(i + 1, [float(v) for v in row]) for i, row in enumerate(self.state.phi)], "unit long, _phi array<double>")
        if self.spec.region:
            keyed = self.units.join(table, "unit").select(F.col("region").alias("_region"), "_phi")
            out = df.join(F.broadcast(keyed), F.col(self.spec.region).cast("string") == F.col("_region"), "left")  # at most MAX_UNITS rows
            bad = F.col("_phi").isNull() & F.col(self.spec.region).isNotNull()
            return out.withColumn("_phi", F.when(bad, F.raise_error(F.lit("a region was not seen in fitting")).cast("array<double>")).otherwise(F.col("_phi"))).drop("_region")
        a, b = self.spec.coords
        if df.isStreaming:
            return df.withColumn("_phi", self._phi_at()(F.col(a).cast("double"), F.col(b).cast("double")))
        places = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).distinct()
        near = graph.exact_else_nearest(places.withColumn("key", F.lit(0)), self.units, "key").join(F.broadcast(table), "unit", "left").select(F.col("x").alias("_x"), F.col("y").alias("_y"), "_phi")
        return df.join(near, (F.col(a).cast("double") == F.col("_x")) & (F.col(b).cast("double") == F.col("_y")), "left").drop("_x", "_y")

    def _phi_at(self):
        """Effects of the nearest unit, ties to the lower number, for streams: units are few enough (MAX_UNITS) to go along."""
        units = self.units.orderBy("unit").select("x", "y").toPandas().to_numpy(float)
        phi = self.state.phi

        @F.pandas_udf("array<double>")
        def nearest(x: pd.Series, y: pd.Series) -> pd.Series:
            at = np.stack([x.to_numpy(float), y.to_numpy(float)], 1)
            out: list = [None] * len(at)
            for i in np.flatnonzero(np.isfinite(at).all(1)).tolist():
                out[i] = phi[int(((units - at[i]) ** 2).sum(1).argmin())].tolist()
            return pd.Series(out)

        return nearest

    # -- surfaces
    def coef_surface(self, df: DataFrame, covariate: int = 1) -> DataFrame:
        """One row per place and regime: (regime, slope, coord1, coord2 | region)."""
        lay, st = self.layout, self.state
        i = lay.const_rows[covariate]
        out = df.withColumn("_b", self._basis_column()) if lay.blocks else df
        slopes = []
        for k in range(self.spec.G):
            s = F.lit(float(st.beta[i, k]))
            if lay.blocks:
                s = s + scalar.dot([F.get("_b", F.lit(j)) for j in range(lay.r)], st.beta[lay.blocks[covariate - 1], k])
            slopes.append(s)
        return self._long(out, slopes, "slope")

    def gate_surface(self, df: DataFrame) -> DataFrame:
        out = self.transform(df)
        return self._long(out, [F.get("prior", F.lit(k)) for k in range(self.spec.G)], "prob")

    def _long(self, df: DataFrame, values: list[Column], name: str) -> DataFrame:
        return long_surface(df, values, name, self.spec.coords, self.spec.region)

    def phi_surface(self, spark, units: list | None = None, ci: bool = True, level: float = 0.95, exp_scale: bool = False, masked: bool = False) -> DataFrame:
        """One row per unit and regime: phi, and with a sandwich also se, lower, upper, credible (and multipliers).

        units asks for some, in their order. masked hides the phi whose interval holds 0.
        """
        if self.field is None:
            raise ValueError("the model has no spatial effect")
        se = self.phi_se() if ci and self.vcov and "h_inverse" in self.vcov else None
        rows = [(u + 1, k + 1, float(self.state.phi[u, k]), None if se is None else float(se[u, k])) for k in range(self.spec.G) for u in range(self.field.size)]
        out = spark.createDataFrame(rows, "unit long, regime int, phi double, se double")
        if self.spec.region:
            out = out.join(F.broadcast(self.units), "unit").select(F.col("region").alias("unit"), "regime", "phi", "se")
        if units is not None:
            known = {r[0] for r in out.select("unit").distinct().collect()}
            if set(units) - known:
                raise ValueError("an unknown unit was asked for")
            asked = spark.createDataFrame([(u, k) for k, u in enumerate(units)], f"_asked {'string' if self.spec.region else 'long'}, _place int")
            out = out.join(F.broadcast(asked), F.col("unit") == F.col("_asked")).orderBy("regime", "_place").drop("_asked", "_place")
        if not ci:
            return out.drop("se")
        if se is None:
            return out.withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
        lower, upper, credible = scalar.interval(F.col("phi"), F.col("se"), NormalDist().inv_cdf(0.5 + level / 2))
        out = out.withColumns({"lower": lower, "upper": upper, "credible": credible})
        if exp_scale:
            out = out.withColumns({"mult": F.exp("phi"), "mult_lower": F.exp("lower"), "mult_upper": F.exp("upper")})
        if masked:
            out = out.withColumn("phi", F.when(F.col("credible"), F.col("phi")))
        return out

    def phi_se(self) -> np.ndarray:
        p = len(self.layout.pen_beta)
        return np.sqrt(np.maximum(np.stack([np.diag(v)[p:] for v in self.vcov["full"]], 1), 0))

    # -- inference
    def sandwich(self) -> dict:
        """Covariances by regime (coefficients, and effects where there are any) and of the gate."""
        st, lay, s = self.state, self.layout, self.spec
        p, m, h = len(lay.pen_beta), self.field.size if self.field else 0, self.run["h"]
        lam = s.control.lambda_error if s.lambda_error is None else s.lambda_error
        sampling, tau = s.weights_type == "sampling", s.tau
        full = []
        for k in range(s.G):
            zero = np.zeros(m)
            phi = st.phi[:, k] if m else zero

            def sums(c: Chunk, k=k, phi=phi):
                r = st.posterior(c)[:, k]
                e = c.y - c.x @ st.beta[:, k] - (phi[c.unit] if m else 0)
                kw = c.w * r * pdf(e / h) / h
                psi = tau - 1 + cdf(e / h)
                mw = (c.w**2 if sampling else c.w) * r**2 * psi**2
                out = []
                for v in (kw, mw):
                    full = np.zeros((p + m, p + m))
                    full[:p, :p] = c.x.T @ (v[:, None] * c.x)
                    if m:
                        cross = np.zeros((m, p))
                        np.add.at(cross, c.unit, v[:, None] * c.x)
                        full[p:, :p], full[:p, p:] = cross, cross.T
                        full[p:, p:] = np.diag(np.bincount(c.unit, v, m))
                    out.append(full)
                return tuple(out)

            bread, meat = self.rows.reduce(sums)
            bread[:p, :p] += lay.pen_beta
            if m:
                bread[p:, p:] += lam * self.field.q
            free = self._free(p) if m and self.field.constrained else np.eye(p + m)
            inv = np.linalg.pinv(free.T @ bread @ free, rcond=1e-10)
            full.append(free @ inv @ (free.T @ meat @ free) @ inv @ free.T)
        gate = np.zeros((0, 0))
        if s.G > 1:
            gate = solvers.gate_sandwich(self.rows, st, st.gamma, self.gate_hessian, sampling)
        scale = self.n / self.sum_raw if s.weights_type == "frequency" and self.sum_raw else 1.0
        full = [v * scale for v in full]
        self.vcov = {"coef": [v[:p, :p] for v in full], "gate": gate * scale, "full": full, "method": "sandwich", "h_inverse": True}
        return self.vcov

    def bootstrap(self, B: int | None = None) -> dict:
        """Covariances over resampled fits. A replicate counts every row's draws: multinomial over blocks where sites allow, else Poisson by row."""
        s, lay, c = self.spec, self.layout, self.spec.control
        rng = np.random.default_rng(c.seed + 1)
        sampling = s.weights_type == "sampling"
        block_of, n_rows, seed = self._blocks(), self.n, 1000 * c.seed
        mass = float(self.rows.reduce(lambda ch: (ch.w.sum(),))[0])
        if block_of is not None:
            share = self.rows.reduce(lambda ch: (np.bincount(block_of(ch), ch.w if sampling else np.ones(len(ch)), MAX_UNITS),))[0]
            names = np.flatnonzero(share)
        draws = []
        for r in range(B or c.boot_B):
            if block_of is None:
                times = lambda ch, r=r: poisson(ch.w * (n_rows / mass) if sampling else np.ones(len(ch)), uniforms(ch.key, seed + r))
            else:
                picked = np.bincount(names[rng.choice(len(names), len(names), p=share[names] / share.sum())], minlength=MAX_UNITS)
                times = lambda ch, picked=picked: picked[block_of(ch)]

            def drawn(ch: Chunk, scale: float = 1.0, times=times) -> Chunk:
                count = times(ch)
                own = ch.take(np.flatnonzero(count))
                return replace(own, w=scale * count[count > 0] * (1.0 if sampling else own.w))

            once = self.rows.mapped(drawn)
            try:
                n, w = once.reduce(lambda ch: (float(len(ch)), ch.w.sum()))
                got = s._run(self.rows.mapped(lambda ch, f=n / w: drawn(ch, f)), lay, self.field, self.state.posterior)
            except (np.linalg.LinAlgError, FloatingPointError):
                continue
            st = got["state"]
            order = align(st.beta, self.state.beta)
            draws.append(np.concatenate([st.beta[:, order].T.ravel(), st.gamma.T.ravel()]))
        if len(draws) < 2:
            self.vcov = {"coef": None, "gate": None, "method": "boot"}
            return self.vcov
        cov = np.cov(np.stack(draws).T)
        p = len(lay.pen_beta)
        self.vcov = {"coef": [cov[k * p : (k + 1) * p, k * p : (k + 1) * p] for k in range(s.G)], "gate": cov[s.G * p :, s.G * p :], "all": cov, "method": "boot", "draws": len(draws)}
        return self.vcov

    def _blocks(self):
        """Function from rows to block numbers, or None: parts of the graph, or a grid of quantiles of the coordinates."""
        c = self.spec.control
        side, enough = c.boot_block, c.min_sites
        if self.field is not None:
            by_unit = areal_blocks(self.field, c.boot_areal_blocks, np.random.default_rng(c.seed))
            return lambda ch: by_unit[ch.unit]
        if self.spec.coords and self.layout.spatial_gate and c.boot_block > 1:
            # the plane part of the basis: standardised coordinates
            sites = self.rows.reduce(lambda ch: (Few({tuple(v) for v in np.unique(ch.z[:, -2:], axis=0)[:enough].tolist()}, enough),))[0]
            if len(sites.rows) >= c.min_sites:
                inner = np.linspace(0, 1, c.boot_block + 1)[1:-1].tolist()
                cuts = [self.rows.quantiles(inner, lambda ch, i=i: ch.z[:, i]) for i in (-2, -1)]

                def place(ch: Chunk) -> np.ndarray:
                    one, two = (np.clip(np.searchsorted(cuts[k], ch.z[:, k - 2], side="left"), 0, side - 1) for k in (0, 1))
                    return one * side + two

                return place
        return None

    def confint(self, level: float = 0.95) -> list[tuple[int, str, float, float, float]]:
        if self.vcov is None:
            self.sandwich()
        z = NormalDist().inv_cdf(0.5 + level / 2)
        out = []
        for k in range(self.spec.G):
            se = np.sqrt(np.maximum(np.diag(self.vcov["coef"][k])[self.layout.const_rows], 0))
            out += [(k + 1, name, float(b), float(b - z * s), float(b + z * s)) for name, b, s in zip(self.x_names, self.coef[:, k], se)]
        return out

    def summary(self, spark) -> DataFrame:
        """(regime, term, estimate, se, z, p) of the constant coefficients."""
        if self.vcov is None:
            self.sandwich()
        rows = []
        for k in range(self.spec.G):
            se = np.sqrt(np.maximum(np.diag(self.vcov["coef"][k])[self.layout.const_rows], 0))
            for name, b, s in zip(self.x_names, self.coef[:, k], se):
                z = float(b / s) if s > 0 else None
                rows.append((k + 1, name, float(b), float(s), z, None if z is None else 2 * NormalDist().cdf(-abs(z))))
        return spark.createDataFrame(rows, "regime int, term string, estimate double, se double, z double, p double")

    def gate_table(self, spark) -> DataFrame:
        """(regime, term, estimate, se, z, p) of the gate's covariates, against regime 1."""
        if self.vcov is None:
            self.sandwich()
        q1, rows = len(self.layout.pen_gamma), []
        for a in range(self.spec.G - 1):
            for i, name in enumerate(self.z_names):
                at, v = a * q1 + i, self.vcov["gate"]
                se = float(np.sqrt(max(v[at, at], 0))) if v is not None and at < len(v) else None
                b = float(self.state.gamma[i, a])
                z = b / se if se else None
                rows.append((a + 2, name, b, se, z, None if z is None else 2 * NormalDist().cdf(-abs(z))))
        return spark.createDataFrame(rows, "regime int, term string, estimate double, se double, z double, p double")

    def spatial_table(self, spark) -> DataFrame:
        """(regime, kind, n_units, n_components, alpha, lambda, variance) of the spatial effect; empty without one."""
        e, rows = self.spec.spatial_error, []
        if self.field is not None:
            lam = self.spec.control.lambda_error if self.spec.lambda_error is None else self.spec.lambda_error
            rows = [(k + 1, e.kind, self.field.size, len(np.unique(self.field.component)), None if e.kind == "nngp" else e.alpha, lam, float(self.state.phi[:, k].var(ddof=1))) for k in range(self.spec.G)]
        return spark.createDataFrame(rows, "regime int, kind string, n_units int, n_components int, alpha double, lambda double, variance double")

    def deconfounding(self, spark) -> DataFrame:
        """(term, spatial_r2) of the covariates whose smooth was taken out."""
        rows = [(self.x_names[j], float(r2)) for j, (_, r2) in (self.plus or {"fits": {}})["fits"].items()]
        return spark.createDataFrame(rows, "term string, spatial_r2 double")

    def diagnostics(self, spark) -> DataFrame:
        """One row: likelihood, degrees of freedom, criteria, convergence, gate condition, class entropy, effective rows."""
        e = self.edf
        row = (e["loglik"], e["total"], e["aic"], e["bic"], bool(self.run["converged"]), int(self.run["iterations"]), self.run["gate_cond"], e["class_entropy"], float(e["nobs"]))
        return spark.createDataFrame([row], "loglik double, edf double, aic double, bic double, converged boolean, iterations int, gate_cond double, class_entropy double, n_eff double")

    def __repr__(self) -> str:
        s = self.spec
        head = f"Spatial mixture of quantile regressions: G = {s.G}, tau = {s.tau:.3g}, method = {s.method}, spatial gate: {self.layout.spatial_gate}, spatial slopes: {self.layout.spatial_coef}"
        lines = [head, *(f"  regime {k + 1}: " + ", ".join(f"{n} {v:.4f}" for n, v in zip(self.x_names, self.coef[:, k])) for k in range(s.G))]
        if math.isfinite(self.edf.get("loglik", math.nan)):
            lines.append(f"  logLik = {self.edf['loglik']:.2f}, edf = {self.edf['total']:.2f}, AIC = {self.edf['aic']:.1f}, BIC = {self.edf['bic']:.1f}")
        return "\n".join(lines)

    # -- rows of df with what the model says of them
    def fitted(self, df: DataFrame) -> DataFrame:
        """df with fitted: the quantiles weighted by the posterior."""
        out = self.transform(df)
        at = [F.lit(k) for k in range(self.spec.G)]
        mean = scalar.mixture_mean([F.get("posterior", k) for k in at], [F.get("quantiles", k) for k in at])
        return out.select(*(F.col(f"`{c}`") for c in df.columns), mean.alias("fitted"))

    def residuals(self, df: DataFrame) -> DataFrame:
        """df with fitted and residual."""
        return self.fitted(df).withColumn("residual", self.formula.response_column()[0].cast("double") - F.col("fitted"))

    def class_map(self, df: DataFrame) -> DataFrame:
        """(regime, coord1, coord2 | region): the likeliest regime of every row."""
        g = self.spec.G
        out = self.transform(df).withColumn("regime", scalar.first_max([F.get("posterior", F.lit(k)) for k in range(g)]))
        s = self.spec
        place = [F.col(s.coords[0]).alias("coord1"), F.col(s.coords[1]).alias("coord2")] if s.coords else [F.col(s.region).alias("region")] if s.region else []
        return out.select("regime", *place)

    def density_table(self, spark, points: int = 512) -> DataFrame:
        """(regime, residual, density): kernel densities of each regime's residuals over all rows, unweighted, on a grid."""
        st, rows = self.state, []
        plain = solvers.State(st.beta, st.phi, st.gamma, [], st.tau)
        for k in range(self.spec.G):
            one = lambda c, k=k: (c.y[:, None] - plain.fitted(c))[:, k]
            n, m, q = self.rows.reduce(lambda c: (lambda e: (float(len(e)), e.sum(), (e * e).sum()))(one(c)))
            low, high = self.rows.quantiles([0.25, 0.75], one)
            least, most = self.rows.quantiles([0.0, 1.0], one)
            sd = math.sqrt(max(q - m * m / n, 0.0) / max(n - 1, 1.0))
            width = 0.9 * (min(sd, (high - low) / 1.34) or sd or 1.0) * n**-0.2
            grid = np.linspace(least - 3 * width, most + 3 * width, points)
            step = grid[1] - grid[0]
            count = self.rows.reduce(lambda c: (np.bincount(np.clip(np.rint((one(c) - grid[0]) / step).astype(int), 0, points - 1), minlength=points),))[0]
            reach = int(np.ceil(4 * width / step))
            kernel = pdf(np.arange(-reach, reach + 1) * step / width) / (width * n)
            value = np.convolve(count, kernel)[reach : reach + points]
            rows += [(k + 1, float(a), float(b)) for a, b in zip(grid, value)]
        return spark.createDataFrame(rows, "regime int, residual double, density double")

    def slope_surface(self, df: DataFrame, covariate: int = 1) -> DataFrame:
        """df with slopes: one covariate's slope in every regime at the row's place."""
        lay, st = self.layout, self.state
        out = df.withColumn("_b", self._basis_column()) if lay.blocks else df
        slopes = []
        for k in range(self.spec.G):
            v = F.lit(float(st.beta[lay.const_rows[covariate], k]))
            if lay.blocks:
                v = v + scalar.dot([F.get("_b", F.lit(j)) for j in range(lay.r)], st.beta[lay.blocks[covariate - 1], k])
            slopes.append(v)
        return out.select(*(F.col(f"`{c}`") for c in df.columns), F.array(*slopes).alias("slopes"))

    def stability(self, df: DataFrame, covariate: int = 1) -> DataFrame:
        """One row: the share of places where the regimes' slopes are not in their average order."""
        names = [f"_slope{k}" for k in range(self.spec.G)]
        return label_stability(self.slope_surface(df, covariate).select(*(F.get("slopes", F.lit(k)).alias(n) for k, n in enumerate(names))), names)

    # -- residual autocorrelation
    def unit_sums(self, phi: np.ndarray) -> np.ndarray:
        """Responsibility-weighted mean residual of every unit, nan where it has no rows."""
        st, n = self.state, self.field.size

        def sums(c: Chunk):
            e = (st.posterior(c) * (c.y[:, None] - c.x @ st.beta - phi[c.unit])).sum(1)
            return np.bincount(c.unit, e, n), np.bincount(c.unit, minlength=n)

        total, count = self.rows.reduce(sums)
        with np.errstate(all="ignore"):
            return total / count

    def moran(self, spark, edges: DataFrame | None = None, nsim: int = 199, df: DataFrame | None = None, units: DataFrame | None = None) -> DataFrame:
        """Permutation Moran test of unit residuals: (stage, statistic, p_value, n_units, nsim).

        edges (i, j, w over unit numbers) replaces the model's own graph. With a spatial effect there are two rows, before (effects
        dropped) and after. Without one edges are needed, and df with its units (unit and x, y or region), of which the
        residuals are averaged.
        """
        from terraquant.operators.moran import permutation_test

        if self.field is None:
            if edges is None or df is None or units is None:
                raise ValueError("a fit without a spatial effect needs edges, df and units")
            s = self.spec
            part = self.residuals(df)
            if s.region:
                keyed = part.join(units.select("unit", F.col("region").alias("_region")), F.col(s.region).cast("string") == F.col("_region"))
            else:
                keyed = part.join(units.select("unit", F.col("x").alias("_ux"), F.col("y").alias("_uy")), (F.col(s.coords[0]).cast("double") == F.col("_ux")) & (F.col(s.coords[1]).cast("double") == F.col("_uy")))
            got = keyed.groupBy("unit").agg(F.avg("residual").alias("r")).toPandas()
            n = units.count()
            z = np.full(n, np.nan)
            z[got["unit"].to_numpy() - 1] = got["r"].to_numpy(float)
            stages = [("single", z)]
        else:
            n = self.field.size
            stages = [("before", self.unit_sums(np.zeros_like(self.state.phi))), ("after", self.unit_sums(self.state.phi))]
        if n > MAX_UNITS:
            raise ValueError(f"the test takes at most {MAX_UNITS} units")
        if edges is not None:
            e = edges.toPandas()
            w = np.zeros((n, n))
            np.add.at(w, (e["i"].to_numpy() - 1, e["j"].to_numpy() - 1), e["w"].to_numpy(float))
        elif self.field.adjacency is not None:
            w = self.field.adjacency
        else:
            w = -(self.field.q - np.diag(np.diag(self.field.q))) / (self.spec.spatial_error.alpha if self.spec.spatial_error.kind == "proper" else 1.0)
        rows = [(stage, *permutation_test(z, w, nsim, self.spec.control.seed), nsim) for stage, z in stages]
        return spark.createDataFrame(rows, "stage string, statistic double, p_value double, n_units int, nsim int")


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers with given means from numbers in (0, 1)."""
    out, p = np.zeros(len(u), int), np.exp(-mean)
    total, k = p.copy(), 0
    open_rows = u > total
    while open_rows.any() and k < 1000 + 10 * mean.max(initial=0.0):
        k += 1
        p = p * mean / k
        total = total + p
        out[open_rows] = k
        open_rows = u > total
    return out


def long_surface(df: DataFrame, values: list[Column], name: str, coords: tuple[str, str] | None = None, region: str | None = None) -> DataFrame:
    """One row per row of df and regime: (regime, name, coord1, coord2 | region)."""
    place = [F.col(coords[0]).alias("coord1"), F.col(coords[1]).alias("coord2")] if coords else [F.col(region).alias("region")] if region else []
    long = df.select(F.posexplode(F.array(*values)).alias("_k", name), *place)
    return long.select((F.col("_k") + 1).cast("int").alias("regime"), *(c for c in long.columns if c != "_k"))


def field_variance(phi: DataFrame) -> DataFrame:
    """(regime, variance) of the effects (regime, unit, phi)."""
    return phi.groupBy("regime").agg(F.var_samp("phi").alias("variance"))


def spatial_share(df: DataFrame, x: Column, smooth: Column) -> DataFrame:
    """One row (r2): the share of x's variance that its smooth takes away."""
    return df.agg((1 - F.var_samp(x - smooth) / F.var_samp(x)).alias("r2"))


def expression_columns(text: str) -> set[str]:
    return expression(text)[1]


def align(b: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Order of b's columns that matches ref greedily, by ascending distance of the best match."""
    d = ((b[:, :, None] - ref[:, None, :]) ** 2).sum(0)
    out = np.full(ref.shape[1], -1)
    free = set(range(b.shape[1]))
    for r in np.argsort(d.min(0), kind="stable"):
        pick = min(free, key=lambda i: (d[i, r], i))
        out[r] = pick
        free.discard(pick)
    return out


def areal_blocks(fld: solvers.Field, n_blocks: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of units: components apart, large ones cut by k-means on smooth eigenvectors of their graph."""
    out, following = np.zeros(fld.size, int), 0
    for comp in np.unique(fld.component):
        at = np.flatnonzero(fld.component == comp)
        share = max(1, round(n_blocks * len(at) / fld.size))
        if share < 2 or len(at) <= share:
            out[at] = following
            following += 1
            continue
        w = -(fld.q[np.ix_(at, at)])
        np.fill_diagonal(w, 0)
        d = np.maximum(w.sum(1), 1e-12)
        _, v = np.linalg.eigh(np.eye(len(at)) - w / np.sqrt(np.outer(d, d)))
        f = v[:, :3]
        centre = f[rng.choice(len(at), share, replace=False)]
        for _ in range(50):
            label = ((f[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            centre = np.stack([f[label == k].mean(0) if (label == k).any() else f[rng.integers(len(at))] for k in range(share)])
        out[at] = following + label
        following += share
    return out
