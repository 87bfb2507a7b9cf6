"""Penalised quantile and gate regressions as loops over sums of rows."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from terraquant.operators.sums import Chunk, Least, LocalRows, Parts, cdf, pdf, row_keys, uniforms

FLOOR = 1e-12
#: Rows near the fit that the exact quantile step gathers on the driver; the others enter it as two sums.
BAND = 50_000
#: Clusterings of one start, and their rounds.
CLUSTERINGS, CLUSTER_ROUNDS = 3, 25


def check(u: np.ndarray, tau: float) -> np.ndarray:
    return u * (tau - (u < 0))


def softmax_rows(z: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    # one class after the other: sums along short rows are slow
    eta = np.vstack([np.zeros((1, len(z))), (z @ gamma).T])
    e = np.exp(eta - eta.max(axis=0))
    return (e / e.sum(axis=0)).T


#: Units of an undivided part of a dissected matrix, and the values that its factor may hold on the driver; beyond, conjugate gradients need none.
PART_UNITS, FACTOR_VALUES = 100, 1 << 27


@dataclass
class Front:
    """Part of a dissected matrix: its own units, later units tied to them, entries (of Sparse.v) with their place in the front, parts below with the place of their ties."""

    own: np.ndarray
    tied: np.ndarray
    entry: np.ndarray
    row: np.ndarray
    col: np.ndarray
    below: list[tuple[int, np.ndarray]]


class Sparse:
    """Symmetric matrix of so many rows by its entries; each row has some. place: coordinates of the rows, by which systems are dissected."""

    __array_ufunc__ = None

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, place: np.ndarray | None = None):
        at, back = np.unique(i.astype(np.int64) * n + j, return_inverse=True)
        self.i, self.j, self.v = at // n, at % n, np.bincount(back, v)
        self.starts, self.n, self.place = np.searchsorted(self.i, np.arange(n)), n, place

    def __len__(self) -> int:
        return self.n

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        if x.ndim == 1:
            return np.add.reduceat(self.v * x[self.j], self.starts)
        return np.stack([self @ c for c in np.ascontiguousarray(x.T)], 1)

    __rmatmul__ = __matmul__  # of vectors

    @cached_property
    def fronts(self) -> list[Front] | None:
        """Nested dissection: halves by place, between them the units that take all links across; parts below come first. None where the factor is too large."""
        if self.place is None:
            return None
        out: list[Front] = []
        ends, held = np.append(self.starts, len(self.v)), 0
        side, at, done = np.zeros(self.n, np.int8), np.empty(self.n, np.int64), np.zeros(self.n, bool)

        def entries(rows: np.ndarray) -> np.ndarray:
            many = ends[rows + 1] - ends[rows]
            return np.repeat(ends[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())

        def divide(rows: np.ndarray) -> int:
            nonlocal held
            own, below = rows, []
            if len(rows) > PART_UNITS:
                rows = rows[np.argsort(self.place[rows, int(np.ptp(self.place[rows, 1]) > np.ptp(self.place[rows, 0]))], kind="stable")]
                a, b = rows[: len(rows) // 2], rows[len(rows) // 2 :]
                side[a], side[b] = 1, 2
                e = entries(a)
                e = e[side[self.j[e]] == 2]
                own = _cover(self.i[e], self.j[e])
                side[own] = 0
                a, b = a[side[a] > 0], b[side[b] > 0]
                side[rows] = 0
                below = [divide(part) for part in (a, b)]
            e = entries(own)
            done[own] = True
            later = self.j[e][~done[self.j[e]]]
            tied = np.unique(np.concatenate([later, *(out[k].tied for k in below)]))
            tied = tied[~done[tied]]
            held += len(own) * (len(own) + len(tied))
            if held > FACTOR_VALUES:
                raise OverflowError
            every = np.concatenate([own, tied])
            at[every] = np.arange(len(every))
            side[every] = 1
            e = e[side[self.j[e]] == 1]
            side[every] = 0
            out.append(Front(own, tied, e, at[self.i[e]], at[self.j[e]], [(k, at[out[k].tied]) for k in below]))
            return len(out) - 1

        try:
            divide(np.arange(self.n))
        except OverflowError:
            return None
        return out

    def solve(self, scale: float, diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
        """x of (scale * self + diagonal) x = right by its fronts, for a positive definite sum."""
        fronts, c = self.fronts, right.shape[1]
        kept: list[np.ndarray] = [right] * len(fronts)
        rest: dict[int, np.ndarray] = {}

        def eliminate(k: int) -> None:
            f = fronts[k]
            n, size = len(f.own), len(f.own) + len(f.tied)
            m = np.zeros((size, size + c))  # the right-hand sides are the last columns
            for nth, (b, where) in enumerate(f.below):
                at = where[:, None], np.append(where, size + np.arange(c))
                if nth:
                    m[at] += rest.pop(b)
                else:
                    m[at] = rest.pop(b)
            m[f.row, f.col] += scale * self.v[f.entry]
            m[np.arange(n), np.arange(n)] += diagonal[f.own]
            m[:n, size:] += right[f.own]
            kept[k] = np.linalg.solve(m[:n, :n], m[:n, n:])
            rest[k] = m[n:, n:] - m[:n, n:size].T @ kept[k]

        for k in range(len(fronts)):
            eliminate(k)
        x = np.empty_like(right)
        for f, both in zip(fronts[::-1], kept[::-1]):
            x[f.own] = both[:, len(f.tied) :] - both[:, : len(f.tied)] @ x[f.tied]
        return x


def _cover(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Few units that every link (a, b) has one of: those of most links first."""
    out = [np.zeros(0, np.int64)]
    while len(a):
        unit, back, links = np.unique(np.concatenate([a, b]), return_inverse=True, return_counts=True)
        most = links.max()
        pick = np.flatnonzero(links >= 0.7 * most) if most > 3 else np.flatnonzero(links == most)
        pick = pick if most > 3 else pick[: max(1, len(pick) // 4)] if most > 1 else back[: len(a)]
        out.append(unit[pick])
        taken = np.zeros(len(unit), bool)
        taken[pick] = True
        left = ~(taken[back[: len(a)]] | taken[back[len(a) :]])
        a, b = a[left], b[left]
    return np.unique(np.concatenate(out))


@dataclass
class Bordered:
    """The matrix of (b, phi): a dense block of few rows, a border, and scale * q plus a diagonal."""

    a: np.ndarray
    cross: np.ndarray
    diagonal: np.ndarray
    q: Sparse
    scale: float

    def __len__(self) -> int:
        return len(self.a) + len(self.q)

    def columns(self, at: np.ndarray) -> np.ndarray:
        """Columns of the matrix without scale * q."""
        p, out = len(self.a), np.zeros((len(self), len(at)))
        for k, j in enumerate(at):
            out[:p, k] = self.a[:, j] if j < p else self.cross[j - p]
            if j < p:
                out[p:, k] = self.cross[:, j]
            else:
                out[j, k] = self.diagonal[j - p]
        return out

    def _gradients(self, right: np.ndarray, tol: float, maxit: int) -> np.ndarray:
        scale = 1 / (self.scale * np.bincount(self.q.i, np.where(self.q.i == self.q.j, self.q.v, 0), len(self.q)) + self.diagonal)[:, None]
        x, r = np.zeros_like(right), right.copy()
        z = scale * r
        d, rz = z, (r * z).sum(0)
        goal = tol * np.sqrt((right * right).sum(0))
        for _ in range(maxit):
            open_ = np.sqrt((r * r).sum(0)) > goal
            if not open_.any():
                break
            m = self.scale * (self.q @ d) + self.diagonal[:, None] * d
            step = np.where(open_, rz / np.where(open_, (d * m).sum(0), 1.0), 0.0)
            x, r = x + step * d, r - step * m
            z = scale * r
            new = (r * z).sum(0)
            d, rz = z + np.where(open_, new / np.where(rz > 0, rz, 1.0), 0.0) * d, new
        else:
            raise RuntimeError("the system of the spatial effect was not solved")
        return x

    def solve(self, g: np.ndarray, tol: float = 1e-12, maxit: int = 20_000) -> np.ndarray:
        """For phi by the matrix's fronts, else by conjugate gradients, all right-hand sides at once; then the small system that is left for b."""
        p = len(self.a)
        right = np.column_stack([self.cross, g[p:]])
        x = self._gradients(right, tol, maxit) if self.q.fronts is None else self.q.solve(self.scale, self.diagonal, right)
        c, w = x[:, :p], x[:, p:]
        b = robust_solve(self.a - self.cross.T @ c, g[:p].reshape(p, -1) - self.cross.T @ w)
        return np.vstack([b, w - c @ b]).reshape(g.shape)


def robust_solve(a: np.ndarray | Bordered, b: np.ndarray) -> np.ndarray:
    if isinstance(a, Bordered):
        return a.solve(b)
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a + 1e-8 * np.eye(len(a)), b)


@dataclass
class Field:
    """A spatial effect over units: precision q, components of the graph; constrained to sum to zero in each, or free. adjacency: weights of neighbours, where they do not follow from q."""

    q: np.ndarray | Sparse
    component: np.ndarray
    constrained: bool = True
    adjacency: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.q)

    def constraints(self) -> np.ndarray:
        if not self.constrained:
            return np.zeros((0, self.size))
        return (self.component[None, :] == np.unique(self.component)[:, None]).astype(float)

    def singletons(self) -> np.ndarray:
        _, back, n = np.unique(self.component, return_inverse=True, return_counts=True)
        return n[back] == 1 if self.constrained else np.zeros(self.size, bool)


@dataclass
class State:
    """Parameters of the mixture; responsibilities follow from them, before the first step from start, or the rows' own start probabilities."""

    beta: np.ndarray
    phi: np.ndarray
    gamma: np.ndarray
    density: list
    tau: float
    started: bool = False
    start: Callable[[Chunk], np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_last"}

    def fitted(self, c: Chunk) -> np.ndarray:
        out = c.x @ self.beta
        if len(self.phi):
            seen = c.unit >= 0
            out[seen] += self.phi[c.unit[seen]]
        return out

    def densities(self, c: Chunk) -> np.ndarray:
        e = c.y[:, None] - self.fitted(c)
        return np.stack([d(e[:, k]) for k, d in enumerate(self.density)]).T

    def prior(self, c: Chunk) -> np.ndarray:
        return softmax_rows(c.z, self.gamma)

    def posterior(self, c: Chunk) -> np.ndarray:
        if not self.started:
            return c.p if self.start is None else self.start(c)
        # the sums of one EM step ask for the same rows many times
        last = self.__dict__.get("_last")
        if last is None or last[0]() is not c:
            m = np.maximum(self.prior(c) * self.densities(c), FLOOR)
            last = self._last = weakref.ref(c), m / m.sum(axis=1, keepdims=True)
        return last[1]


@dataclass(frozen=True)
class Laplace:
    """Asymmetric Laplace density."""

    sigma: float
    tau: float

    def __call__(self, e: np.ndarray) -> np.ndarray:
        s = max(self.sigma, 1e-8)
        return self.tau * (1 - self.tau) / s * np.exp(-check(e, self.tau) / s)


@dataclass(frozen=True)
class Kernel:
    """Binned Gaussian kernel density whose mass below 0 is tau, by interpolation."""

    grid: np.ndarray
    value: np.ndarray

    def __call__(self, e: np.ndarray) -> np.ndarray:
        return np.maximum(np.interp(e, self.grid, self.value, left=0.0, right=0.0), FLOOR)


def _gram(c: Chunk, k: int, old: State, b: np.ndarray, phi: np.ndarray, h: float, n_units: int):
    w = c.w * old.posterior(c)[:, k]
    e = c.y - c.x @ b
    if n_units:
        e = e - phi[c.unit]
    u = e / h
    psi, kw = w * (old.tau - 1 + cdf(u)), w * pdf(u) / h
    out = [c.x.T @ (kw[:, None] * c.x), c.x.T @ psi]
    if n_units:
        cross = np.zeros((n_units, c.x.shape[1]))
        np.add.at(cross, c.unit, kw[:, None] * c.x)
        out += [np.bincount(c.unit, kw, n_units), cross, np.bincount(c.unit, psi, n_units)]
    return tuple(out)


def _losses(c: Chunk, k: int, old: State, b: np.ndarray, phi: np.ndarray, db: np.ndarray, dphi: np.ndarray, h: float, steps: tuple[float, ...]):
    w = c.w * old.posterior(c)[:, k]
    e = c.y - c.x @ b
    d = c.x @ db
    if len(phi):
        e, d = e - phi[c.unit], d + dphi[c.unit]
    out = []
    for s in steps:
        u = e - s * d
        out.append((w * (u * (old.tau - 1 + cdf(u / h)) + h * pdf(u / h))).sum())
    return (np.array(out),)


def _least_squares(c: Chunk, k: int, old: State, n_units: int):
    w = c.w * old.posterior(c)[:, k]
    out = [c.x.T @ (w[:, None] * c.x), c.x.T @ (w * c.y)]
    if n_units:
        cross = np.zeros((n_units, c.x.shape[1]))
        np.add.at(cross, c.unit, w[:, None] * c.x)
        out += [np.bincount(c.unit, w, n_units), cross, np.bincount(c.unit, w * c.y, n_units)]
    return tuple(out)


def _system(sums, pen: np.ndarray, field: Field | None, lam: float, ridge: float):
    """Hessian of (b, phi)."""
    a = sums[0] + pen + ridge * np.eye(len(pen))
    if field is None:
        return a
    p, m = len(a), field.size
    if isinstance(field.q, Sparse):
        return Bordered(a, sums[3], sums[2] + ridge, field.q, lam)
    out = np.zeros((p + m, p + m))
    out[:p, :p] = a
    out[p:, p:] = lam * field.q + np.diag(sums[2]) + ridge * np.eye(m)
    out[p:, :p] = sums[3]
    out[:p, p:] = sums[3].T
    return out


def least_squares(rows, k: int, old: State, pen: np.ndarray, field: Field | None = None, lam: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Penalised weighted least squares of regime k, the start of its quantile regression: (b, phi)."""
    m, p = field.size if field else 0, len(pen)
    s = rows.reduce(_least_squares, k, old, m)
    rhs = s[1] if field is None else np.concatenate([s[1], s[4]])
    both = _constrained(_system(s, pen, field, lam, 1e-6), rhs, field, p)
    return both[:p], both[p:]


def _constrained(h: np.ndarray, g: np.ndarray, field: Field | None, p: int) -> np.ndarray:
    """Newton step that keeps every component's sum of effects at zero."""
    if field is None or not field.constrained:
        return robust_solve(h, g)
    a = np.hstack([np.zeros((len(np.unique(field.component)), p)), field.constraints()])
    if isinstance(h, Bordered):
        both = h.solve(np.column_stack([a.T, g]))
        border, free = both[:, : len(a)], both[:, len(a) :]
        return (free - border @ robust_solve(a @ border, a @ free)).reshape(g.shape)
    kkt = np.block([[h, a.T], [a, np.zeros((len(a), len(a)))]])
    return robust_solve(kkt, np.concatenate([g, np.zeros(len(a))]))[: len(h)]


def _residual(c: Chunk, b: np.ndarray, phi: np.ndarray) -> np.ndarray:
    e = c.y - c.x @ b
    return e - phi[c.unit] if len(phi) else e


def scale_of(rows, b: np.ndarray, phi: np.ndarray) -> float:
    centre = rows.median(_residual, b, phi)
    s = 1.4826 * rows.median(lambda c, *a: np.abs(_residual(c, *a) - centre), b, phi)
    if np.isfinite(s) and s > 0:
        return s
    n, m, q = rows.reduce(lambda c: (float(len(c)), _residual(c, b, phi).sum(), (_residual(c, b, phi) ** 2).sum()))
    s = np.sqrt(max(q / n - (m / n) ** 2, 0) * n / max(n - 1, 1))
    return float(s) if np.isfinite(s) and s > 0 else 1.0


def pooled_scale(rows, state: State) -> float:
    """Scale of the residuals of all regimes together."""

    def residuals(c: Chunk) -> np.ndarray:
        return (c.y[:, None] - state.fitted(c)).ravel()

    centre = rows.median(residuals)
    s = 1.4826 * rows.median(lambda c: np.abs(residuals(c) - centre))
    if np.isfinite(s) and s > 0:
        return s
    n, m, q = rows.reduce(lambda c: (lambda e: (float(len(e)), e.sum(), (e * e).sum()))(residuals(c)))
    s = np.sqrt(max(q / n - (m / n) ** 2, 0) * n / max(n - 1, 1))
    return float(s) if np.isfinite(s) and s > 0 else 1.0


def smooth_quantile(rows, k: int, old: State, pen: np.ndarray, rate: float, field: Field | None = None, lam: float = 1.0, start=None, floor: float = 1e-3, maxit: int = 50, tol: float = 1e-7, target: float | None = None):
    """Penalised smoothed quantile regression of regime k by annealed Newton: (b, phi, bandwidth).

    Every Newton step is one pass for score and curvature and at most two for the step length.
    """
    m = field.size if field else 0
    p = len(pen)
    if start is None or not np.any(start[0]):
        b, phi = least_squares(rows, k, old, pen, field, lam)
    else:
        b, phi = start
    s0 = scale_of(rows, b, phi)
    goal = target if target is not None else max(floor, rate * s0)
    wide = max(goal, 1.5 * s0)
    n_stages = max(1, int(np.ceil(np.log2(wide / goal))) + 1)
    path = np.exp(np.linspace(np.log(wide), np.log(goal), n_stages)) if n_stages > 1 else np.array([goal])
    for h in path:
        for _ in range(maxit):
            s = rows.reduce(_gram, k, old, b, phi, h, m)
            g = s[1] - pen @ b
            if field is not None:
                g = np.concatenate([g, s[4] - lam * (field.q @ phi)])
            step = _constrained(_system(s, pen, field, lam, 1e-8), g, field, p)
            db, dphi = step[:p], step[p:]

            def penalty(t: float) -> float:
                bb = b + t * db
                out = 0.5 * bb @ pen @ bb
                if field is not None:
                    f = phi + t * dphi
                    out += 0.5 * lam * f @ field.q @ f
                return out

            take = 1.0
            now = None
            for steps in ((0.0, 1.0, 0.5, 0.25), tuple(0.5**i for i in range(3, 20))):
                f = rows.reduce(_losses, k, old, b, phi, db, dphi, h, steps)[0] + np.array([penalty(t) for t in steps])
                now = f[0] if now is None else now
                fine = [t for t, v in zip(steps, f) if t > 0 and v <= now + 1e-12]
                if fine:
                    take = fine[0]
                    break
            b, phi = b + take * db, phi + take * dphi
            if take * np.abs(step).max() < tol:
                break
    return b, phi, float(goal)


def exact_quantile(x: np.ndarray, y: np.ndarray, w: np.ndarray, tau: float, b: np.ndarray, pivots: int = 500) -> np.ndarray:
    """Exact weighted quantile regression from a nearby start: moves between vertices until the subgradient fits.

    At a vertex p rows are met exactly. Where one of their multipliers is out of bounds, the vertex moves along the
    matching edge to the minimum of the objective on it, a weighted quantile of the breakpoints. Where more rows
    are met (copies, ties), the signs of theirs are open and moves would go in circles: from then on responses count with
    shifts far below their spread, and the fit is that of the same p rows without shifts.
    """
    p = x.shape[1]
    active = w > 0
    x, y, w = x[active], y[active], w[active]
    basis: list[int] = []
    q = np.zeros((0, p))
    for i in np.argsort(np.abs(y - x @ b), kind="stable"):
        r = x[i] - q.T @ (q @ x[i])
        if np.linalg.norm(r) > 1e-9 * max(1.0, np.linalg.norm(x[i])):
            basis.append(int(i))
            q = np.vstack([q, r / np.linalg.norm(r)])
            if len(basis) == p:
                break
    if len(basis) < p:
        return b
    size = np.abs(y - x @ b)
    unit = float(np.median(size[size > 0])) if (size > 0).any() else 1.0
    own = y
    for _ in range(pivots):
        inverse = np.linalg.inv(x[basis])
        b = inverse @ y[basis]
        e = y - x @ b
        if own is y and (np.abs(e) <= 1e-13 * (unit + np.abs(y))).sum() > p:
            y = own + 1e-10 * unit * (2 * uniforms(np.arange(len(own), dtype=np.uint64), 0) - 1)
            b = inverse @ y[basis]
            e = y - x @ b
        e[basis] = 0
        sign = np.where(e < 0, tau - 1, tau)
        sign[basis] = 0
        u = inverse.T @ (x.T @ (w * sign))
        # stationarity: u_j + v_j w_j = 0 with tau - 1 <= v_j <= tau
        v = -u / w[basis]
        over = np.maximum(v - tau, tau - 1 - v) * w[basis]
        j = int(over.argmax())
        if over[j] <= 1e-10 * max(1.0, w.sum()):
            break
        d = inverse[:, j] * (-1.0 if v[j] > tau else 1.0)
        slope = x @ d
        slope[basis] = 0
        with np.errstate(all="ignore"):
            t = np.where(slope != 0, e / slope, np.inf)
        ok = (t > 1e-14) & np.isfinite(t)
        if not ok.any():
            break
        rows = np.flatnonzero(ok)[np.argsort(t[ok], kind="stable")]
        # directional derivative right at the vertex, then its jumps
        rate = -(w * sign * slope).sum()
        move = d @ x[basis[j]]
        rate += w[basis[j]] * ((1 - tau) * move if move > 0 else -tau * move)
        run = rate + np.cumsum(w[rows] * np.abs(slope[rows]))
        enter = int(rows[min(int(np.searchsorted(run, 0.0)), len(rows) - 1)])
        basis[j] = enter
    return b if own is y else np.linalg.inv(x[basis]) @ own[basis]


def exact_over(rows, k: int, old: State, tau: float, b: np.ndarray, band: int = BAND) -> np.ndarray:
    """Exact quantile regression of regime k over any rows.

    On the executors, rows far from the fit keep the sign of their residual, so their loss is linear: two sums stand for
    them, and only a band of rows around the fit is gathered and solved exactly. Where a far row's sign turns out to differ,
    the band moves on with the fit, as far as the loss over all rows falls. With all signs right the fit is the exact one.
    """
    if isinstance(rows, LocalRows):
        c = rows.chunk
        return exact_quantile(c.x, c.y, c.w * old.posterior(c)[:, k], tau, b)

    def distance(c: Chunk, b: np.ndarray) -> np.ndarray:
        return np.abs(c.y - c.x @ b)

    n = int(rows.reduce(lambda c: (len(c),))[0])
    for _ in range(40):
        width = np.inf if n <= band else float(rows.quantiles([band / n], distance, b)[0])

        def split(c: Chunk, b=b, width=width):
            w, e = c.w * old.posterior(c)[:, k], c.y - c.x @ b
            near = np.abs(e) <= width
            above, below = ~near & (e > 0), ~near & (e < 0)
            return Parts([np.column_stack([c.x, c.y, w])[near]]), c.x[above].T @ w[above], c.x[below].T @ w[below], w.sum()

        near, above, below, total = rows.reduce(split)
        own = np.concatenate(near.parts)
        # two rows that stay above and below whatever the step
        far = 1e3 * max(1.0, float(np.abs(own[:, -2]).max(initial=0.0))) * max(1.0, float(total))
        x = np.vstack([own[:, :-2], above, below])
        y = np.concatenate([own[:, -2], [above @ b + far, below @ b - far]])
        new = exact_quantile(x, y, np.concatenate([own[:, -1], [1.0, 1.0]]), tau, b)
        steps = np.array([0.5**i for i in range(12)])

        def judge(c: Chunk, b=b, new=new, width=width):
            w, e, d = c.w * old.posterior(c)[:, k], c.y - c.x @ b, c.x @ (new - b)
            turned = (np.abs(e) > width) & ((e > 0) != (e - d > 0)) & (w > 0)
            return int(turned.sum()), np.array([(w * check(e - t * d, tau)).sum() for t in (0.0, *steps)])

        turned, loss = rows.reduce(judge)
        if not turned:
            return new
        best = int(loss[1:].argmin())
        if loss[1 + best] >= loss[0]:
            if band >= n:
                return b
            band *= 4
            continue
        b = b + steps[best] * (new - b)
    return b


def everywhere(c: Chunk) -> np.ndarray:
    """Start of a single regime."""
    return np.ones((len(c), 1))


@dataclass(frozen=True)
class RandomStart:
    """Random responsibilities by a hash of each row."""

    n_classes: int
    seed: int

    def __call__(self, c: Chunk) -> np.ndarray:
        key = row_keys(c, self.seed)
        p = np.stack([-np.log(uniforms(key, k)) for k in range(self.n_classes)], 1) + 1e-12
        return p / p.sum(1, keepdims=True)


@dataclass(frozen=True)
class ClusterStart:
    """Soft labels of clustered residuals, with scaled coordinates where blocked."""

    b: np.ndarray
    blocked: bool
    shift: np.ndarray
    spread: np.ndarray
    centre: np.ndarray

    def features(self, c: Chunk) -> np.ndarray:
        e = (c.y - c.x @ self.b)[:, None]
        return ((np.hstack([e, c.place]) if self.blocked else e) - self.shift) / self.spread

    def __call__(self, c: Chunk) -> np.ndarray:
        f, g = self.features(c), len(self.centre)
        p = np.full((len(c), g), 0.2 / (g - 1))
        p[np.arange(len(c)), ((f[:, None] - self.centre[None]) ** 2).sum(2).argmin(1)] = 0.8
        return p


def start_of(rows, n_classes: int, tau: float, kind: str, seed: int, sizes: tuple[int, int], has_place: bool) -> Callable[[Chunk], np.ndarray]:
    """Start of a mixture: random, or clusters of residuals of one quantile regression (resid), with coordinates too (blocked).

    Centres start at rows chosen by hash and move by sums over all rows; of several clusterings the tightest counts.
    """
    p, q = sizes
    if n_classes == 1:
        return everywhere
    if kind == "random":
        return RandomStart(n_classes, seed)
    state = State(np.zeros((p, 1)), np.zeros((0, 1)), np.zeros((q, 0)), [], tau, start=everywhere)
    b, _, _ = smooth_quantile(rows, 0, state, 1e-6 * np.eye(p), 0.3)
    blocked = kind == "blocked" and has_place
    raw = ClusterStart(b, blocked, np.zeros(1), np.ones(1), np.zeros((0, 0)))
    n, one, two = rows.reduce(lambda c: (lambda f: (float(len(f)), f.sum(0), (f * f).sum(0)))(raw.features(c)))
    spread = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
    scaled = ClusterStart(b, blocked, np.where(np.arange(len(one)) == 0, 0.0, one / n), np.where(spread > 0, spread, 1.0), np.zeros((0, 0)))
    reserve = 4 * n_classes
    picks = rows.reduce(lambda c: tuple(Least(row_keys(c, seed + 101 * (r + 1)), scaled.features(c), reserve) for r in range(CLUSTERINGS)))
    spare = [list(x.rows[n_classes:]) for x in picks]
    centres = [np.vstack([x.rows[:n_classes], np.repeat(x.rows[:1], n_classes - len(x.rows[:n_classes]), 0)]) for x in picks]

    def sums(c: Chunk, centres: list[np.ndarray]):
        f, out, tight = scaled.features(c), [], []
        for centre in centres:
            d = ((f[:, None] - centre[None]) ** 2).sum(2)
            label = d.argmin(1)
            out.append(np.stack([np.concatenate([f[label == k].sum(0), [(label == k).sum()]]) for k in range(n_classes)]))
            tight.append(d.min(1).sum())
        return np.stack(out), np.array(tight)

    for turn in range(CLUSTER_ROUNDS + 1):
        total, tight = rows.reduce(sums, centres)
        if turn == CLUSTER_ROUNDS:
            break
        moved = []
        for r, centre in enumerate(centres):
            new = [t[:-1] / t[-1] if t[-1] else spare[r].pop(0) if spare[r] else centre[k] for k, t in enumerate(total[r])]
            moved.append(np.stack(new))
        if all(np.array_equal(a, c) for a, c in zip(moved, centres)):
            break
        centres = moved
    return ClusterStart(scaled.b, blocked, scaled.shift, scaled.spread, centres[int(tight.argmin())])


def gate_fit(rows, old: State, pen: np.ndarray, n_classes: int, maxit: int = 50, tol: float = 1e-8, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Penalised multinomial logit on responsibilities by Newton from start, else from zero: (gamma, Hessian)."""
    q, k = len(pen), n_classes - 1
    gamma = np.zeros((q, k)) if start is None else start
    if k < 1:
        return gamma, np.zeros((0, 0))

    def sums(c: Chunk, g: np.ndarray):
        r, pi = old.posterior(c), softmax_rows(c.z, g)
        score = c.z.T @ (c.w[:, None] * (r - pi)[:, 1:])
        blocks = np.zeros((k, k, q, q))
        for a in range(k):
            for b in range(a, k):
                v = c.w * pi[:, a + 1] * ((a == b) - pi[:, b + 1])
                blocks[a, b] = c.z.T @ (v[:, None] * c.z)
                blocks[b, a] = blocks[a, b].T
        return score, blocks

    hess = np.zeros((q * k, q * k))
    for _ in range(maxit):
        score, blocks = rows.reduce(sums, gamma)
        grad = (score - pen @ gamma).T.ravel()
        hess = -blocks.transpose(0, 2, 1, 3).reshape(q * k, q * k) - np.kron(np.eye(k), pen)
        step = robust_solve(hess, grad).reshape(k, q).T
        gamma = gamma - step
        if np.abs(step).max() < tol:
            break
    return gamma, hess


def gate_sandwich(rows, state: State, gamma: np.ndarray, hessian: np.ndarray, sampling: bool = True) -> np.ndarray:
    """Robust covariance of the gate's coefficients, in the order of its Hessian."""
    q, k = gamma.shape

    def meat_of(c: Chunk):
        d = (state.posterior(c) - softmax_rows(c.z, gamma))[:, 1:]
        score = (d[:, :, None] * c.z[:, None, :]).reshape(len(c), k * q)
        return (score.T @ ((c.w**2 if sampling else c.w)[:, None] * score),)

    inv = np.linalg.pinv(-hessian, rcond=1e-10)
    return inv @ rows.reduce(meat_of)[0] @ inv


def regime_densities(rows, old: State, beta: np.ndarray, phi: np.ndarray, method: str, grid: int = 512, bandwidth: float | None = None) -> list:
    """Density of each regime's residuals under the current responsibilities; the kernel's bandwidth by rule where not given."""
    tau, g = old.tau, beta.shape[1]
    new = State(beta, phi, old.gamma, [], tau)
    if method == "ald":
        num, den = rows.reduce(lambda c: ((lambda pw, e: ((pw * check(e, tau)).sum(0), pw.sum(0)))(c.w[:, None] * old.posterior(c), c.y[:, None] - new.fitted(c))))
        return [Laplace(float(max(n / (d if d > 0 else 1.0), 1e-8)), tau) for n, d in zip(num, den)]

    def moments(c: Chunk):
        pw, e = c.w[:, None] * old.posterior(c), c.y[:, None] - new.fitted(c)
        return pw.sum(0), (pw * e).sum(0), (pw * e * e).sum(0), (pw**2).sum(0)

    s, m, q, s2 = rows.reduce(moments)
    sd = np.sqrt(np.maximum(q / s - (m / s) ** 2, 1e-16))
    grids = [np.linspace(m[k] / s[k] - 6 * sd[k], m[k] / s[k] + 6 * sd[k], grid) for k in range(g)]

    def bins(c: Chunk):
        pw, e = c.w[:, None] * old.posterior(c), c.y[:, None] - new.fitted(c)
        out = []
        for k in range(g):
            step = grids[k][1] - grids[k][0]
            at = np.clip(np.rint((e[:, k] - grids[k][0]) / step).astype(int), 0, grid - 1)
            low = e[:, k] <= 0
            out.append(np.stack([np.bincount(at[low], pw[low, k], grid), np.bincount(at[~low], pw[~low, k], grid)]))
        return (np.stack(out),)

    counts = rows.reduce(bins)[0]
    out = []
    for k in range(g):
        low, high = counts[k]
        tilt = low * (tau / max(low.sum(), FLOOR)) + high * ((1 - tau) / max(high.sum(), FLOOR))
        width = bandwidth or 0.9 * sd[k] * (s[k] ** 2 / max(s2[k], FLOOR)) ** -0.2
        step = grids[k][1] - grids[k][0]
        reach = int(np.ceil(4 * width / step))
        kernel = pdf(np.arange(-reach, reach + 1) * step / width) / width
        out.append(Kernel(grids[k], np.convolve(tilt, kernel)[reach : reach + grid]))
    return out


def mixture_em(rows, n_classes: int, tau: float, pen_beta: np.ndarray, pen_gamma: np.ndarray, rate: float, smooth: bool, field: Field | None, lam: float, method: str = "ald", maxit: int = 200, tol: float = 1e-5, control=None, start: Callable[[Chunk], np.ndarray] | None = None) -> dict:
    """One run of the penalised EM from a start."""
    c = control
    p, g = len(pen_beta), n_classes
    m = field.size if field else 0
    state = State(np.zeros((p, g)), np.zeros((m, g)), np.zeros((len(pen_gamma), max(g - 1, 0))), [], tau, start=start)
    previous, converged, h, it = None, False, rate, 0
    newton = {} if c is None else {"floor": c.sm_floor, "maxit": c.coef_maxit, "tol": c.coef_tol}
    gate = {} if c is None else {"maxit": c.gate_maxit, "tol": c.gate_tol}
    kernel = {} if c is None else {"grid": c.kde_grid, "bandwidth": c.bandwidth}
    for it in range(1, maxit + 1):
        beta, phi = state.beta.copy(), state.phi.copy()
        for k in range(g):
            # an exact fit needs no smoothed one before it where the step before left a start
            if m or smooth or not np.any(beta[:, k]):
                beta[:, k], f, h = smooth_quantile(rows, k, state, pen_beta, rate, field, lam, (state.beta[:, k], state.phi[:, k]), **newton)
                if m:
                    phi[:, k] = f
            if not m and not smooth:
                beta[:, k] = exact_over(rows, k, state, tau, beta[:, k])
        density = regime_densities(rows, state, beta, phi, method, **kernel)
        gamma, hess = gate_fit(rows, state, pen_gamma, g, **gate, start=state.gamma)
        state = State(beta, phi, gamma, density, tau, True)
        now = np.concatenate([beta.ravel(), phi.ravel(), gamma.ravel()])
        if previous is not None and np.abs(now - previous).sum() / (np.abs(previous).sum() + 1e-8) < tol:
            converged = True
            break
        previous = now
        if g == 1 and it > 1:
            converged = True
            break
    gamma, hess = gate_fit(rows, state, pen_gamma, g, **gate, start=state.gamma)
    density = regime_densities(rows, state, state.beta, state.phi, method, **kernel)
    final = State(state.beta, state.phi, gamma, density, tau, True)
    if not smooth and field is None:
        h = max(newton.get("floor", 1e-3), rate * pooled_scale(rows, final))
    ll, loss = rows.reduce(lambda ch: (np.array((ch.w * np.log(np.maximum((final.prior(ch) * final.densities(ch)).sum(1), FLOOR))).sum()), np.array((ch.w[:, None] * final.posterior(ch) * check(ch.y[:, None] - final.fitted(ch), tau)).sum())))
    pen = 0.5 * sum(final.beta[:, k] @ pen_beta @ final.beta[:, k] for k in range(g)) + 0.5 * sum(gamma[:, a] @ pen_gamma @ gamma[:, a] for a in range(gamma.shape[1]))
    if field is not None:
        pen += 0.5 * lam * sum(final.phi[:, k] @ field.q @ final.phi[:, k] for k in range(g))
    loglik = float(ll) if method == "ald" else float("nan")
    objective = (loglik if method == "ald" else -float(loss)) - pen
    return {"state": final, "gate_hessian": hess, "gate_cond": float(np.linalg.cond(-hess)) if len(hess) else float("nan"), "loglik": loglik, "objective": float(objective), "h": float(h), "iterations": it, "converged": converged}
