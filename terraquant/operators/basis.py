"""Low-rank spatial bases: thin-plate, Gaussian-process, and Markov-random-field on regions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Locations that a point basis is built from at most (an even sample beyond).
KNOTS = 400


def _thin_plate(d: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(d > 0, d * d * np.log(np.where(d > 0, d, 1.0)), 0.0)


def _matern(d: np.ndarray) -> np.ndarray:
    s = np.sqrt(3) * d
    return (1 + s) * np.exp(-s)


@dataclass
class Basis:
    """Evaluates r basis columns; omega is their penalty. The columns sum to zero over the locations they were built on."""

    kind: str
    omega: np.ndarray
    centre: np.ndarray
    shift: np.ndarray = field(default_factory=lambda: np.zeros(2))
    spread: np.ndarray = field(default_factory=lambda: np.ones(2))
    knots: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    turn: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    levels: dict = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def r(self) -> int:
        return len(self.omega)

    def __call__(self, where) -> np.ndarray:
        """Columns at coordinates (n by 2), or at region names."""
        if self.kind == "mrf":
            unknown = {str(v) for v in where if v not in self.levels}
            if unknown:
                raise ValueError(f"regions not seen in fitting: {sorted(unknown)[:5]}")
            return self.table[[self.levels[v] for v in where]]
        s = (np.asarray(where, float) - self.shift) / self.spread
        d = np.sqrt(((s[:, None, :] - self.knots[None]) ** 2).sum(2))
        eta = _thin_plate(d) if self.kind == "tp" else _matern(d)
        return np.hstack([eta @ self.turn, s]) - self.centre


def point_basis(locations: np.ndarray, kind: str = "tp", k: int = 20, knots: int = KNOTS, scale: bool = True) -> Basis:
    """Basis of k - 1 columns on distinct locations: a truncated kernel part, penalised, and the plane, not penalised. scale standardises the coordinates."""
    if kind not in ("tp", "gp"):
        raise ValueError("kind must be tp, gp or mrf")
    if locations.ndim != 2 or locations.shape[1] != 2:
        raise ValueError("coordinates need two columns")
    loc = np.unique(np.asarray(locations, float), axis=0)
    shift, spread = loc.mean(0), loc.std(0, ddof=1) if len(loc) > 1 else np.ones(2)
    spread = np.where(spread > 0, spread, 1.0)
    if not scale:
        shift, spread = np.zeros(2), np.ones(2)
    k = min(k, len(loc) - 1)
    if k < 4:
        raise ValueError("a point basis needs at least five distinct locations")
    pick = loc if len(loc) <= knots else loc[np.linspace(0, len(loc) - 1, knots).astype(int)]
    s = (pick - shift) / spread
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(2))
    e = _thin_plate(d) if kind == "tp" else _matern(d)
    value, vector = np.linalg.eigh(e)
    top = np.argsort(-np.abs(value), kind="stable")[:k]
    u, dk = vector[:, top], value[top]
    plane = np.hstack([np.ones((len(s), 1)), s])
    q, _ = np.linalg.qr(u.T @ plane, mode="complete")
    free = q[:, 3:]  # keeps the kernel part orthogonal to the plane
    turn = u @ free
    penalty = free.T @ (dk[:, None] * free)
    omega = np.zeros((k - 1, k - 1))
    omega[: k - 3, : k - 3] = (penalty + penalty.T) / 2
    low = np.linalg.eigvalsh(omega[: k - 3, : k - 3]) if k > 3 else np.zeros(0)
    if len(low) and low[-1] < -low[0]:
        omega = -omega
    norm = max(np.abs(omega).max(), 1e-12)
    out = Basis(kind, omega / norm, np.zeros(k - 1), shift, spread, s, turn)
    out.centre = out(loc if len(loc) <= 20_000 else pick).mean(0)
    return out


def region_basis(levels: list[str], edges: list[tuple[str, str]], k: int = 20) -> Basis:
    """Markov random field: the k smoothest eigenvectors of the graph Laplacian, without the constant."""
    at = {v: i for i, v in enumerate(levels)}
    lap = np.zeros((len(levels), len(levels)))
    for a, b in edges:
        if a not in at or b not in at:
            raise ValueError("an edge names an unknown region")
        if a != b:
            i, j = at[a], at[b]
            lap[i, j] = lap[j, i] = -1.0
    lap -= np.diag(lap.sum(1))
    value, vector = np.linalg.eigh(lap)
    k = min(k, len(levels))
    v = vector[:, :k]
    # columns orthogonal to the constant
    q, _ = np.linalg.qr(v.T @ np.ones((len(levels), 1)), mode="complete")
    free = q[:, 1:]
    table = v @ free
    omega = free.T @ (value[:k, None] * free)
    return Basis("mrf", (omega + omega.T) / 2, np.zeros(table.shape[1]), levels=at, table=table)


def smooth_by_sums(n: float, aa: np.ndarray, ax: np.ndarray, xx: float, omega: np.ndarray) -> np.ndarray | None:
    """Coefficients (constant first) of the penalised regression of x on a basis, the penalty chosen by restricted likelihood.

    Takes cross products over n rows: of the constant and basis columns (aa), with x (ax), and of x (xx). A constant x has none (None).
    """
    if xx - ax[0] ** 2 / aa[0, 0] <= 1e-12 * max(xx, 1e-12):
        return None
    s = np.zeros_like(aa)
    s[1:, 1:] = omega
    value = np.linalg.eigvalsh(omega)
    rank = int((value > 1e-9 * max(value.max(), 1e-300)).sum())
    logdet_s = np.log(value[value > 1e-9 * max(value.max(), 1e-300)]).sum() if rank else 0.0
    null = len(aa) - rank
    best = None
    for log_l in np.linspace(-12, 16, 57):
        lam = np.exp(log_l)
        h = aa + lam * s + 1e-10 * np.eye(len(aa))
        try:
            chol = np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            continue
        beta = np.linalg.solve(h, ax)
        fit = xx - 2 * beta @ ax + beta @ aa @ beta + lam * beta @ s @ beta
        crit = (n - null) * np.log(max(fit, 1e-300)) + 2 * np.log(np.diag(chol)).sum() - rank * log_l - logdet_s
        if best is None or crit < best[0]:
            best = (crit, beta)
    return best[1] if best else None
