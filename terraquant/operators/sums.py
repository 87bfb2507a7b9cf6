"""Sums over rows, for estimators that only need sums.

An estimator's step is a function of a chunk of rows that returns arrays; Rows.reduce adds them up over all
chunks. LocalRows holds one chunk on the driver (small data, one task of a parallel search); SparkRows keeps the
rows on the executors: each partition returns its partial sums, which are added in two levels before the
driver sees them. Both run the same functions, so small and large data take the same steps. What adds up need not be
numbers: ranges, least rows and lists of parts have an addition too.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows up to which a table is fitted on the driver.
LOCAL_ROWS = 200_000
#: Second-level groups of partial sums.
GROUPS = 16


@dataclass
class Chunk:
    """Rows as arrays: response, component design, gate design, weights, unit (-1: none), start probabilities; coordinates and a hash of the row where there are any."""

    y: np.ndarray
    x: np.ndarray
    z: np.ndarray
    w: np.ndarray
    unit: np.ndarray
    p: np.ndarray
    place: np.ndarray | None = None
    key: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.y)

    def take(self, rows: np.ndarray) -> Chunk:
        return Chunk(*(None if v is None else v[rows] for v in (getattr(self, f.name) for f in fields(self))))


class LocalRows:
    def __init__(self, chunk: Chunk):
        self.chunk = chunk

    def reduce(self, f: Callable, *args):
        return f(self.chunk, *args)

    def gather(self, f: Callable, *args) -> np.ndarray:
        """f's rows of all chunks."""
        return f(self.chunk, *args)

    def quantiles(self, probs: list[float], f: Callable, *args) -> np.ndarray:
        """Quantiles (interpolated between order statistics) of f's values."""
        return np.quantile(f(self.chunk, *args), probs)

    def median(self, f: Callable, *args) -> float:
        return float(self.quantiles([0.5], f, *args)[0])

    def mapped(self, change: Callable[[Chunk], Chunk]) -> LocalRows:
        return LocalRows(change(self.chunk))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class SparkRows:
    """Rows of a DataFrame (y, x, z, w, unit, p and perhaps place, key), x, z, p and place being arrays of doubles of fixed length.

    change, where given, is applied to every chunk first; chunks that it empties are passed over.
    """

    def __init__(self, df: DataFrame, change: Callable[[Chunk], Chunk] | None = None):
        self.df = df.select("y", "x", "z", "w", "unit", "p", *(c for c in ("place", "key") if c in df.columns))
        self.change = change

    def mapped(self, change: Callable[[Chunk], Chunk]) -> SparkRows:
        before = self.change
        return SparkRows(self.df, change if before is None else lambda c: change(before(c)))

    def reduce(self, f: Callable, *args):
        names, change = self.df.columns, self.change

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                n = b.num_rows
                if not n:
                    continue
                of = dict(zip(names, b.columns))
                chunk = Chunk(of["y"].to_numpy(), *(_matrix(of[k], n) for k in "xz"), of["w"].to_numpy(), of["unit"].to_numpy(), _matrix(of["p"], n))
                if "place" in of:
                    chunk.place = _matrix(of["place"], n)
                if "key" in of:
                    chunk.key = of["key"].to_numpy().view(np.uint64)
                if change is not None:
                    chunk = change(chunk)
                if len(chunk):
                    got = f(chunk, *args)
                    total = got if total is None else tuple(a + c for a, c in zip(total, got))
            if total is not None:
                from pyspark import TaskContext

                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["g", "sums"])

        def merge(table: pa.Table) -> pa.Table:
            total = None
            for s in table.column("sums").to_pylist():
                got = pickle.loads(s)
                total = got if total is None else tuple(a + c for a, c in zip(total, got))
            return pa.table({"sums": pa.array([pickle.dumps(total)], pa.binary())})

        rows = self.df.mapInArrow(partial, "g int, sums binary").groupBy("g").applyInArrow(merge, "sums binary").collect()
        parts = [pickle.loads(r["sums"]) for r in rows]
        if not parts:
            raise ValueError("no rows")
        total = parts[0]
        for p in parts[1:]:
            total = tuple(a + c for a, c in zip(total, p))
        return total

    def gather(self, f: Callable, *args) -> np.ndarray:
        """f's rows of all chunks, in no given order; for results that the caller knows to be small, or wants whole."""
        return np.concatenate(self.reduce(lambda c: (Parts([f(c, *args)]),))[0].parts)

    def quantiles(self, probs: list[float], f: Callable, *args) -> np.ndarray:
        """Quantiles of f's values, between exact order statistics: counts below grid points close in on each."""

        def ends(c):
            v = f(c, *args)
            return Extreme(v.min(), v.max()), len(v)

        span, n = self.reduce(ends)
        at = np.array(probs) * (n - 1)
        ranks = np.concatenate([np.floor(at), np.ceil(at)]) + 1
        lo, hi = np.full(len(ranks), span.lo), np.full(len(ranks), span.hi)
        for _ in range(ROUNDS):
            grids = [np.linspace(a, b, GRID) for a, b in zip(lo, hi)]

            def counts(c, grids=grids):
                v = np.sort(f(c, *args))
                return (np.stack([np.searchsorted(v, g, side="right") for g in grids]),)

            below = self.reduce(counts)[0]
            for i, (grid, k) in enumerate(zip(grids, (below < ranks[:, None]).sum(1))):
                lo[i], hi[i] = grid[max(k - 1, 0)], grid[min(k, GRID - 1)]

        def largest(c):
            v = f(c, *args)
            return (Largest(np.array([v[v <= b].max(initial=-np.inf) for b in hi])),)

        value = self.reduce(largest)[0].value
        low, high = value[: len(at)], value[len(at) :]
        return low + (at - np.floor(at)) * (high - low)

    def median(self, f: Callable, *args) -> float:
        return float(self.quantiles([0.5], f, *args)[0])


#: Grid points of a pass of SparkRows.quantiles, and passes.
GRID, ROUNDS = 4097, 3


class Extreme:
    """Adds as the union of ranges."""

    def __init__(self, lo: float, hi: float):
        self.lo, self.hi = lo, hi

    def __add__(self, other: Extreme) -> Extreme:
        return Extreme(min(self.lo, other.lo), max(self.hi, other.hi))


class Largest:
    """Adds as the larger values."""

    def __init__(self, value: np.ndarray):
        self.value = value

    def __add__(self, other: Largest) -> Largest:
        return Largest(np.maximum(self.value, other.value))


class Parts:
    """Adds as one list."""

    def __init__(self, parts: list):
        self.parts = parts

    def __add__(self, other: Parts) -> Parts:
        return Parts(self.parts + other.parts)


class Least:
    """The k rows with the least distinct keys; adds as those of both."""

    def __init__(self, key: np.ndarray, rows: np.ndarray, k: int):
        key, first = np.unique(key, return_index=True)
        self.key, self.rows, self.k = key[:k], rows[first[:k]], k

    def __add__(self, other: Least) -> Least:
        return Least(np.concatenate([self.key, other.key]), np.concatenate([self.rows, other.rows]), self.k)


class Few:
    """Distinct rows, up to a limit; adds as their union."""

    def __init__(self, rows: set, limit: int):
        self.rows, self.limit = set(sorted(rows)[:limit]), limit

    def __add__(self, other: Few) -> Few:
        return Few(self.rows | other.rows, self.limit)


def row_keys(c: Chunk, seed: int) -> np.ndarray:
    """A 64-bit hash of each row's content."""
    parts = [c.y[:, None], c.x, c.z, *([c.place] if c.place is not None else [])]
    bits = np.ascontiguousarray(np.hstack(parts), dtype=np.float64).view(np.uint64)
    odd = np.random.default_rng(seed).integers(0, 1 << 63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        return mixed((mixed(bits) * odd).sum(1, dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def uniforms(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys, another set for each stream."""
    with np.errstate(over="ignore"):
        h = mixed(key + np.uint64((0x9E3779B97F4A7C15 * (stream + 1)) & ((1 << 64) - 1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


# Normal distribution on arrays, by the constants of the column functions.
def erfc(x: np.ndarray) -> np.ndarray:
    from terraquant.functions import scalar as s

    y = np.abs(x)
    with np.errstate(all="ignore"):
        near = 1 - x * s.rational(x * x, s.ERF_P, s.ERF_Q)
        tail = 1 / np.maximum(y * y, 1e-300)
        far = np.exp(-y * y) / np.maximum(y, 1e-300) * (1 / math.sqrt(math.pi) - tail * s.rational(tail, s.TAIL_P, s.TAIL_Q))
        upper = np.where(y <= s.MIDDLE, np.exp(-y * y) * s.rational(y, s.ERFC_P, s.ERFC_Q), far)
    return np.where(y <= s.NEAR, near, np.where(x < 0, 2 - upper, upper))


def cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-x / math.sqrt(2))


def pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
