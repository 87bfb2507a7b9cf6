"""Nearest neighbours by cells of equal count.

The plane is cut into vertical strips at quantiles of x, each strip at quantiles of its y, so cells hold about the same
number of points however these cluster. A cell's own points bound every point's distance to its k-th neighbour; the point
then meets the cells that its circle touches, and no others. Both passes deal whole cells to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquant.session import stored

#: Points aimed at in one cell, and the cuts of a strip at most.
CELL_POINTS = 64
MOST_CUTS = 10_000
#: Values of one block of distances.
BLOCK = 1 << 22


class Cells:
    """Strips by x, rows by y inside each strip; every cell has a number. Bounds are closed above."""

    def __init__(self, x_cuts: np.ndarray, y_cuts: list[np.ndarray], box: tuple[float, float, float, float]):
        self.x_cuts, self.y_cuts, self.box = x_cuts, y_cuts, box
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in y_cuts])])

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.x_cuts, x)
        out = self.first[strip].copy()
        for s in np.unique(strip).tolist():
            own = strip == s
            out[own] += np.searchsorted(self.y_cuts[s], y[own])
        return out

    def touched(self, x: float, y: float, r: float) -> Iterator[np.ndarray]:
        """Cells that meet the circle's bounding box."""
        for s in range(int(np.searchsorted(self.x_cuts, x - r)), int(np.searchsorted(self.x_cuts, x + r)) + 1):
            low, high = np.searchsorted(self.y_cuts[s], [y - r, y + r])
            yield self.first[s] + np.arange(low, high + 1)


def equal_cells(points: DataFrame, per_cell: int) -> Cells:
    """Cells of about per_cell points (x, y); strips and cuts are quantiles, of which the driver holds one a cell."""
    box = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    strips = max(1, round((box["n"] / per_cell) ** 0.5))
    probs = [i / strips for i in range(1, strips)]
    x_cuts = np.unique(points.agg(F.percentile_approx("x", F.lit(probs), F.lit(MOST_CUTS)).alias("c")).first()["c"]) if probs else np.zeros(0)
    number = _strip_number(points, x_cuts)
    counts = {r["strip"]: r["count"] for r in number.groupBy("strip").count().collect()}
    parts = min(MOST_CUTS, max(1, -(-max(counts.values()) // per_cell)))
    y_cuts = [np.zeros(0)] * (len(x_cuts) + 1)
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        for r in number.groupBy("strip").agg(F.percentile_approx("y", F.lit(shares), F.lit(MOST_CUTS)).alias("c")).toLocalIterator():
            every = max(1, round(parts * per_cell / counts[r["strip"]]))
            y_cuts[r["strip"]] = np.unique(r["c"][every - 1 :: every])
    return Cells(x_cuts, y_cuts, (box["x0"], box["x1"], box["y0"], box["y1"]))


def _strip_number(points: DataFrame, x_cuts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(x_cuts, b.column(0).to_numpy()).astype(np.int32)), b.column(1)], ["strip", "y"])

    return points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(run, "strip int, y double")


def _least(d2: np.ndarray, unit: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k least distances, ties to the lower unit; all of them where there are fewer."""
    if d2.shape[1] <= k:
        return np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    far = np.partition(d2, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(d2), k), np.int64)
    for i, limit in enumerate(far):
        at = np.flatnonzero(d2[i] <= limit)
        out[i] = at[np.lexsort((unit[at], d2[i, at]))[:k]]
    return out


def nearest(units: DataFrame, k: int, per_cell: int | None = None) -> DataFrame:
    """(i, j, d2, rank): the k nearest other units of every unit (unit, x, y), ties to the lower number; fewer where there are no more. Units have distinct places."""
    points = units.select(F.col("unit").cast("long").alias("unit"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = points.count()
    k = min(k, n - 1)
    if k < 1:
        return points.select(F.col("unit").alias("i"), F.col("unit").alias("j"), F.col("x").alias("d2"), F.lit(1).alias("rank")).limit(0)
    cells = equal_cells(points, per_cell or max(CELL_POINTS, 4 * k))
    shared = units.sparkSession.sparkContext.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.of(b.column(1).to_numpy(), b.column(2).to_numpy()))], ["unit", "x", "y", "cell"])

    placed = stored(points.mapInArrow(place, "unit long, x double, y double, cell long"), "placed")

    def bound(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        x0, x1, y0, y1 = shared.value.box
        r = np.full(len(x), 2 * max(x1 - x0, y1 - y0, 1e-300))  # the whole box, where the cell has too few points
        step = max(1, BLOCK // len(x))
        if len(x) > k:
            for a in range(0, len(x), step):
                d2 = (x[a : a + step, None] - x) ** 2 + (y[a : a + step, None] - y) ** 2
                r[a : a + step] = np.sqrt(np.partition(d2, k, axis=1)[:, k])  # the point itself is among them
        return table.append_column("r", pa.array(r * (1 + 1e-12)))

    circles = placed.groupBy("cell").applyInArrow(bound, "unit long, x double, y double, cell long, r double")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, cell = [], []
            for i, (x, y, r) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 4)))):
                for found in shared.value.touched(x, y, r):
                    own.append(np.full(len(found), i))
                    cell.append(found)
                if len(own) > 50_000:
                    at = pa.array(np.concatenate(own))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (0, 1, 2, 4)), pa.array(np.concatenate(cell))], ["unit", "x", "y", "r", "cell"])
                    own, cell = [], []
            if own:
                at = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (0, 1, 2, 4)), pa.array(np.concatenate(cell))], ["unit", "x", "y", "r", "cell"])

    asked = circles.mapInArrow(spread, "unit long, x double, y double, r double, cell long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, qx, qy, qr = (left.column(c).to_numpy() for c in ("unit", "x", "y", "r"))
        pj, px, py = (right.column(c).to_numpy() for c in ("unit", "x", "y"))
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, BLOCK // max(len(pj), 1))
        for a in range(0, len(qi) if len(pj) else 0, step):
            d2 = (qx[a : a + step, None] - px) ** 2 + (qy[a : a + step, None] - py) ** 2
            d2[qi[a : a + step, None] == pj] = np.inf
            best = _least(d2, pj, k)
            own = np.repeat(np.arange(len(d2)), best.shape[1])
            best = best.ravel()
            near = d2[own, best] <= qr[a + own] ** 2
            out.append((qi[a + own[near]], pj[best[near]], d2[own[near], best[near]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"i": pa.array(cols[0], pa.int64()), "j": pa.array(cols[1], pa.int64()), "d2": pa.array(cols[2], pa.float64())})

    pairs = asked.groupBy("cell").cogroup(placed.groupBy("cell")).applyInArrow(meet, "i long, j long, d2 double")

    least = F.slice(F.array_sort(F.collect_list(F.struct("d2", "j"))), 1, k)  # at most k from each touched cell
    ranked = pairs.groupBy("i").agg(least.alias("near")).select("i", F.posexplode("near").alias("p", "v"))
    return ranked.select("i", F.col("v.j").alias("j"), F.col("v.d2").alias("d2"), (F.col("p") + 1).cast("int").alias("rank"))
