"""Spatial weights graphs as edge tables (i, j, w).

Proximity joins are equi-joins on grid cells, never all pairs: points are put in square cells and meet only the
points of neighbouring cells.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquant.functions.scalar import distance
from terraquant.operators.components import connected_components
from terraquant.operators.neighbours import nearest as by_cells
from terraquant.operators.rows import numbered
from terraquant.session import stored


def spatial_units(df: DataFrame, x: str, y: str, row: str) -> DataFrame:
    """(unit, x, y): distinct locations, numbered from 1 by first occurrence in the order of row."""
    first = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(row).alias("_first"))
    return numbered(first, "unit", "_first", "x", "y").select("unit", "x", "y")


def with_unit(df: DataFrame, units: DataFrame, x: str, y: str) -> DataFrame:
    u = units.select("unit", F.col("x").alias("_ux"), F.col("y").alias("_uy"))
    return df.join(u, (F.col(x) == F.col("_ux")) & (F.col(y) == F.col("_uy")), "left").drop("_ux", "_uy")


def region_units(df: DataFrame, units: DataFrame, region: str) -> DataFrame:
    """df with the unit of its region; raises if a region has none."""
    out = df.join(units, df[region] == units["unit_id"], "left").drop("unit_id")
    if out.where(F.col("unit").isNull()).limit(1).count():
        raise ValueError("a region is not among the units")
    return out


def _cells(units: DataFrame, size: float) -> DataFrame:
    return units.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def _near(units: DataFrame, size: float, reach: int = 1) -> DataFrame:
    """(i, j, d2): ordered pairs of units whose cells are at most reach apart."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    left = _cells(units, size).select(F.col("unit").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), "cx", "cy")
    left = left.withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span)).withColumn("cx", F.col("cx") + F.col("ox")).withColumn("cy", F.col("cy") + F.col("oy")).drop("ox", "oy")
    right = _cells(units, size).select(F.col("unit").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy")
    d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
    return left.join(right, ["cx", "cy"]).where("i <> j").select("i", "j", d2.alias("d2"))


def distance_band(units: DataFrame, upper: float, lower: float = 0.0) -> DataFrame:
    """Edges of weight 1 between units at distance lower to upper."""
    if upper is None or upper <= 0:
        raise ValueError("an upper distance is needed")
    d = F.sqrt("d2")
    return _near(units, upper).where((d >= lower) & (d <= upper)).select("i", "j", F.lit(1.0).alias("w"))


def nearest(units: DataFrame, k: int, order: str | None = None) -> DataFrame:
    """(i, j, d2, rank): the k nearest other units, ties to the lower number; with order, only among units of lower order.

    Cells are sized for about 2k units; units whose k-th neighbour may lie outside the searched ring are searched
    again in rings twice as wide, until all are settled.
    """
    box = units.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    n = box["n"]
    if not n:
        return _near(units, 1.0).withColumn("rank", F.lit(1)).limit(0)
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-12)
    size = max(extent * (2 * k / n) ** 0.5 / 2, extent * 1e-6)
    todo, done = units, None
    want = min(k, n - 1)
    while True:
        whole = size >= extent
        span = F.sequence(F.lit(-1), F.lit(1))
        left = _cells(todo, size).select(F.col("unit").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), *([F.col(order).alias("oi")] if order else []), "cx", "cy")
        left = left.withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span)).withColumn("cx", F.col("cx") + F.col("ox")).withColumn("cy", F.col("cy") + F.col("oy")).drop("ox", "oy")
        right = _cells(units, size).select(F.col("unit").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), *([F.col(order).alias("oj")] if order else []), "cx", "cy")
        d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
        pairs = left.join(right, ["cx", "cy"]).where("i <> j")
        pairs = pairs.where("oj < oi") if order else pairs
        w = Window.partitionBy("i").orderBy("d2", "j")
        ranked = pairs.select("i", "j", d2.alias("d2"), *(["oi"] if order else [])).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        need = F.least(F.lit(want), F.col("oi") - 1) if order else F.lit(want)
        # everything within one cell's width has been seen
        settled = ranked.groupBy("i").agg(F.count("*").alias("c"), F.max("d2").alias("far"), *([F.first("oi").alias("oi")] if order else [])).where((F.col("c") >= need) & (F.col("far") <= size * size))
        ranked = stored(ranked.drop("oi"), "near")
        if whole:
            return ranked if done is None else done.unionByName(ranked)
        settled = stored(settled.select("i"), "settled")
        part = ranked.join(settled, "i", "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = stored(todo.join(settled.withColumnRenamed("i", "unit"), "unit", "left_anti"), "todo")
        if not todo.limit(1).count():
            return done
        size *= 2


def knn_graph(units: DataFrame, k: int = 5) -> DataFrame:
    """Symmetrised k-nearest-neighbour edges of weight 1."""
    directed = by_cells(units, k).select("i", "j")
    return symmetrize_union(directed).withColumn("w", F.lit(1.0))


def symmetrize_union(directed: DataFrame) -> DataFrame:
    return directed.select("i", "j").union(directed.select("j", "i")).distinct()


def lattice_rook(units: DataFrame) -> DataFrame:
    """Edges between units whose integer coordinates differ by one in one direction: four shifted equi-joins."""
    left = units.select(F.col("unit").alias("i"), "x", "y").withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))))
    left = left.select("i", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"))
    return left.join(units.select(F.col("unit").alias("j"), "x", "y"), ["x", "y"]).select("i", "j", F.lit(1.0).alias("w"))


def contiguity(polygons: DataFrame, kind: str = "queen") -> DataFrame:
    """Edges of polygons (unit, ring array<struct<x,y>>, closed) that share a vertex (queen) or an edge (rook)."""
    if kind == "queen":
        parts = polygons.select("unit", F.explode("ring").alias("p")).distinct()
    elif kind == "rook":
        steps = polygons.select("unit", F.explode(F.arrays_zip(F.expr("slice(ring, 1, size(ring) - 1)").alias("a"), F.expr("slice(ring, 2, size(ring) - 1)").alias("b"))).alias("e"))
        parts = steps.select("unit", F.struct(F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi")).alias("p")).distinct()
    else:
        raise ValueError("kind must be queen or rook")
    a, b = parts.select(F.col("unit").alias("i"), "p"), parts.select(F.col("unit").alias("j"), "p")
    return a.join(b, "p").where("i <> j").select("i", "j").distinct().withColumn("w", F.lit(1.0))


def supplied(edges: DataFrame) -> DataFrame:
    """Symmetric weights of an edge table: the mean of each weight and its transpose. Raises on negative weights; zeros go."""
    if edges.where("w < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    half = edges.select("i", "j", (F.col("w") / 2).alias("w"))
    both = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.sum("w").alias("w")).where("w > 0")


def row_standardized(edges: DataFrame) -> DataFrame:
    """Weights over their row's sum, then averaged with the transpose."""
    total = degree(edges)
    return supplied(edges.join(total, "i").select("i", "j", (F.col("w") / F.col("d")).alias("w")))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("d"))


def laplacian(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(i, j, v) of D - W, with a diagonal entry for every unit; loops cancel."""
    d = units.select(F.col("unit").alias("i")).join(degree(edges), "i", "left").select("i", F.col("i").alias("j"), F.coalesce("d", F.lit(0.0)).alias("v"))
    return d.unionByName(edges.select("i", "j", (-F.col("w")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def car_precision(edges: DataFrame, units: DataFrame, alpha: float = 0.95, kind: str = "proper", eps: float = 1e-6) -> DataFrame:
    """Leroux precision alpha (D - W) + (1 - alpha) I, or intrinsic D - W + eps I."""
    scale, ridge = (alpha, 1 - alpha) if kind == "proper" else (1.0, eps)
    v = F.col("v") * scale + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)
    return laplacian(edges, units).select("i", "j", v.alias("v"))


def unit_components(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, component): components numbered from 1 by their lowest unit; loops and zero weights tie nothing."""
    linked = connected_components(edges.where("i <> j AND w <> 0"), "i", "j")
    lowest = units.select("unit").join(linked, F.col("unit") == F.col("id"), "left").select("unit", F.coalesce("component", "unit").alias("low"))
    names = numbered(lowest.select("low").distinct(), "component", "low")
    return lowest.join(names, "low").select("unit", "component")


def islands(edges: DataFrame, units: DataFrame) -> DataFrame:
    return units.join(degree(edges).where("d > 0").select(F.col("i").alias("unit")), "unit", "left_anti").select("unit")


def sparse_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, v) of the product of two matrices given as (i, j, v)."""
    r = right.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return left.join(r, left["j"] == r["_k"]).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_v")).alias("v"))


def sparse_vector(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, v) of the product of (i, j, w) and (unit, z)."""
    return matrix.join(vector, matrix["j"] == vector["unit"]).groupBy("i").agg(F.sum(F.col("w") * F.col("z")).alias("v"))


def exact_else_nearest(points: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """points (key, x, y) with the unit at the same place, else the nearest one, ties to the lower number.

    Distinct missing places are searched in cells that widen until one unit is certain to be the nearest.
    """
    hit = points.join(units.select("unit", "x", "y"), ["x", "y"], "left")
    places = hit.where("unit IS NULL AND x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    box = units.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return hit.select(key, "x", "y", "unit")
    extent = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-12)
    # places outside the box are moved to its edge for the search of cells only: the nearest unit lies that way
    px, py = F.greatest(F.lit(box["x0"]), F.least(F.lit(box["x1"]), F.col("x"))), F.greatest(F.lit(box["y0"]), F.least(F.lit(box["y1"]), F.col("y")))
    todo, found = places, None
    size = extent / max(1.0, (box["n"] / 2) ** 0.5)
    span = F.sequence(F.lit(-1), F.lit(1))
    while True:
        left = todo.withColumn("cx", F.floor(px / size)).withColumn("cy", F.floor(py / size)).withColumn("ox", F.explode(span)).withColumn("oy", F.explode(span))
        left = left.select("x", "y", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
        right = _cells(units, size).select("unit", F.col("x").alias("ux"), F.col("y").alias("uy"), "cx", "cy")
        best = left.join(right, ["cx", "cy"]).groupBy("x", "y").agg(F.min(F.struct(distance(F.col("x"), F.col("y"), F.col("ux"), F.col("uy")).alias("d"), "unit")).alias("b"))
        off = F.sqrt(F.pow(F.col("x") - px, 2) + F.pow(F.col("y") - py, 2))
        sure = stored(best.where(F.lit(size >= extent) | ((F.col("b.d") <= size) & (off == 0)) | (F.col("b.d") <= F.sqrt(off * off + size * size))).select("x", "y", F.col("b.unit").alias("near")), "near")
        found = sure if found is None else found.unionByName(sure)
        if size >= extent:
            break
        todo = stored(todo.join(sure, ["x", "y"], "left_anti"), "todo")
        if not todo.limit(1).count():
            break
        size *= 2
    return hit.join(found, ["x", "y"], "left").select(key, "x", "y", F.coalesce("unit", "near").alias("unit"))


def moran(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (statistic, n_units, s0): Moran's I of (unit, z). Units with null or NaN values go first, with their edges."""
    ok = values.where(F.col("z").isNotNull() & ~F.isnan("z"))
    mean = ok.agg(F.avg("z").alias("m"), F.count("*").alias("n"))
    centred = ok.crossJoin(F.broadcast(mean)).select("unit", (F.col("z") - F.col("m")).alias("z"), "n")  # one row
    own = centred.select(F.col("unit").alias("i"), F.col("z").alias("zi"))
    other = centred.select(F.col("unit").alias("j"), F.col("z").alias("zj"))
    cross = edges.join(own, "i").join(other, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("zwz"), F.sum("w").alias("s0"))
    square = centred.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.max("n").alias("n"))
    both = cross.crossJoin(square)  # one row each
    fine = (F.col("n") >= 3) & (F.col("s0") > 0) & (F.col("zz") > 0)
    return both.select(F.when(fine, F.col("n") / F.col("s0") * F.col("zwz") / F.col("zz")).alias("statistic"), F.coalesce("n", F.lit(0)).alias("n_units"), "s0")


def unit_residual(df: DataFrame, residuals: list[str], probs: list[str], units: DataFrame) -> DataFrame:
    """(unit, z): posterior-weighted mean residual of each unit; null where a unit has no rows."""
    e: Column = F.lit(0.0)
    for r, p in zip(residuals, probs):
        e = e + F.col(p) * F.col(r)
    got = df.groupBy("unit").agg((F.sum(e) / F.count("*")).alias("z"))
    return units.select("unit").join(got, "unit", "left")


@dataclass(frozen=True)
class Weights:
    """A symmetric weights graph over units: edges (i, j, w), and for a nearest-neighbour process its precision (i, j, v)."""

    kind: str
    style: str
    units: DataFrame
    edges: DataFrame
    precision: DataFrame | None = None

    def degrees(self) -> DataFrame:
        """(unit, d), 0 for islands."""
        d = degree(self.edges).withColumnRenamed("i", "unit")
        return self.units.select("unit").join(d, "unit", "left").select("unit", F.coalesce("d", F.lit(0.0)).alias("d"))

    def components(self) -> DataFrame:
        return unit_components(self.edges, self.units)

    def summary(self) -> DataFrame:
        """One row (n_units, n_links, n_components, n_islands)."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        parts = self.components().agg(F.countDistinct("component").alias("n_components"))
        rows = count(self.units, "n_units").crossJoin(count(self.edges, "n_links"))  # one row each
        return rows.crossJoin(parts).crossJoin(count(islands(self.edges, self.units), "n_islands"))


def weights(source: DataFrame, kind: str, units: DataFrame | None = None, lower: float = 0.0, upper: float | None = None, k: int = 5, style: str = "B", m: int = 10, reach: float | None = None, nu: float = 0.5) -> Weights:
    """The front door to weights graphs.

    kind queen or rook takes polygons (unit, ring); distance, knn, lattice and nngp take units (unit, x, y); supplied takes edges
    (i, j, w) with their units. style B keeps the weights; W standardises rows, warns, and averages with the transpose.
    A supplied graph that is not symmetric is averaged with a warning; negative weights and edges of unknown units raise.
    """
    if kind not in ("queen", "rook", "distance", "knn", "lattice", "supplied", "nngp"):
        raise ValueError("unknown kind of weights")
    if style not in ("B", "W"):
        raise ValueError("style must be B or W")
    precision = None
    if kind in ("queen", "rook"):
        edges, units = contiguity(source, kind), source.select("unit").distinct()
    elif kind == "supplied":
        if units is None:
            units = source.select(F.col("i").alias("unit")).union(source.select("j")).distinct()
        known = units.select("unit")
        if source.join(known, source["i"] == known["unit"], "left_anti").limit(1).count() or source.join(known, source["j"] == known["unit"], "left_anti").limit(1).count():
            raise ValueError("an edge names an unknown unit")
        turned = source.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("w")).alias("w"))
        if source.select("i", "j", "w").unionByName(turned).groupBy("i", "j").agg(F.sum("w").alias("w")).where("abs(w) > 1e-12").limit(1).count():
            warnings.warn("the supplied weights are not symmetric; they are averaged with their transpose", stacklevel=2)
        edges = supplied(source)
    else:
        units = source.select("unit", "x", "y")
        if kind == "distance":
            edges = distance_band(units, upper, lower)
        elif kind == "knn":
            edges = knn_graph(units, k)
        elif kind == "lattice":
            edges = lattice_rook(units)
        else:
            from terraquant.operators import nngp

            placed = nngp.ordered_units(units)
            links = stored(nngp.earlier_neighbours(placed, m), "neighbours")
            precision = nngp.assemble_precision(nngp.conditional_weights(placed, links, reach or nngp.default_range(units), nu))
            edges = symmetrize_union(links).withColumn("w", F.lit(1.0))
    if style == "W":
        warnings.warn("row-standardised weights are not symmetric; they are averaged with their transpose", stacklevel=2)
        edges = row_standardized(edges)
    return Weights(kind, style, units, edges, precision)
