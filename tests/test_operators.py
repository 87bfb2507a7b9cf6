from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.operators import graph as G
from terraquant.operators import nngp
from terraquant.operators import rows as R
from terraquant.operators.basis import point_basis, region_basis
from terraquant.operators.components import connected_components
from terraquant.operators.moran import permutation_test

ROOT = Path(__file__).resolve().parent.parent


def edges(spark, pairs, w=1.0):
    return spark.createDataFrame([(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs], "i long, j long, w double")


def units(spark, n):
    return spark.range(1, n + 1).withColumnRenamed("id", "unit")


def dense(df, n, v="v"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["i"] - 1, r["j"] - 1] += r[v]
    return out


def test_complete_cases_drop_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (float("nan"), "b"), (2.0, None)], "x double, r string")
    assert R.complete_cases(df, ["x", "r"]).count() == 1
    assert R.complete_cases(df, []).count() == 4


def test_weights_have_mean_one_and_are_validated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "k double")
    assert R.normalize_weights(df, "k").agg(F.avg("w")).first()[0] == pytest.approx(1.0)
    for bad in ([1.0, -1.0], [0.0, 0.0], [1.0, None], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            R.normalize_weights(spark.createDataFrame([(v,) for v in bad], "k double"), "k")


def test_folds_are_even(spark):
    n = [r["count"] for r in R.balanced_folds(spark.range(103), 5, "id").groupBy("fold").count().collect()]
    assert sorted(n) == [20, 20, 21, 21, 21]


def test_quantile_bins_reject_equal_breaks(spark):
    with pytest.raises(ValueError):
        R.quantile_breaks(spark.createDataFrame([(1.0,)] * 5, "x double"), "x", 2)


def test_leroux_of_a_chain_has_the_known_least_eigenvalue(spark):
    q = dense(G.car_precision(edges(spark, [(1, 2), (2, 3), (3, 4)]), units(spark, 4)), 4)
    assert np.linalg.eigvalsh(q)[0] == pytest.approx(0.05, abs=1e-6)


def test_intrinsic_null_space_counts_components(spark):
    e, u = edges(spark, [(1, 2), (3, 4)]), units(spark, 5)
    q = dense(G.car_precision(e, u, kind="icar", eps=0.0), 5)
    assert (np.linalg.eigvalsh(q) < 1e-9).sum() == 3
    comp = {r["unit"]: r["component"] for r in G.unit_components(e, u).collect()}
    assert comp == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert [r[0] for r in G.islands(e, u).collect()] == [5]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(7, 7), (None, 3)] + [(500 + i, 501 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_supplied_weights_are_averaged_and_validated(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0), (2, 3, 2.0)], "i long, j long, w double")
    w = dense(G.supplied(e), 3, "w")
    assert np.allclose(w, w.T) and w[0, 1] == 2 and w[1, 2] == 1
    with pytest.raises(ValueError):
        G.supplied(e.withColumn("w", -F.col("w")))


def test_proximity_graphs_equal_brute_force(spark):
    xy = np.random.default_rng(0).uniform(size=(80, 2))
    df = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "unit long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    near = {(i + 1, int(j) + 1) for i in range(80) for j in [k for k in np.argsort(d[i], kind="stable") if k != i][:4]}
    assert {(r["i"], r["j"]) for r in G.knn_graph(df, 4).collect()} == near | {(b, a) for a, b in near}
    band = {(i + 1, j + 1) for i in range(80) for j in range(80) if i != j and 0.05 <= d[i, j] <= 0.2}
    assert {(r["i"], r["j"]) for r in G.distance_band(df, 0.2, 0.05).collect()} == band
    new = spark.createDataFrame([(0, 0.5, 0.5), (1, -3.0, 8.0), (2, float(xy[9, 0]), float(xy[9, 1])), (3, 40.0, 0.1)], "key long, x double, y double")
    for r in G.exact_else_nearest(new, df, "key").collect():
        assert r["unit"] == int(((xy - [r["x"], r["y"]]) ** 2).sum(1).argmin()) + 1


def test_contiguity_of_a_grid(spark):
    ring = lambda x, y: [(x + a, y + b) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]
    df = spark.createDataFrame([(3 * y + x + 1, ring(x, y)) for x in range(3) for y in range(3)], "unit long, ring array<struct<x:double,y:double>>")
    assert G.contiguity(df, "rook").count() == 24
    assert G.contiguity(df, "queen").count() == 40


def test_nngp_with_all_neighbours_is_the_inverse_covariance(spark):
    xy = np.random.default_rng(1).uniform(size=(12, 2))
    df = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "unit long, x double, y double")
    q = dense(nngp.nngp_precision(df, 11, 0.5, 0.5), 12)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    assert np.abs(q - np.linalg.inv(np.exp(-d / 0.5))).max() < 1e-4
    sparse = nngp.nngp_precision(df, 3, 0.5, 0.5).count()
    assert 12 * 4 - 12 < sparse <= 4 * 12 * 3


def test_maxmin_order_visits_all_from_the_centre():
    xy = np.random.default_rng(2).uniform(size=(50, 2))
    order = nngp.maxmin_order(xy)
    assert sorted(order.tolist()) == list(range(50)) and order[0] == ((xy - xy.mean(0)) ** 2).sum(1).argmin()


def test_the_order_is_maxmin_whatever_the_number_of_units(spark):
    """More than 5,000 units were ordered by a hash; ties, a lattice's among them, go to the first."""

    def plain(xy):
        out = [int(((xy - xy.mean(0)) ** 2).sum(1).argmin())]
        gap = ((xy - xy[out[0]]) ** 2).sum(1)
        while len(out) < len(xy):
            gap[out[-1]] = -1
            out.append(int(gap.argmax()))
            gap = np.minimum(gap, ((xy - xy[out[-1]]) ** 2).sum(1))
        return out

    rng = np.random.default_rng(4)
    for xy in (rng.normal(size=(1, 2)), rng.normal(size=(7, 2)), np.zeros((5, 2)), rng.integers(0, 20, (900, 2)).astype(float), np.exp(3 * rng.normal(size=(900, 2)))):
        assert nngp.maxmin_order(xy).tolist() == plain(xy)
    with pytest.raises(ValueError):
        nngp.maxmin_order(np.array([[0.0, 1.0], [np.nan, 2.0], [3.0, 4.0]]))
    xy = rng.normal(size=(5_100, 2))
    units = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "unit long, x double, y double")
    assert [r["unit"] - 1 for r in nngp.ordered_units(units).orderBy("ord").collect()] == plain(xy)


def test_earlier_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(nngp, "PART_UNITS", 50)
    for xy in (rng.integers(0, 12, (400, 2)).astype(float), np.exp(3 * rng.normal(size=(400, 2))), np.zeros((70, 2)), rng.normal(size=(3, 2)), rng.normal(size=(1, 2))):
        unit, order = rng.permutation(len(xy)) + 5, rng.permutation(len(xy))
        want = set()
        for i in range(len(xy)):
            d2 = ((xy - xy[i]) ** 2).sum(1)
            near = sorted((d2[j], unit[j]) for j in range(len(xy)) if order[j] < order[i])[:4]
            want |= {(int(unit[i]), int(u), float(d), k + 1) for k, (d, u) in enumerate(near)}
        units = spark.createDataFrame([(int(u), float(a), float(b), int(o) + 1) for u, (a, b), o in zip(unit, xy, order)], "unit long, x double, y double, ord int")
        assert {tuple(r) for r in nngp.earlier_neighbours(units, 4).select("i", "j", "d2", "rank").collect()} == want


def test_bases_are_penalised_and_centred():
    xy = np.random.default_rng(3).uniform(size=(60, 2))
    for kind in ("tp", "gp"):
        b = point_basis(xy, kind, 12)
        assert b(xy).shape == (60, 11) and np.abs(b(xy).mean(0)).max() < 1e-8
        value = np.linalg.eigvalsh(b.omega)
        assert value[0] > -1e-6 and (np.abs(value) < 1e-8).sum() >= 2
    assert point_basis(xy[:8], "tp", 20).r == 6
    m = region_basis(list("abcd"), [("a", "b"), ("b", "c"), ("c", "d")], 10)
    assert m.r == 3 and np.abs(m.table.sum(0)).max() < 1e-8
    with pytest.raises(ValueError):
        m(["z"])


def test_moran_detects_a_trend_and_not_noise():
    n = 8
    w = np.zeros((n * n, n * n))
    for i in range(n * n):
        for j in range(n * n):
            w[i, j] = abs(i // n - j // n) + abs(i % n - j % n) == 1
    trend = np.arange(n * n) // n + np.random.default_rng(0).normal(size=n * n) * 0.2
    assert permutation_test(trend, w, 99)[1] <= 0.02
    p = [permutation_test(np.random.default_rng(s).normal(size=n * n), w, 99, s)[1] for s in range(20)]
    assert np.mean(p) > 0.2 and np.mean(np.array(p) < 0.05) < 0.25
    assert permutation_test(np.array([1.0, np.nan, 2.0]), w[:3, :3])[0] is None


def test_nngp_precision_covers_every_embedding(spark):
    from terraquant import queries as Q

    data = "/root/testdata/sf0.001"
    want = {r["unit"] for r in Q.points(spark, data).collect()}
    precision = Q.nngp_precision(spark, data).where("i = j").collect()
    assert {r["i"] for r in precision} == want and all(r["v"] > 0 for r in precision)


def test_stored_tables_are_shared_and_removed(spark, tmp_path):
    """Intermediate tables go below spark.checkpoint.dir into the application's folder, which is gone when its JVM has ended."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from terraquant.session import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
print(stored(spark.range(5)).count(), len(list(__import__("pathlib").Path({str(tmp_path)!r}).glob("terraquant-*/step-*"))))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["5", "1"], out.stderr
    assert not list(tmp_path.glob("terraquant-*"))


@pytest.mark.parametrize("shape", ["even", "clustered", "column", "lattice", "few"])
@pytest.mark.parametrize("per_cell", [None, 8])
def test_nearest_by_equal_cells_equals_brute_force(spark, shape, per_cell):
    """Cells follow the density: one far point, one dense cluster, equal coordinates and ties make no difference."""
    from terraquant.operators.neighbours import nearest

    rng = np.random.default_rng(4)
    xy = {
        "even": rng.uniform(size=(300, 2)),
        "clustered": np.vstack([rng.normal(scale=1e-4, size=(200, 2)), rng.normal(5, 1, size=(80, 2)), [[1e6, -1e6]]]),
        "column": np.column_stack([np.zeros(150), rng.uniform(size=150)]),
        "lattice": np.array([(a, b) for a in range(15) for b in range(12)], float),
        "few": rng.uniform(size=(3, 2)),
    }[shape]
    n = len(xy)
    df = spark.createDataFrame([(i + 1, *map(float, v)) for i, v in enumerate(xy)], "unit long, x double, y double")
    got = {(r["i"], r["rank"]): r["j"] for r in nearest(df, 5, per_cell).collect()}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    want = {(i + 1, r + 1): int(j) + 1 for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), d2[i]))[: min(5, n - 1)])}
    assert got == want
    assert nearest(df.limit(1), 5).count() == 0 and nearest(df.limit(0), 5).count() == 0


def test_rows_are_numbered_in_order(spark):
    rng = np.random.default_rng(6)
    keys = [int(v) for v in rng.permutation(5000)]
    df = spark.createDataFrame([(k // 10, k) for k in keys], "a int, b int").repartition(7)
    got = {r["b"]: r["n"] for r in R.numbered(df, "n", "a", "b").collect()}
    assert got == {k: k + 1 for k in range(5000)}
    assert R.numbered(df.limit(0), "n", "a", "b").count() == 0


def test_weights_front_door(spark):
    grid = spark.createDataFrame([(r * 3 + c + 1, float(c), float(r)) for r in range(3) for c in range(3)], "unit long, x double, y double")
    lattice = G.weights(grid, "lattice")
    assert lattice.summary().first()[:] == (9, 24, 1, 0)
    assert {r["unit"]: r["d"] for r in lattice.degrees().collect()}[5] == 4
    assert G.weights(grid, "distance", upper=1.5).summary().first()[:] == (9, 40, 1, 0)
    assert G.weights(grid, "distance", upper=0.5).summary().first()[:] == (9, 0, 9, 9)
    near = G.weights(grid, "knn", k=2).edges
    assert near.join(near.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"]).count() == near.count()
    process = G.weights(grid, "nngp", m=3)
    assert process.precision.where("i = j").count() == 9 and process.edges.where("w = 1").count() == process.edges.count()
    chain = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 4.0)], "i long, j long, w double")
    with pytest.warns(UserWarning, match="not symmetric"):
        w = G.weights(chain, "supplied")
    assert {(r["i"], r["j"]): r["w"] for r in w.edges.collect()}[3, 2] == 2.0
    with pytest.warns(UserWarning, match="row-standardised"):
        G.weights(grid, "lattice", style="W")
    for bad in ({"kind": "x"}, {"kind": "lattice", "style": "C"}, {"kind": "distance"}):
        with pytest.raises(ValueError):
            G.weights(grid, **bad)
    with pytest.raises(ValueError, match="unknown unit"):
        G.weights(chain, "supplied", units=spark.createDataFrame([(1,), (2,)], "unit long"))
    with pytest.raises(ValueError, match="negative"):
        G.weights(spark.createDataFrame([(1, 2, -1.0), (2, 1, -1.0)], "i long, j long, w double"), "supplied")


def test_multipolygons_are_read(spark, tmp_path):
    import struct

    from terraquant.sources.tables import read_polygons, wkb_rings

    square = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]
    ring = lambda r, o="<": struct.pack(o + "I", len(r)) + struct.pack(f"{o}{2 * len(r)}d", *(v for p in r for v in p))
    polygon = lambda rings, o="<": bytes([o == "<"]) + struct.pack(o + "II", 3, len(rings)) + b"".join(ring(r, o) for r in rings)
    multi = b"\x00" + struct.pack(">II", 6, 2) + polygon([square(0.0, 0.0)]) + polygon([square(5.0, 5.0), square(5.2, 5.2)], ">")
    assert wkb_rings(multi) == [square(0.0, 0.0), square(5.0, 5.0), square(5.2, 5.2)]
    spark.createDataFrame([(1, multi), (2, polygon([square(1.0, 0.0)])), (3, None)], "unit long, wkb binary").write.parquet(str(tmp_path / "wkb"))
    rings = read_polygons(spark, str(tmp_path / "wkb"))
    assert rings.count() == 4
    assert {(r["i"], r["j"]) for r in G.contiguity(rings, "rook").collect()} == {(1, 2), (2, 1)}
    spark.createDataFrame([(1, [square(0.0, 0.0), square(9.0, 9.0)]), (2, [square(1.0, 1.0)])], "unit long, rings array<array<struct<x double, y double>>>").write.parquet(str(tmp_path / "rings"))
    parts = read_polygons(spark, str(tmp_path / "rings"))
    assert G.weights(parts, "queen").edges.count() == 2 and G.weights(parts, "rook").edges.count() == 0
