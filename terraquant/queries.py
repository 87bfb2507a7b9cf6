"""The registered queries over the example tables: one per operator, with DuckDB SQL where SQL can express it.

Stand-ins for geography: (l_quantity, l_discount in hundredths) are lattice locations, nations are regions whose
neighbours are the next keys in the same world region, and the first two entries of an embedding are coordinates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraquant.functions import scalar as S
from terraquant.operators import graph as G
from terraquant.operators import rows as R
from terraquant.plans.model import field_variance as spread_of
from terraquant.plans.model import long_surface, spatial_share
from terraquant.plans.select import best_cells, fold_losses
from terraquant.session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- stand-in tables


def lattice(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("lx"), F.round(F.col("l_discount") * 100).cast("int").alias("ly"), "l_extendedprice", "l_tax", "l_returnflag", "l_quantity")


LATTICE = "lat AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS lx, CAST(round(l_discount * 100) AS INTEGER) AS ly, l_extendedprice, l_tax, l_returnflag, l_quantity FROM lineitem)"


def lattice_units(spark, d) -> DataFrame:
    rows = lattice(spark, d).withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.spatial_units(rows, "lx", "ly", "row")


LATTICE_UNITS = LATTICE + ", unit AS (SELECT CAST(row_number() OVER (ORDER BY f, lx, ly) AS INTEGER) AS unit, lx AS x, ly AS y FROM (SELECT lx, ly, min(l_orderkey * 10 + l_linenumber) AS f FROM lat GROUP BY lx, ly))"


def points(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("unit"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("embedding")[2].cast("double").alias("z"), "label")


POINTS = "pt AS (SELECT vec_id AS unit, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings)"


def nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("unit"), F.col("n_regionkey").alias("r"))


def nation_edges(spark, d) -> DataFrame:
    n = nations(spark, d)
    a, b = n.select(F.col("unit").alias("i"), "r"), n.select(F.col("unit").alias("j"), "r")
    return a.join(b, "r").where(F.abs(F.col("i") - F.col("j")) == 5).select("i", "j", F.lit(1.0).alias("w"))


NATIONS = "na AS (SELECT CAST(n_nationkey AS BIGINT) AS unit, n_regionkey AS r FROM nation), ne AS (SELECT a.unit AS i, b.unit AS j, CAST(1 AS DOUBLE) AS w FROM na a JOIN na b ON a.r = b.r AND abs(a.unit - b.unit) = 5)"


def mixture_rows(spark, d) -> DataFrame:
    """Orders with fixed two-regime residuals and responsibilities."""
    o = table(spark, d, "orders")
    x = F.col("o_totalprice") / 1000
    eta = (F.col("o_custkey") % 7 - 3) / 2.0
    p = S.softmax([eta])
    return o.select("o_orderkey", "o_orderpriority", x.alias("x"), (x - 180.0).alias("e_1"), (x - 260.0).alias("e_2"), p[0].alias("p_1"), p[1].alias("p_2"), (F.col("o_custkey") % 5 + 1).cast("double").alias("w"))


MIX = """m AS (SELECT *, 1 / (1 + exp(eta)) AS p_1, exp(eta) / (1 + exp(eta)) AS p_2 FROM (
  SELECT o_orderkey, o_orderpriority, o_totalprice / 1000 AS x, o_totalprice / 1000 - 180.0 AS e_1, o_totalprice / 1000 - 260.0 AS e_2,
         CAST((o_custkey % 7 - 3) / CAST(2 AS DOUBLE) AS DOUBLE) AS eta, CAST(o_custkey % 5 + 1 AS DOUBLE) AS w FROM orders))"""


def _rho(u: str, tau: float) -> str:
    return f"(({u}) * ({tau} - CASE WHEN ({u}) < 0 THEN 1.0 ELSE 0.0 END))"


def _erfc_sql(x: str) -> str:
    def ratio(y, p, q):
        num, den = f"({y}) * {p[-1]!r}::DOUBLE", f"({y})"
        for a, b in zip(p[:-2], q[:-1]):
            num, den = f"(({num}) + {a!r}::DOUBLE) * ({y})", f"(({den}) + {b!r}::DOUBLE) * ({y})"
        return f"((({num}) + {p[-2]!r}::DOUBLE) / (({den}) + {q[-1]!r}::DOUBLE))"

    y = f"abs({x})"
    tail = f"(1 / greatest({y} * {y}, 1e-300))"
    far = f"exp(-{y} * {y}) / greatest({y}, 1e-300) * (0.5641895835477562869 - {tail} * {ratio(tail, S.TAIL_P, S.TAIL_Q)})"
    upper = f"CASE WHEN {y} <= 4 THEN exp(-{y} * {y}) * {ratio(y, S.ERFC_P, S.ERFC_Q)} ELSE {far} END"
    return f"(CASE WHEN {y} <= 0.46875 THEN 1 - ({x}) * {ratio(f'(({x}) * ({x}))', S.ERF_P, S.ERF_Q)} WHEN ({x}) < 0 THEN 2 - ({upper}) ELSE {upper} END)"


# ---- filters, weights, projections


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS y, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS x FROM lineitem WHERE l_linenumber <> 3 AND l_discount IS NOT NULL AND l_tax <> 0.05")
def complete_case(spark, d):
    li = table(spark, d, "lineitem")
    df = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("x"), F.when(F.col("l_tax") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("t"))
    return R.complete_cases(df, ["y", "x", "t"]).drop("t")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * (count(*) OVER ()) / (sum(l_quantity) OVER ()), 9) AS w FROM lineitem")
def weight_normalize(spark, d):
    return R.normalize_weights(table(spark, d, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", F.round("w", 9).alias("w"))


@query("""SELECT c_nationkey AS nation, round(1000 * (f + 0.5) / (n + 1), 8) AS rate, round(ln(1000 * (f + 0.5) / (n + 1)), 8) AS log_rate, round(u / (n + 1), 8) AS share_u
FROM (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS f, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS u
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)""")
def derived_rate(spark, d):
    from terraquant.sources.tables import with_rates

    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").cast("double").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.sum((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("u"))
    out = with_rates(g, "f", "n", "u")
    return out.select("nation", *(F.round(c, 8).alias(c) for c in ("rate", "log_rate", "share_u")))


@query(f"WITH {POINTS}, s AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM pt) SELECT unit, round((x - mx) / sx, 8) AS x, round((y - my) / sy, 8) AS y FROM pt, s")
def standardize_coords(spark, d):
    out, _, _ = R.standardized(points(spark, d), ["x", "y"])
    return out.select("unit", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"WITH {MIX} SELECT o_orderkey, round(p_1 * 1.5 / (p_1 * 1.5 + p_2), 9) AS n_1, round(p_2 / (p_1 * 1.5 + p_2), 9) AS n_2 FROM m")
def normalize_rows(spark, d):
    a, b = S.normalized([F.col("p_1") * 1.5, F.col("p_2")])
    return mixture_rows(spark, d).select("o_orderkey", F.round(a, 9).alias("n_1"), F.round(b, 9).alias("n_2"))


@query(f"WITH {MIX} SELECT o_orderkey, round(p_1 * (x - e_1) + p_2 * (x - e_2), 6) AS fitted, round(x - (p_1 * (x - e_1) + p_2 * (x - e_2)), 6) AS residual FROM m")
def fitted_residual(spark, d):
    df = mixture_rows(spark, d)
    fit = S.mixture_mean([F.col("p_1"), F.col("p_2")], [F.col("x") - F.col("e_1"), F.col("x") - F.col("e_2")])
    return df.select("o_orderkey", F.round(fit, 6).alias("fitted"), F.round(F.col("x") - fit, 6).alias("residual"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal < 8000 END, false) AS flag FROM customer")
def is_true(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.is_true(F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal") < 8000)).alias("flag"))


@query("""SELECT l_orderkey, l_linenumber, round(1.0 * 2 - 0.3 * ln(l_extendedprice) + 4.0 * l_discount + CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN -0.25 ELSE 0 END, 9) AS eta FROM lineitem""")
def formula_design(spark, d):
    from terraquant.plans.formula import Formula

    li = table(spark, d, "lineitem")
    design = Formula.parse("~ log(l_extendedprice) + l_discount + l_returnflag").design(li, {"l_returnflag": ["A", "N", "R"]})
    return li.select("l_orderkey", "l_linenumber", F.round(S.dot(design.columns, [2.0, -0.3, 4.0, 0.5, -0.25]), 9).alias("eta"))


@query("SELECT c_mktsegment, g AS \"G\", lam FROM (SELECT DISTINCT c_mktsegment FROM customer), (VALUES (2), (3)) a(g), (VALUES (0.1), (1.0), (10.0)) b(lam)")
def parameter_grid(spark, d):
    g = spark.createDataFrame([(2,), (3,)], "G int")
    lam = spark.createDataFrame([(0.1,), (1.0,), (10.0,)], "lam double")
    return table(spark, d, "customer").select("c_mktsegment").distinct().crossJoin(g).crossJoin(lam)  # a grid of parameters


# ---- scalar functions


@query(f"SELECT l_returnflag, count(*) AS n, round(sum({_rho('l_extendedprice - 30000', 0.25)}), 2) AS loss_25, round(sum({_rho('l_extendedprice - 30000', 0.5)}), 2) AS loss_50 FROM lineitem GROUP BY l_returnflag")
def check_loss_by_group(spark, d):
    u = F.col("l_extendedprice") - 30000
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(S.check_loss(u, 0.25)), 2).alias("loss_25"), F.round(F.sum(S.check_loss(u, 0.5)), 2).alias("loss_50"))


_U = "((value - 50) / 20)"


@query(f"SELECT event_id, round({_U} * (0.3 - 1 + 0.5 * {_erfc_sql(f'(-{_U} / 0.5 / 1.4142135623730951)')}) + 0.5 * exp(-0.5 * ({_U} / 0.5) * ({_U} / 0.5)) / 2.5066282746310002, 9) AS rho, round(0.3 - 1 + 0.5 * {_erfc_sql(f'(-{_U} / 0.5 / 1.4142135623730951)')}, 9) AS psi, round(exp(-0.5 * ({_U} / 0.5) * ({_U} / 0.5)) / 2.5066282746310002 / 0.5, 9) AS k FROM events")
def smoothed_loss(spark, d):
    u = (F.col("value") - 50) / 20
    return table(spark, d, "events").select("event_id", F.round(S.smooth_loss(u, 0.3, 0.5), 9).alias("rho"), F.round(S.smooth_score(u, 0.3, 0.5), 9).alias("psi"), F.round(S.smooth_curvature(u, 0.5), 9).alias("k"))


@query(f"SELECT event_id, round(0.5 * {_erfc_sql('(-((value - 50) / 15) / 1.4142135623730951)')}, 10) AS p FROM events")
def normal_cdf(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.normal_cdf((F.col("value") - 50) / 15), 10).alias("p"))


@query("SELECT round(pow(ln(greatest(n, 3)) / greatest(n, 3), 0.2), 9) AS h FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders)")
def smooth_bandwidth(spark, d):
    n = table(spark, d, "orders").count()
    return spark.range(1).select(F.round(F.lit(S.smooth_bandwidth(n)), 9).alias("h"))


@query(f"WITH {MIX} SELECT o_orderkey, round(0.21 / 40.0 * exp(-{_rho('e_1', 0.3)} / 40.0), 10) AS f FROM m")
def ald_density(spark, d):
    return mixture_rows(spark, d).select("o_orderkey", F.round(S.ald_density(F.col("e_1"), 40.0, 0.3), 10).alias("f"))


@query("SELECT event_id, round(CASE WHEN u < 0.3 THEN 2.0 / 0.7 * ln(u / 0.3) ELSE -2.0 / 0.3 * ln((1 - u) / 0.7) END, 8) AS e FROM (SELECT event_id, (event_id % 997 + 0.5) / 997 AS u FROM events)")
def ald_draw(spark, d):
    u = (F.col("event_id") % 997 + 0.5) / 997
    return table(spark, d, "events").select("event_id", F.round(S.ald_draw(u, 0.3, 2.0), 8).alias("e"))


@query("SELECT o_orderkey, round(1 / s, 9) AS p_1, round(exp(a) / s, 9) AS p_2, round(exp(b) / s, 9) AS p_3 FROM (SELECT *, 1 + exp(a) + exp(b) AS s FROM (SELECT o_orderkey, 0.4 - 0.002 * o_totalprice / 1000 AS a, -1 + 0.006 * o_totalprice / 1000 AS b FROM orders))")
def softmax_gate(spark, d):
    x = F.col("o_totalprice") / 1000
    p = S.softmax([0.4 - 0.002 * x, -1 + 0.006 * x])
    return table(spark, d, "orders").select("o_orderkey", *(F.round(v, 9).alias(f"p_{k}") for k, v in enumerate(p, 1)))


@query(f"WITH {POINTS}, a AS (SELECT a.unit AS i, b.unit AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS h FROM pt a JOIN pt b ON b.unit = a.unit + 1) SELECT i, j, round(exp(-h / 0.7), 9) AS m_half, round((1 + sqrt(3.0) * h / 0.7) * exp(-(sqrt(3.0) * h / 0.7)), 9) AS m_three_halves FROM a")
def matern(spark, d):
    p = points(spark, d)
    a, b = p.select(F.col("unit").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), p.select(F.col("unit").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    h = S.distance(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj"))
    return a.join(b, F.col("j") == F.col("i") + 1).select("i", "j", F.round(S.matern(h, 0.7, 0.5), 9).alias("m_half"), F.round(S.matern(h, 0.7, 1.5), 9).alias("m_three_halves"))


@query("SELECT c_nationkey AS unit, phi, round(phi - 1.959963984540054 * se, 9) AS lower, round(phi + 1.959963984540054 * se, 9) AS upper, coalesce(phi - 1.959963984540054 * se > 0 OR phi + 1.959963984540054 * se < 0, false) AS credible, round(exp(phi), 9) AS mult FROM (SELECT c_nationkey, round((avg(c_acctbal) - 4500) / 1000, 9) AS phi, CASE WHEN c_nationkey = 3 THEN NULL ELSE stddev_samp(c_acctbal) / 1000 / sqrt(count(*)) END AS se FROM customer GROUP BY c_nationkey)")
def phi_exp_ci(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.round((F.avg("c_acctbal") - 4500) / 1000, 9).alias("phi"), (F.stddev_samp("c_acctbal") / 1000 / F.sqrt(F.count("*"))).alias("se"))
    g = g.withColumn("se", F.when(F.col("unit") != 3, F.col("se")))
    lo, hi, ok = S.interval(F.col("phi"), F.col("se"), 1.959963984540054)
    return g.select("unit", "phi", F.round(lo, 9).alias("lower"), F.round(hi, 9).alias("upper"), ok.alias("credible"), F.round(F.exp("phi"), 9).alias("mult"))


# ---- mixture steps with fixed coefficients


@query(f"WITH {MIX} SELECT o_orderpriority, round(greatest(sum(w * p_1 * {_rho('e_1', 0.3)}) / sum(w * p_1), 1e-8), 7) AS sigma_1, round(greatest(sum(w * p_2 * {_rho('e_2', 0.3)}) / sum(w * p_2), 1e-8), 7) AS sigma_2 FROM m GROUP BY o_orderpriority")
def ald_scale(spark, d):
    out = R.ald_scales(mixture_rows(spark, d), ["e_1", "e_2"], ["p_1", "p_2"], 0.3, "w", ["o_orderpriority"])
    return out.select("o_orderpriority", *(F.round(c, 7).alias(c) for c in ("sigma_1", "sigma_2")))


@query(f"WITH {MIX}, f AS (SELECT *, greatest(p_1 * 0.21 / 40 * exp(-{_rho('e_1', 0.3)} / 40), 1e-12) AS j_1, greatest(p_2 * 0.21 / 60 * exp(-{_rho('e_2', 0.3)} / 60), 1e-12) AS j_2 FROM m) SELECT o_orderkey, round(j_1 / (j_1 + j_2), 8) AS q_1, round(j_2 / (j_1 + j_2), 8) AS q_2, CASE WHEN j_1 >= j_2 THEN 1 ELSE 2 END AS class FROM f")
def posterior_estep(spark, d):
    df = mixture_rows(spark, d)
    j = [S.floored(F.col(f"p_{k}") * S.ald_density(F.col(f"e_{k}"), s, 0.3)) for k, s in ((1, 40.0), (2, 60.0))]
    q = S.normalized(j)
    return df.select("o_orderkey", F.round(q[0], 8).alias("q_1"), F.round(q[1], 8).alias("q_2"), S.first_max(j).alias("class"))


@query(f"WITH {MIX} SELECT round(sum(w * ln(greatest(p_1 * 0.21 / 40 * exp(-{_rho('e_1', 0.3)} / 40) + p_2 * 0.21 / 60 * exp(-{_rho('e_2', 0.3)} / 60), 1e-12))), 4) AS loglik, round(sum(p_1), 6) AS occ_1, round(sum(p_2), 6) AS occ_2, round(avg(-(p_1 * ln(p_1) + p_2 * ln(p_2)) / ln(2)), 8) AS entropy FROM m")
def ald_loglik(spark, d):
    df = mixture_rows(spark, d)
    f = F.col("p_1") * S.ald_density(F.col("e_1"), 40.0, 0.3) + F.col("p_2") * S.ald_density(F.col("e_2"), 60.0, 0.3)
    return df.agg(F.round(F.sum(F.col("w") * F.log(S.floored(f))), 4).alias("loglik"), F.round(F.sum("p_1"), 6).alias("occ_1"), F.round(F.sum("p_2"), 6).alias("occ_2"), F.round(F.avg(S.entropy([F.col("p_1"), F.col("p_2")])), 8).alias("entropy"))


@query(f"WITH {MIX} SELECT o_orderkey, round(p_1 * (1.5 + 0.8 * x) + p_2 * (4 - 0.2 * x), 6) AS quantile, CASE WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS class FROM m")
def mixed_quantile(spark, d):
    df = mixture_rows(spark, d)
    x = F.col("x")
    return df.select("o_orderkey", F.round(F.col("p_1") * (1.5 + 0.8 * x) + F.col("p_2") * (4 - 0.2 * x), 6).alias("quantile"), S.first_max([F.col("p_1"), F.col("p_2")]).alias("class"))


@query("WITH s AS (SELECT 0.5 + 0.1 * l_discount * 100 AS a, 1.0 AS b FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM s) SELECT round(avg(CASE WHEN (a <= b) <> (ma <= mb) THEN 1.0 ELSE 0.0 END), 9) AS label_stability FROM s, m")
def label_stability(spark, d):
    df = table(spark, d, "lineitem").select((0.5 + 0.1 * F.col("l_discount") * 100).alias("a"), F.lit(1.0).alias("b"))
    return R.label_stability(df, ["a", "b"]).select(F.round("label_stability", 9).alias("label_stability"))


@query(f"WITH {POINTS} SELECT k AS regime, round(CASE k WHEN 1 THEN 0.5 + 0.8 * x ELSE -2 - 0.4 * y END, 9) AS slope, x AS coord1, y AS coord2 FROM pt, (VALUES (1), (2)) r(k)")
def coef_surface_long(spark, d):
    p = points(spark, d)
    out = long_surface(p, [0.5 + 0.8 * F.col("x"), -2 - 0.4 * F.col("y")], "slope", ("x", "y"))
    return out.withColumn("slope", F.round("slope", 9))


# ---- units and joins


@query(f"WITH {LATTICE_UNITS} SELECT unit, x, y FROM unit")
def unit_index(spark, d):
    return lattice_units(spark, d)


@query(f"WITH {LATTICE_UNITS} SELECT unit, round(avg(l_extendedprice - 38000), 6) AS z FROM lat JOIN unit ON lx = x AND ly = y GROUP BY unit")
def unit_residual(spark, d):
    rows = lattice(spark, d).withColumn("e", F.col("l_extendedprice") - 38000).withColumn("p", F.lit(1.0))
    units = lattice_units(spark, d)
    return G.unit_residual(G.with_unit(rows, units, "lx", "ly"), ["e"], ["p"], units).select("unit", F.round("z", 6).alias("z"))


@query("SELECT c_custkey, round(c_acctbal + 10 * sqrt(n_regionkey + 1), 6) AS shifted FROM customer JOIN nation ON c_nationkey = n_nationkey")
def phi_lookup(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_nationkey").alias("unit"), (10 * F.sqrt(F.col("n_regionkey") + 1)).alias("phi"))
    df = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return G.region_units(df, n, "c_nationkey").select("c_custkey", F.round(F.col("c_acctbal") + F.col("phi"), 6).alias("shifted"))


@query(f"WITH {POINTS}, u AS (SELECT * FROM pt WHERE unit % 3 = 0), c AS (SELECT p.unit AS id, u.unit, row_number() OVER (PARTITION BY p.unit ORDER BY (p.x - u.x) * (p.x - u.x) + (p.y - u.y) * (p.y - u.y), u.unit) AS r FROM pt p, u) SELECT id, unit FROM c WHERE r = 1")
def nearest_unit(spark, d):
    p = points(spark, d)
    return G.exact_else_nearest(p.select(F.col("unit").alias("id"), "x", "y"), p.where("unit % 3 = 0").select("unit", "x", "y"), "id").select("id", "unit")


@query(f"WITH {POINTS} SELECT count(DISTINCT (x, y)) AS n_sites FROM pt")
def distinct_locations(spark, d):
    return points(spark, d).agg(F.countDistinct("x", "y").alias("n_sites"))


@query(f"WITH {POINTS}, f AS (SELECT * FROM pt ORDER BY unit LIMIT 500) SELECT round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / 10, 9) AS reach FROM f a, f b")
def domain_extent(spark, d):
    from terraquant.operators.nngp import default_range

    return spark.createDataFrame([(round(default_range(points(spark, d)), 9),)], "reach double")


# ---- graphs

_KNN = f"{POINTS}, dr AS (SELECT a.unit AS i, b.unit AS j, row_number() OVER (PARTITION BY a.unit ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.unit) AS r FROM pt a JOIN pt b ON a.unit <> b.unit), k AS (SELECT i, j FROM dr WHERE r <= 5)"


@query(f"WITH {_KNN} SELECT i, j, CAST(1 AS DOUBLE) AS w FROM (SELECT i, j FROM k UNION SELECT j, i FROM k)")
def knn_graph(spark, d):
    return G.knn_graph(points(spark, d).select("unit", "x", "y"), 5)


@query(f"WITH {POINTS} SELECT a.unit AS i, b.unit AS j, CAST(1 AS DOUBLE) AS w FROM pt a JOIN pt b ON a.unit <> b.unit AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 0.01 AND 0.05")
def distance_band(spark, d):
    return G.distance_band(points(spark, d).select("unit", "x", "y"), 0.05, 0.01)


_ROOK = f"{LATTICE_UNITS}, e AS (SELECT a.unit AS i, b.unit AS j, CAST(1 AS DOUBLE) AS w FROM unit a JOIN unit b ON abs(a.x - b.x) + abs(a.y - b.y) = 1)"


@query(f"WITH {_ROOK} SELECT i, j, w FROM e")
def lattice_rook(spark, d):
    return G.lattice_rook(lattice_units(spark, d))


def _squares(spark, d) -> DataFrame:
    u = lattice_units(spark, d)
    corner = lambda a, b: F.struct((F.col("x") + a).cast("double").alias("x"), (F.col("y") + b).cast("double").alias("y"))
    return u.select("unit", F.array(*(corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("ring"))


@query(f"WITH {LATTICE_UNITS} SELECT a.unit AS i, b.unit AS j, CAST(1 AS DOUBLE) AS w FROM unit a JOIN unit b ON a.unit <> b.unit AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
def contiguity_queen(spark, d):
    return G.contiguity(_squares(spark, d), "queen")


@query(f"WITH {LATTICE_UNITS} SELECT a.unit AS i, b.unit AS j, CAST(1 AS DOUBLE) AS w FROM unit a JOIN unit b ON abs(a.x - b.x) + abs(a.y - b.y) = 1")
def contiguity_rook(spark, d):
    return G.contiguity(_squares(spark, d), "rook")


def _trade(spark, d) -> DataFrame:
    """Directed weights between nations: customers' orders by order status."""
    n = nation_edges(spark, d)
    return n.where("i < j OR i % 2 = 0").withColumn("w", (F.col("i") + 2 * F.col("j") + 1).cast("double"))


_TRADE = f"{NATIONS}, tr AS (SELECT i, j, CAST(i + 2 * j + 1 AS DOUBLE) AS w FROM ne WHERE i < j OR i % 2 = 0)"


@query(f"WITH {_TRADE} SELECT i, j, sum(w) AS w FROM (SELECT i, j, w / 2 AS w FROM tr UNION ALL SELECT j, i, w / 2 FROM tr) GROUP BY i, j")
def supplied_symmetrise(spark, d):
    return G.supplied(_trade(spark, d))


@query(f"WITH {_TRADE}, rs AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM tr) SELECT i, j, round(sum(w), 9) AS w FROM (SELECT i, j, w / 2 AS w FROM rs UNION ALL SELECT j, i, w / 2 FROM rs) GROUP BY i, j")
def row_standardized(spark, d):
    return G.row_standardized(_trade(spark, d)).select("i", "j", F.round("w", 9).alias("w"))


@query(f"WITH {_ROOK} SELECT i, sum(w) AS d FROM e GROUP BY i")
def degree(spark, d):
    return G.degree(G.lattice_rook(lattice_units(spark, d)))


_LAP = f"{NATIONS}, l AS (SELECT unit AS i, unit AS j, coalesce((SELECT sum(w) FROM ne WHERE i = unit), 0) AS v FROM na UNION ALL SELECT i, j, -w FROM ne)"


@query(f"WITH {_LAP} SELECT i, j, CAST(v AS DOUBLE) AS v FROM l")
def laplacian(spark, d):
    return G.laplacian(nation_edges(spark, d), nations(spark, d))


@query(f"WITH {_LAP} SELECT i, j, round(0.95 * v + CASE WHEN i = j THEN 0.05 ELSE 0 END, 9) AS v FROM l")
def leroux_q(spark, d):
    return G.car_precision(nation_edges(spark, d), nations(spark, d)).select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH {_LAP} SELECT i, j, round(v + CASE WHEN i = j THEN 0.000001 ELSE 0 END, 9) AS v FROM l")
def icar_q(spark, d):
    return G.car_precision(nation_edges(spark, d), nations(spark, d), kind="icar").select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH RECURSIVE {NATIONS}, reach AS (SELECT unit, unit AS other FROM na UNION SELECT r.unit, ne.j FROM reach r JOIN ne ON r.other = ne.i), lo AS (SELECT unit, min(other) AS low FROM reach GROUP BY unit) SELECT unit, CAST(dense_rank() OVER (ORDER BY low) AS INTEGER) AS component FROM lo")
def components(spark, d):
    return G.unit_components(nation_edges(spark, d), nations(spark, d))


@query(f"WITH {POINTS}, e AS (SELECT DISTINCT a.unit FROM pt a JOIN pt b ON a.unit <> b.unit AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02) SELECT unit FROM pt WHERE unit NOT IN (SELECT unit FROM e)")
def islands(spark, d):
    p = points(spark, d).select("unit", "x", "y")
    return G.islands(G.distance_band(p, 0.02), p)


@query(f"WITH {_LAP} SELECT a.i, b.j, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM l a JOIN l b ON a.j = b.i GROUP BY a.i, b.j")
def sparse_product(spark, d):
    lap = G.laplacian(nation_edges(spark, d), nations(spark, d))
    return G.sparse_product(lap, lap)


@query(f"WITH {POINTS}, o AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(unit AS VARCHAR))) AS ord FROM pt), r AS (SELECT a.unit AS i, b.unit AS j, row_number() OVER (PARTITION BY a.unit ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.unit) AS rank FROM o a JOIN o b ON b.ord < a.ord) SELECT i, j, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def nngp_neighbours(spark, d):
    from pyspark.sql import Window

    from terraquant.operators.nngp import earlier_neighbours

    p = points(spark, d).select("unit", "x", "y").withColumn("ord", F.row_number().over(Window.orderBy(F.md5(F.col("unit").cast("string").cast("binary")))))
    return earlier_neighbours(p).select("i", "j", "rank")


@query(f"WITH {NATIONS}, b AS (SELECT i, j, 0.4 AS b FROM ne WHERE j < i), f AS (SELECT unit AS i, unit AS j, 1.0 AS v FROM na UNION ALL SELECT i, j, -b FROM b), dd AS (SELECT unit AS i, CASE WHEN unit IN (SELECT i FROM b) THEN 0.84 ELSE 1.0 END AS d FROM na) SELECT x.j AS i, y.j, round(sum(x.v * y.v / d), 9) AS v FROM f x JOIN f y ON x.i = y.i JOIN dd ON dd.i = x.i GROUP BY x.j, y.j")
def nngp_assemble_q(spark, d):
    from terraquant.operators.nngp import assemble_precision

    e = nation_edges(spark, d).where("j < i").select("i", "j", F.lit(0.4).alias("b"), F.lit(0.84).alias("d"))
    first = nations(spark, d).join(e.select(F.col("i").alias("unit")), "unit", "left_anti").select(F.col("unit").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("b"), F.lit(1.0).alias("d"))
    return assemble_precision(e.unionByName(first)).select("i", "j", F.round("v", 9).alias("v"))


@query(f"WITH {_ROOK}, z AS (SELECT unit, avg(l_extendedprice) AS z FROM lat JOIN unit ON lx = x AND ly = y GROUP BY unit), c AS (SELECT unit, z - avg(z) OVER () AS z FROM z) SELECT round((SELECT count(*) FROM c) / (SELECT sum(w) FROM e) * (SELECT sum(a.z * w * b.z) FROM e JOIN c a ON a.unit = i JOIN c b ON b.unit = j) / (SELECT sum(z * z) FROM c), 8) AS statistic, (SELECT count(*) FROM c) AS n_units")
def moran_i(spark, d):
    units = lattice_units(spark, d)
    z = G.with_unit(lattice(spark, d), units, "lx", "ly").groupBy("unit").agg(F.avg("l_extendedprice").alias("z"))
    return G.moran(z, G.lattice_rook(units)).select(F.round("statistic", 8).alias("statistic"), "n_units")


@query(f"WITH {_LAP} SELECT i, CAST(sum(v * (j * j - 40)) AS DOUBLE) AS v FROM l GROUP BY i")
def sparse_vector(spark, d):
    lap = G.laplacian(nation_edges(spark, d), nations(spark, d)).withColumnRenamed("v", "w")
    return G.sparse_vector(lap, nations(spark, d).select("unit", (F.col("unit") * F.col("unit") - 40).cast("double").alias("z")))


# ---- grouped statistics

_BREAKS = "br AS (SELECT quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]) AS bx, quantile_cont(y, [0, 0.25, 0.5, 0.75, 1]) AS by FROM pt)"


def _bin_sql(x: str, b: str) -> str:
    return f"CASE WHEN {x} < {b}[1] THEN NULL WHEN {x} <= {b}[2] THEN 1 WHEN {x} <= {b}[3] THEN 2 WHEN {x} <= {b}[4] THEN 3 WHEN {x} <= {b}[5] THEN 4 END"


@query(f"WITH {POINTS}, {_BREAKS} SELECT unit, concat({_bin_sql('x', 'br.bx')}, '.', {_bin_sql('y', 'br.by')}) AS block FROM pt, br")
def quantile_blocks(spark, d):
    return R.quantile_blocks(points(spark, d), "x", "y", 4).select("unit", "block")


@query(f"WITH {POINTS}, {_BREAKS} SELECT concat({_bin_sql('x', 'br.bx')}, '.', {_bin_sql('y', 'br.by')}) AS block, round(sum(1 + z * z), 8) AS weight FROM pt, br GROUP BY 1")
def block_weights(spark, d):
    return R.quantile_blocks(points(spark, d), "x", "y", 4).groupBy("block").agg(F.round(F.sum(1 + F.col("z") * F.col("z")), 8).alias("weight"))


@query("WITH c AS (SELECT median(value) AS m FROM events) SELECT round(1.4826 * median(abs(value - m)), 8) AS scale FROM events, c")
def mad_scale(spark, d):
    return R.mad_scale(table(spark, d, "events"), F.col("value")).select(F.round("scale", 8).alias("scale"))


@query("SELECT o_orderpriority, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.1), 6) AS q10, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.9), 6) AS q90 FROM orders GROUP BY o_orderpriority")
def quantile_type7(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*(F.round(F.percentile("o_totalprice", F.lit(p)), 6).alias(f"q{int(p * 100)}") for p in (0.1, 0.5, 0.9)))


@query(f"WITH {POINTS}, m AS (SELECT label, x, x - avg(x) OVER (PARTITION BY label) AS res FROM pt) SELECT round(1 - var_samp(res) / var_samp(x), 9) AS r2 FROM m")
def spatial_r2(spark, d):
    p = points(spark, d)
    means = p.groupBy("label").agg(F.avg("x").alias("m"))
    return spatial_share(p.join(means, "label"), F.col("x"), F.col("m")).select(F.round("r2", 9).alias("r2"))


@query("SELECT n_regionkey AS regime, round(var_samp(phi), 6) AS variance FROM (SELECT n_regionkey, n_nationkey, avg(c_acctbal) AS phi FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def field_variance(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return spread_of(j.groupBy(F.col("n_regionkey").alias("regime"), "n_nationkey").agg(F.avg("c_acctbal").alias("phi"))).withColumn("variance", F.round("variance", 6))


@query("SELECT c_nationkey, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 6) AS spread, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_nationkey")
def grouped_range(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.max("c_acctbal") - F.min("c_acctbal"), 6).alias("spread"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query("SELECT round((syy * 0 + (sxx * sy - sx * sxy)) / (n * sxx - sx * sx), 5) AS intercept, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 7) AS slope FROM (SELECT sum(w) + 0.000001 AS n, sum(w * x) AS sx, sum(w * x * x) + 0.000001 AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(y) AS syy FROM (SELECT CAST(l_linenumber AS DOUBLE) AS w, l_quantity AS x, l_extendedprice AS y FROM lineitem))")
def wls_warm_start(spark, d):
    from terraquant.operators import solvers
    from terraquant.operators.sums import SparkRows

    one = F.array(F.lit(1.0))
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), F.array(F.lit(1.0), "l_quantity").alias("x"), one.alias("z"), F.col("l_linenumber").cast("double").alias("w"), F.lit(-1).cast("long").alias("unit"), one.alias("p"))
    state = solvers.State(np.zeros((2, 1)), np.zeros((0, 1)), np.zeros((1, 0)), [], 0.5)
    b = solvers.least_squares(SparkRows(rows), 0, state, np.zeros((2, 2)))[0]
    return spark.createDataFrame([(round(float(b[0]), 5), round(float(b[1]), 7))], "intercept double, slope double")


@query("WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS y, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT g, round(min(y), 6) AS q FROM r WHERE r >= 0.37 * n GROUP BY g")
def saturated_qr(spark, d):
    """Quantile regression on one factor: the least value at which the subgradient allows the level, by group."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"))
    fit = _estimator(formula="y ~ g", G=1, tau=0.37, spatial_coef=False).fit(o)
    return fit.transform(o.select("g").distinct()).select("g", F.round("quantile", 6).alias("q"))


@query(f"WITH {MIX} SELECT round(sum(w * p_1) / sum(w), 6) AS pi_1, round(sum(w * p_2) / sum(w), 6) AS pi_2 FROM m")
def constant_gate(spark, d):
    from terraquant.operators import solvers
    from terraquant.operators.sums import SparkRows

    df = mixture_rows(spark, d).select(F.col("x").alias("y"), F.array(F.lit(1.0)).alias("x"), F.array(F.lit(1.0)).alias("z"), "w", F.lit(-1).cast("long").alias("unit"), F.array("p_1", "p_2").alias("p"))
    old = solvers.State(np.zeros((1, 2)), np.zeros((0, 2)), np.zeros((1, 1)), [], 0.5)
    gamma, _ = solvers.gate_fit(SparkRows(df), old, np.zeros((1, 1)), 2)
    pi = solvers.softmax_rows(np.ones((1, 1)), gamma)[0]
    return spark.createDataFrame([(round(float(pi[0]), 6), round(float(pi[1]), 6))], "pi_1 double, pi_2 double")


@query(f"SELECT CAST(o_orderkey % 5 + 1 AS INTEGER) AS fold, round(sum({_rho('o_totalprice - (120000 + 40 * (o_custkey % 1000))', 0.5)}), 2) AS loss FROM orders GROUP BY 1")
def cv_check_loss(spark, d):
    u = F.col("o_totalprice") - (120000 + 40 * (F.col("o_custkey") % 1000))
    folds = table(spark, d, "orders").withColumn("part", (F.col("o_orderkey") % 5 + 1).cast("int"))
    return fold_losses(folds, "part", u, 0.5).withColumn("loss", F.round("loss", 2))


@query("SELECT CAST(f AS INTEGER) AS fold, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) % 5 + 1 AS f FROM customer) GROUP BY f")
def balanced_folds(spark, d):
    return R.balanced_folds(table(spark, d, "customer"), 5, "c_custkey").groupBy("fold").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_orderpriority, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_by_group(spark, d):
    return best_cells(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def unmatched_keys(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").join(bad, "user_id", "left_anti").select("event_id")


# ---- estimators and resampling: SQL where the fit has a closed form; tests hold the others to known truth


def _estimator(**options):
    from terraquant.plans.model import SpatialQuantileMixture

    return SpatialQuantileMixture(**options)


def median_fit(spark, d, tau: float = 0.5):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") % 97 / 97.0).alias("u"), "o_orderpriority")
    return o, _estimator(formula="price ~ u + o_orderpriority", G=1, tau=tau, spatial_coef=False).fit(o)


@query()
def fit_median(spark, d):
    o, fit = median_fit(spark, d)
    return fit.transform(o).select("o_orderkey", "price", "quantile", (F.col("price") - F.col("quantile")).alias("residual"))


@query()
def fit_mixture(spark, d):
    p = points(spark, d)
    fit = _estimator(formula="z ~ label", G=2, coords=("x", "y"), spatial_coef=False).fit(p)
    return fit.transform(p).select("unit", "prior", "quantile", "regime", "posterior")


@query()
def fit_car(spark, d):
    from terraquant.plans.model import FieldSpec

    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_acctbal") / 1000).alias("y"), (F.col("c_custkey") % 13 / 13.0).alias("x"), F.col("c_nationkey").cast("string").alias("region"))
    e = nation_edges(spark, d)
    fit = _estimator(formula="y ~ x", G=1, region="region", spatial_coef=False, spatial_error=FieldSpec(edges=e), variance="sandwich").fit(n)
    return fit.phi_surface(spark)


@query()
def fit_nngp(spark, d):
    from terraquant.plans.model import FieldSpec

    fit = _estimator(formula="z ~ label", G=1, coords=("x", "y"), spatial_coef=False, spatial_error=FieldSpec(kind="nngp", m=6)).fit(points(spark, d))
    return fit.phi_surface(spark, ci=False)


@query()
def fit_kde(spark, d):
    fit = _estimator(formula="z ~ label", G=2, coords=("x", "y"), spatial_coef=False, spatial_gate=False, method="kde").fit(points(spark, d))
    return fit.coef_frame(spark)


@query()
def surface_slopes(spark, d):
    p = points(spark, d)
    return _estimator(formula="z ~ label", G=1, coords=("x", "y")).fit(p).coef_surface(p)


@query()
def surface_gate(spark, d):
    p = points(spark, d)
    return _estimator(formula="z ~ label", G=2, coords=("x", "y"), spatial_coef=False).fit(p).gate_surface(p)


@query()
def spatial_plus(spark, d):
    return _estimator(formula="z ~ label", G=1, coords=("x", "y"), spatial_coef=False, spatial_plus=True).fit(points(spark, d)).coef_frame(spark)


@query()
def sandwich_summary(spark, d):
    return median_fit(spark, d)[1].summary(spark)


_SANDWICH = f"""
WITH o AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS y FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y) AS r, count(*) OVER (PARTITION BY g) AS n FROM o),
q AS (SELECT g, min(y) AS q FROM r WHERE r >= 0.37 * n GROUP BY g),
e AS (SELECT g, y - q AS e FROM o JOIN q USING (g)),
c AS (SELECT median(e) AS m, CAST(count(*) AS DOUBLE) AS n FROM e),
h AS (SELECT greatest(1e-3, pow(ln(greatest(max(n), 3)) / greatest(max(n), 3), 0.2) * 1.4826 * median(abs(e - m))) AS h FROM e, c),
k AS (SELECT g, exp(-0.5 * (e / h) * (e / h)) / 2.5066282746310002 / h AS k, 0.37 - 1 + 0.5 * {_erfc_sql("(-(e / h) / 1.4142135623730951)")} AS psi FROM e, h),
v AS (SELECT g, sum(psi * psi) / (sum(k) * sum(k)) AS v FROM k GROUP BY g),
b AS (SELECT q.g, q.q, v.v, min(q.g) OVER () AS g0 FROM q JOIN v USING (g))
SELECT CASE WHEN a.g = a.g0 THEN '(Intercept)' ELSE 'g' || a.g END AS term, round(CASE WHEN a.g = a.g0 THEN a.q ELSE a.q - z.q END, 5) AS estimate,
       round(sqrt(CASE WHEN a.g = a.g0 THEN a.v ELSE a.v + z.v END), 5) AS se
FROM b a JOIN b z ON z.g = a.g0"""


@query(_SANDWICH)
def sandwich_saturated(spark, d):
    """Estimates and standard errors of a quantile regression on one factor, which have a closed form."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("y"))
    fit = _estimator(formula="y ~ g", G=1, tau=0.37, spatial_coef=False).fit(o)
    return fit.summary(spark).select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


@query(f"WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS y FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y) AS r, count(*) OVER (PARTITION BY g) AS n FROM o), q AS (SELECT g, min(y) AS q, min(n) AS n FROM r WHERE r >= 0.37 * n GROUP BY g), s AS (SELECT sum({_rho('y - q', 0.37)}) / count(*) AS s, count(*) AS n FROM o JOIN q USING (g)), l AS (SELECT n, 6.0 AS df, n * ln(0.2331 / s) - n AS ll FROM s) SELECT round(ll, 3) AS loglik, round(-2 * ll + 2 * df, 3) AS aic, round(-2 * ll + ln(n) * df, 3) AS bic, n AS nobs FROM l")
def fit_criteria(spark, d):
    """Likelihood and criteria of a quantile regression on one factor."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"))
    fit = _estimator(formula="y ~ g", G=1, tau=0.37, spatial_coef=False).fit(o)
    return spark.createDataFrame([(round(fit.loglik, 3), round(fit.aic(), 3), round(fit.bic, 3), fit.nobs)], "loglik double, aic double, bic double, nobs long")


@query()
def bootstrap_interval(spark, d):
    fit = _estimator(formula="z ~ label", G=1, coords=("x", "y"), spatial_coef=False).fit(points(spark, d))
    fit.bootstrap()
    return spark.createDataFrame(fit.confint(), "regime int, term string, estimate double, lower double, upper double")


@query()
def model_selection(spark, d):
    from terraquant.plans.select import select_model

    return select_model(_estimator(formula="z ~ label", coords=("x", "y"), spatial_coef=False), points(spark, d), "unit").table


_PERMUTED = f"""
WITH {NATIONS}, z AS (SELECT CAST(c_nationkey AS BIGINT) AS unit, avg(c_acctbal) AS z FROM customer GROUP BY c_nationkey),
e AS (SELECT s AS sim, unit, z FROM z, range(0, 1000) t(s)),
o AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY unit) AS own, row_number() OVER (PARTITION BY sim ORDER BY md5('1:' || sim || ':' || unit), unit) AS dealt FROM e),
d AS (SELECT a.sim, a.unit, b.z - (SELECT avg(z) FROM z) AS c FROM o a JOIN o b ON a.sim = b.sim AND b.own = CASE WHEN a.sim = 0 THEN a.own ELSE a.dealt END)
SELECT CAST(x.sim AS INTEGER) AS sim, round((SELECT count(*) FROM z) / s0 * a / q, 8) AS statistic
FROM (SELECT l.sim, sum(l.c * w * r.c) AS a, sum(w) AS s0 FROM ne JOIN d l ON l.unit = i JOIN d r ON r.unit = j AND r.sim = l.sim GROUP BY l.sim) x
JOIN (SELECT sim, sum(c * c) AS q FROM d GROUP BY sim) y ON x.sim = y.sim"""


def permuted_moran(spark, d) -> DataFrame:
    from terraquant.operators.moran import permutation_statistics

    z = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.avg("c_acctbal").alias("z"))
    return permutation_statistics(z, nation_edges(spark, d))


@query(_PERMUTED)
def moran_permutations(spark, d):
    return permuted_moran(spark, d).withColumn("statistic", F.round("statistic", 8))


@query(f"WITH p AS ({_PERMUTED}), s AS (SELECT statistic AS seen FROM p WHERE sim = 0) SELECT max(seen) AS statistic, round((1 + sum(CASE WHEN abs(statistic) >= abs(seen) - 1e-15 THEN 1 ELSE 0 END)) / (count(*) + 1), 9) AS p_value, count(*) AS nsim FROM p, s WHERE sim > 0")
def moran_test(spark, d):
    from terraquant.operators.moran import permutation_p

    return permutation_p(moran_permutations(spark, d)).withColumn("p_value", F.round("p_value", 9))


@query()
def nngp_precision(spark, d):
    from terraquant.operators.nngp import nngp_precision as precision

    return precision(points(spark, d).select("unit", "x", "y"))


def _u(seed: int, half: int = 0) -> str:
    return f"((CAST(CAST('0x' || substr(md5('{seed}:' || row), {1 + 13 * half}, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)"


def _n(seed: int) -> str:
    return f"(sqrt(-2 * ln({_u(seed)})) * cos(6.283185307179586 * {_u(seed, 1)}))"


@query(f"""
WITH a AS (SELECT row, {_u(1)} AS s1, {_u(2)} AS s2, {_n(3)} AS x, {_n(4)} AS x2, {_u(5)} AS u, {_n(6)} * 0.4 AS e FROM range(0, 1000) t(row)),
g AS (SELECT *, exp(-0.3 + 4 * (s1 - 0.5)) AS g2, exp(-0.3 + 4 * (s2 - 0.5)) AS g3 FROM a),
k AS (SELECT *, CASE WHEN u < 1 / (1 + g2 + g3) THEN 1 WHEN u < (1 + g2) / (1 + g2 + g3) THEN 2 ELSE 3 END AS z FROM g),
m AS (SELECT *, CASE WHEN z = 1 THEN 0.5 + s1 ELSE -2 - s1 END AS slope FROM k)
SELECT row, round(s1, 9) AS s1, round(s2, 9) AS s2, round(x, 9) AS x, round(x2, 9) AS x2, z, round(slope, 9) AS slope_x, round((z - 1) * 3 + slope * x + 0.5 * x2, 8) AS q,
       round((z - 1) * 3 + slope * x + 0.5 * x2 + e - (SELECT quantile_cont(e, 0.5) FROM a), 8) AS y FROM m""")
def simulate_mixture(spark, d):
    from terraquant.sources.simulate import mixture

    return mixture(spark, 1000, 3, coef_slope=1.0).select("row", "z", *(F.round(c, 8 if c in "qy" else 9).alias(c) for c in ("s1", "s2", "x", "x2", "slope_x", "q", "y")))


@query()
def simulate_field(spark, d):
    from terraquant.sources.simulate import car_lattice

    return car_lattice(spark, 500, 6, 2)[0]


@query(f"SELECT row, round(s1, 9) AS s1, round(s2, 9) AS s2, round(f, 9) AS f, round(f + 0.6 * e1, 8) AS x, round(1 + (f + 0.6 * e1) + 2 * f + 0.4 * e2, 8) AS y FROM (SELECT *, sin(6 * s1) + cos(6 * s2) AS f FROM (SELECT row, {_u(1)} AS s1, {_u(2)} AS s2, {_n(3)} AS e1, {_n(4)} AS e2 FROM range(0, 500) t(row)))")
def simulate_confounded(spark, d):
    from terraquant.sources.simulate import confounded

    return confounded(spark, 500).select("row", *(F.round(c, 8 if c in "xy" else 9).alias(c) for c in ("s1", "s2", "f", "x", "y")))


@query(f"SELECT row, round(CASE WHEN u < 0.3 THEN 2.0 / 0.7 * ln(u / 0.3) ELSE -2.0 / 0.3 * ln((1 - u) / 0.7) END, 8) AS e FROM (SELECT row, {_u(1)} AS u FROM range(0, 1000) t(row))")
def simulate_laplace(spark, d):
    from terraquant.sources.simulate import laplace

    return laplace(spark, 1000, 0.3, 2.0).withColumn("e", F.round("e", 8))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def sample_rows(spark, d):
    from terraquant.sources.tables import sample_rows as sample

    return sample(table(spark, d, "orders"), 500, "o_orderkey").select("o_orderkey", "o_totalprice")


# ---- saturated fits: what SQL can say of the estimator


_ORDERS = "o AS (SELECT o_orderkey, o_orderpriority AS g, o_totalprice / 1000 AS y, CAST(o_custkey % 5 + 1 AS DOUBLE) AS w FROM orders)"
_QUANTILES = f"{_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y) AS r, count(*) OVER (PARTITION BY g) AS n FROM o), q AS (SELECT g, min(y) AS q FROM r WHERE r >= 0.37 * n GROUP BY g)"


def saturated(spark, d, **options):
    """Orders and a quantile regression of their price on their priority alone."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 5 + 1).cast("double").alias("w"))
    return o, _estimator(formula="y ~ g", G=1, tau=0.37, spatial_coef=False, **options).fit(o)


@query(f"WITH {_QUANTILES} SELECT o_orderkey, round(q, 6) AS quantile, 1 AS class, CAST(1 AS DOUBLE) AS prob FROM o JOIN q USING (g)")
def predict_rows(spark, d):
    o, fit = saturated(spark, d)
    out = fit.predict(fit.predict(fit.predict(o, "quantile"), "class"), "prob")
    return out.select("o_orderkey", F.round("quantile", 6).alias("quantile"), "class", F.get("prob", F.lit(0)).alias("prob"))


@query(f"WITH {_QUANTILES} SELECT o_orderkey, round(q, 6) AS fitted, round(y - q, 6) AS residual FROM o JOIN q USING (g)")
def fit_residuals(spark, d):
    o, fit = saturated(spark, d)
    return fit.residuals(o).select("o_orderkey", F.round("fitted", 6).alias("fitted"), F.round("residual", 6).alias("residual"))


@query(f"WITH {_QUANTILES}, b AS (SELECT *, min(g) OVER () AS g0 FROM q) SELECT 1 AS regime, CASE WHEN a.g = a.g0 THEN '(Intercept)' ELSE 'g' || a.g END AS term, round(CASE WHEN a.g = a.g0 THEN a.q ELSE a.q - z.q END, 5) AS estimate FROM b a JOIN b z ON z.g = a.g0")
def constant_coefficients(spark, d):
    return saturated(spark, d)[1].coef_frame(spark).withColumn("estimate", F.round("estimate", 5))


@query(f"WITH s AS ({_SANDWICH}) SELECT term, round(estimate / se, 2) AS z, round({_erfc_sql('(abs(estimate / se) / 1.4142135623730951)')}, 3) AS p, round(estimate - 1.6448536269514722 * se, 3) AS lower, round(estimate + 1.6448536269514722 * se, 3) AS upper FROM s")
def confidence_intervals(spark, d):
    _, fit = saturated(spark, d)
    s = fit.summary(spark).select("term", F.round("z", 2).alias("z"), F.round("p", 3).alias("p"))
    ci = spark.createDataFrame(fit.confint(0.9), "regime int, term string, estimate double, lower double, upper double")
    return s.join(ci.select("term", F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper")), "term")


@query(f"WITH {_ORDERS}, r AS (SELECT g, y, sum(w) OVER (PARTITION BY g ORDER BY y, o_orderkey) AS r, sum(w) OVER (PARTITION BY g) AS n FROM o) SELECT g, round(min(y), 6) AS q FROM r WHERE r >= 0.37 * n GROUP BY g")
def weighted_qr(spark, d):
    o, fit = saturated(spark, d, weights="~ w")
    return fit.transform(o.select("g").distinct()).select("g", F.round("quantile", 6).alias("q"))


def _rows_of(df, x: list, w, p: list):
    from terraquant.operators.sums import SparkRows

    return SparkRows(df.select("y", F.array(*x).alias("x"), F.array(F.lit(1.0)).alias("z"), w.alias("w"), F.lit(-1).cast("long").alias("unit"), F.array(*p).alias("p")))


_GRAM_E = "(l_extendedprice / 1000 - 1.5 * l_quantity)"


@query(f"SELECT round(sum(k), 5) AS a00, round(sum(k * l_quantity), 4) AS a01, round(sum(k * l_quantity * l_quantity), 3) AS a11, round(sum(s), 5) AS g0, round(sum(s * l_quantity), 4) AS g1 FROM (SELECT l_quantity, l_linenumber * exp(-0.5 * ({_GRAM_E} / 2) * ({_GRAM_E} / 2)) / 2.5066282746310002 / 2 AS k, l_linenumber * (0.3 - 1 + 0.5 * {_erfc_sql(f'(-({_GRAM_E} / 2) / 1.4142135623730951)')}) AS s FROM lineitem)")
def gram_sums(spark, d):
    """Curvature and score of one Newton step of the smoothed quantile regression."""
    from terraquant.operators import solvers

    df = table(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    rows = _rows_of(df, [F.lit(1.0), F.col("l_quantity")], F.col("l_linenumber").cast("double"), [F.lit(1.0)])
    state = solvers.State(np.zeros((2, 1)), np.zeros((0, 1)), np.zeros((1, 0)), [], 0.3)
    a, g = rows.reduce(solvers._gram, 0, state, np.array([0.0, 1.5]), np.zeros(0), 2.0, 0)
    got = [round(float(v), k) for v, k in ((a[0, 0], 5), (a[0, 1], 4), (a[1, 1], 3), (g[0], 5), (g[1], 4))]
    return spark.createDataFrame([tuple(got)], "a00 double, a01 double, a11 double, g0 double, g1 double")


@query(f"WITH {MIX}, p AS (SELECT sum(w * p_2) / sum(w) AS pi, sum(w) AS n FROM m) SELECT round(ln(pi / (1 - pi)), 6) AS gamma, round(-n * pi * (1 - pi), 3) AS hessian, round((SELECT sum(w * (p_2 - pi) * w * (p_2 - pi)) FROM m) / (n * pi * (1 - pi)) / (n * pi * (1 - pi)) * 1e6, 5) AS variance FROM p")
def gate_sandwich(spark, d):
    """Gate of fixed responsibilities: estimate, curvature and robust variance (in millionths)."""
    from terraquant.operators import solvers

    df = mixture_rows(spark, d).withColumn("y", F.col("x"))
    rows = _rows_of(df, [F.lit(1.0)], F.col("w"), [F.col("p_1"), F.col("p_2")])
    state = solvers.State(np.zeros((1, 2)), np.zeros((0, 2)), np.zeros((1, 1)), [], 0.5)
    gamma, hessian = solvers.gate_fit(rows, state, np.zeros((1, 1)), 2)
    v = solvers.gate_sandwich(rows, state, gamma, hessian)
    return spark.createDataFrame([(round(float(gamma[0, 0]), 6), round(float(hessian[0, 0]), 3), round(float(v[0, 0]) * 1e6, 5))], "gamma double, hessian double, variance double")


@query("SELECT c_custkey, CAST(1 AS DOUBLE) AS a, c_acctbal / 1000 AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS c, CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END AS d, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END AS e, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS f FROM customer")
def gating_design(spark, d):
    """Design of a gate: intercept, a scaled covariate, a factor against its first level."""
    from terraquant.plans.formula import Formula

    df = table(spark, d, "customer")
    design = Formula.parse("~ I(c_acctbal / 1000) + c_mktsegment").design(df)
    return df.select("c_custkey", *(c.cast("double").alias(n) for c, n in zip(design.columns, "abcdef")))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def csv_round_trip(spark, d):
    """Rows written as CSV and read back with their schema."""
    from terraquant.session import shared_dir
    from terraquant.sources.tables import read_csv, write_csv

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), path)
    return read_csv(spark, path, "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string")


@query(f"WITH {NATIONS} SELECT i, j, w FROM ne")
def graph_round_trip(spark, d):
    from terraquant.session import shared_dir
    from terraquant.sources.tables import read_graph, write_graph

    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    write_graph(nation_edges(spark, d), path)
    return read_graph(spark, path)


@query(f"WITH {_ROOK}, c AS (SELECT count(DISTINCT unit) AS n_units FROM unit), l AS (SELECT count(*) AS n_links FROM e), s AS (SELECT count(*) AS n_islands FROM unit WHERE unit NOT IN (SELECT i FROM e)) SELECT n_units, n_links, n_islands FROM c, l, s")
def weights_summary(spark, d):
    return G.weights(lattice_units(spark, d), "lattice").summary().drop("n_components")


@query(f"WITH {POINTS}, a AS (SELECT i.unit AS i, j.unit AS j, row_number() OVER (PARTITION BY i.unit ORDER BY (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y), j.unit) AS r, (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) AS d2 FROM pt i JOIN pt j ON i.unit <> j.unit) SELECT i, j, round(d2, 10) AS d2, CAST(r AS INTEGER) AS rank FROM a WHERE r <= 8")
def nearest_neighbours(spark, d):
    from terraquant.operators.neighbours import nearest

    return nearest(points(spark, d).select("unit", "x", "y"), 8).withColumn("d2", F.round("d2", 10))
