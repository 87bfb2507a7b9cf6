"""Row alignment, observation weights, coordinates, and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquant.functions.scalar import MAD_FACTOR, check_loss
from terraquant.session import stored

WEIGHT_TYPES = ("sampling", "frequency", "precision")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in any of the columns; with no columns, all rows."""
    if not columns:
        return df
    keep = None
    kinds = dict(df.dtypes)
    for c in columns:
        ok = F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
        keep = ok if keep is None else keep & ok
    return df.where(keep)


def normalize_weights(df: DataFrame, weight: str, out: str = "w") -> DataFrame:
    """Adds weights with mean 1. Raises if any is null, not finite or negative, or all are zero."""
    w = F.col(weight).cast("double")
    stats = df.agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1).otherwise(0)).alias("bad"), F.min(w).alias("least")).first()
    if stats["n"]:
        if stats["bad"]:
            raise ValueError("weights must be finite and not missing")
        if stats["least"] < 0:
            raise ValueError("weights must not be negative")
        if not stats["s"] > 0:
            raise ValueError("weights must not all be zero")
    factor = stats["n"] / stats["s"] if stats["n"] else 1.0
    return df.withColumn(out, w * F.lit(factor))


def standardized(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    """df with columns centred and scaled by their sample deviations (0 counts as 1), and the centres and scales."""
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    centre = [row[f"m_{c}"] or 0.0 for c in columns]
    scale = [row[f"s_{c}"] or 1.0 for c in columns]
    scale = [1.0 if s != s or s == 0 else s for s in scale]
    out = df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(columns, centre, scale)})
    return out, centre, scale


def mad_scale(df: DataFrame, value: Column) -> DataFrame:
    """One row (scale): the normal-consistent MAD of value, its deviation where that is 0, 1 where that is 0 too."""
    x = df.select(value.alias("v"))
    centre = x.agg(F.median("v").alias("c"), F.stddev_samp("v").alias("sd"))
    spread = x.crossJoin(F.broadcast(centre)).agg(F.median(F.abs(F.col("v") - F.col("c"))).alias("m"), F.first("sd").alias("sd"))  # one row
    mad = F.col("m") * MAD_FACTOR
    return spread.select(F.when(mad > 0, mad).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"))


def ald_scales(df: DataFrame, residuals: list[str], probs: list[str], tau: float, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Weighted scale of each regime: sum(w p rho(e)) / sum(w p), with floor."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = []
    for k, (e, p) in enumerate(zip(residuals, probs), 1):
        num, den = F.sum(w * F.col(p) * check_loss(F.col(e), tau)), F.sum(w * F.col(p))
        cols.append(F.greatest(num / F.when(den <= 0, 1.0).otherwise(den), F.lit(1e-8)).alias(f"sigma_{k}"))
    return df.groupBy(*(by or [])).agg(*cols)


def quantile_breaks(df: DataFrame, column: str, blocks: int) -> list[float]:
    """Type-7 quantiles at 0, 1/blocks, ..., 1. Raises if two are equal."""
    probs = [i / blocks for i in range(blocks + 1)]
    got = df.agg(F.percentile(column, F.lit(probs)).alias("q")).first()["q"]
    if got is None:
        return []
    if len(set(got)) < len(got):
        raise ValueError("breaks are not unique")
    return list(got)


def binned(column: str, breaks: list[float]) -> Column:
    """1-based number of the right-closed bin; the first bin includes its lower break; null outside."""
    x = F.col(column)
    out = F.when(x < breaks[0], F.lit(None).cast("int"))
    for i, b in enumerate(breaks[1:], 1):
        out = out.when(x <= b, F.lit(i))
    return out


def quantile_blocks(df: DataFrame, x: str, y: str, blocks: int) -> DataFrame:
    """Adds bx, by and block (bx.by): a grid of quantile bins over two coordinates."""
    out = df.withColumns({"bx": binned(x, quantile_breaks(df, x, blocks)), "by": binned(y, quantile_breaks(df, y, blocks))})
    return out.withColumn("block", F.concat_ws(".", "bx", "by"))


def balanced_folds(df: DataFrame, folds: int, key: str, seed: int = 1) -> DataFrame:
    """Adds fold (1..folds), as even as possible: rows in order of a seeded hash deal folds in turn within hash blocks.

    Blocks are numbered first, then rows inside a block, so no single task sorts all rows.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    marked = df.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(h, 54).cast("int"))
    per = marked.groupBy("_b").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows at most
    per = per.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return marked.withColumn("_r", rank).join(F.broadcast(per), "_b").withColumn("fold", ((F.col("_start") + F.col("_r")) % folds + 1).cast("int")).drop("_h", "_b", "_r", "_start")


def label_stability(df: DataFrame, slopes: list[str]) -> DataFrame:
    """One row (label_stability): share of rows whose ranking of the regimes by slope differs from that of the mean slopes."""

    def ranking(columns: list[Column]) -> Column:
        pairs = F.array_sort(F.array(*(F.struct(c.alias("v"), F.lit(i).alias("i")) for i, c in enumerate(columns))))
        return F.transform(pairs, lambda x: x["i"])

    overall = df.agg(*(F.avg(s).alias(f"_m{i}") for i, s in enumerate(slopes)))
    both = df.crossJoin(F.broadcast(overall))  # one row
    differs = ranking([F.col(s) for s in slopes]) != ranking([F.col(f"_m{i}") for i in range(len(slopes))])
    return both.agg(F.avg(differs.cast("double")).alias("label_stability"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with name, the row's number from 1 in the given order of columns, which tells rows apart.

    Rows are sorted in ranges; a range's rows are numbered in their own task, and the ranges' sizes, one a task, give the starts.
    """
    ranged = stored(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    starts, run = [], 0
    for number, size in sizes:
        starts.append((number, run))
        run += size
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(offsets, "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("int")).drop("_range", "_own", "_start")
