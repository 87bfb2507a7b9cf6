"""Mixing sources to target weights, by hash-random order and distributed prefix sums.

Every document gets a hash-random key. Within its source, documents are ordered by key; the key's
leading bits range-partition each source into blocks whose count follows the number of rows, so a hot
source is spread over many tasks. Block totals are prefix-summed first (a small table), then documents
inside a block; a document's running total against its source's budget says how much of it is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraquant.llm.text import words
from terraquant.session import stored

#: Fixed values of the mix: weights by rank of the source, share of all sizes, largest repeat.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Rows aimed at in one block of a source.
BLOCK_ROWS = 2_000
SEED = "mix"
#: Sources up to which their cuts are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from per-document (source, size).

    Sources by code point, null last, get the weights in turn. The budget is share of all sizes; a target
    stops at epochs times its source and the excess goes to the others by weight. That fixed point is
    min(cap, level * weight), found here by prefix sums over the sources in order of cap / weight.
    One row per source; the window runs over this small table only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.lit(list(weights)), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    # the level is that of the first source whose cap is not reached
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    per = per.withColumn("at", level)
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def _placed(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: str, block_rows: int) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, rounds, left) of every row: left is what the budget still holds beyond the whole rounds when the row's turn comes."""
    sizes = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    sizes = stored(sizes, "sizes")
    targets = source_targets(sizes, weights, share, epochs)
    targets = targets.withColumn("budget", F.floor("target")).withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("source_size"))
    targets = stored(targets, "targets")
    n_rows, n_blocks = sizes.count(), 1
    while n_blocks * block_rows < n_rows and n_blocks < 1 << 20:
        n_blocks *= 2
    blocked = sizes.withColumn("block", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * n_blocks / F.lit(1 << 24)).cast("int"))
    blocked = blocked.withColumn("s", F.coalesce(F.col("source"), F.lit(""))).withColumn("s_null", F.col("source").isNull())
    totals = blocked.groupBy("s", "s_null", "block").agg(F.sum("size").alias("block_size"))
    ahead = Window.partitionBy("s", "s_null").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s", "s_null", "block", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("block_start"))
    plan = totals.join(targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s_null"), "source_size", "target", "rounds", "rest"), ["s", "s_null"])
    inside = Window.partitionBy("s", "s_null", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = blocked.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = run.join(plan, ["s", "s_null", "block"])
    return out.select("doc_id", "source", "size", "key", "source_size", "target", "rounds", (F.col("rest") - F.col("block_start") - F.col("run")).alias("left"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    size counts words; a null or empty text has size 0 and nothing taken. Each source gives floor(target)
    words exactly: whole epochs of every document, then documents by key until the budget is used, the
    last one in part. Null ids share the key of the empty string; equal keys are ordered by id and size, and
    rows equal in all of these are interchangeable. An empty table gives an empty result.
    """
    out = _placed(docs, weights, share, epochs, seed, block_rows)
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("left")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def source_cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, rounds, cut_key, cut_id): whole epochs of each source, and its last document of the epoch that is cut; null keys where none is."""
    placed = _placed(docs, weights, share, epochs, seed, block_rows)
    last = F.max(F.when((F.col("left") > 0) & (F.col("size") > 0), F.struct("key", "doc_id")))
    cuts = placed.groupBy("source").agg(F.max("rounds").cast("int").alias("rounds"), last.alias("cut"))
    return cuts.select("source", "rounds", F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs as the mix takes them: once per epoch that takes any of the document, whole, with their own columns.

    A document cut by its source's budget stays whole, so a source may exceed its target by one document.
    Documents of which nothing is taken (among them those without words) go. Rows of one source that share an id (or have
    none) come and go together. An empty table gives an empty result. Documents are not shuffled: what a row's source
    takes follows from its key and the source's cut.
    """
    cuts = stored(source_cuts(docs, weights, share, epochs, seed, block_rows), "cuts")
    cuts = cuts.select(F.col("source").alias("_source"), "rounds", F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("doc_id")).alias("cut"))
    few = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    packed = docs.select("doc_id", "text", F.col("source").alias("_own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_packed")).where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    joined = packed.join(F.broadcast(cuts) if few else cuts, F.col("_own").eqNullSafe(F.col("_source")))
    at = F.struct(random_key(F.col("doc_id"), seed).alias("key"), F.col("doc_id"))
    copies = F.col("rounds") + F.when(F.col("cut.key").isNotNull() & (at <= F.col("cut")), 1).otherwise(0)
    taken = joined.select("_packed", copies.alias("_copies")).where("_copies > 0").select("_packed", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_epoch"))
    return taken.select(*(F.col("_packed").getField(c).alias(c) for c in docs.columns))
