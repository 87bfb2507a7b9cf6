"""Quality rules: plain text statistics, and a hashed n-gram log-likelihood ratio against a trusted target.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two multinomials are counted over whole
tables, one over the trusted target's documents, one over the raw corpus. A document's verdict is the mean
log ratio of its n-grams against a threshold, which relative_rules takes from the target's own scores. Only DataFrame functions are used: the bucket weights
have a fixed size and are broadcast, so scoring is an explode, a hash probe and an aggregate in one stage,
followed by a shuffle of one small row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquant.llm.text import count_in, solid_length, words
from terraquant.session import stored

BUCKETS = 1 << 17
#: Documents whose mean log ratio is below this are not kept.
THRESHOLD = -0.17
SMOOTHING = 1.0
#: For verdicts that don't depend on the tables' size: pseudo-counts as a share of each multinomial's total, the quantile of
#: the target's own scores that is the threshold, and the step of the grid on which that quantile is exact.
SHARE = 0.1
QUANTILE = 0.01
GRID = 1e-4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most target ids that are broadcast; beyond, the target is found by a shuffled join.
BROADCAST_IDS = 2_000_000


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _first(a: Column, short_by: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - short_by, F.lit(0)))


def with_word_hashes(docs: DataFrame) -> DataFrame:
    """Adds _w (words' hashes) and _bi (hashes of adjacent pairs)."""
    out = docs.withColumn("_w", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)))
    return out.withColumn("_bi", F.zip_with(_first(F.col("_w"), 1), _shifted(F.col("_w"), 1), lambda a, b: F.xxhash64(a, b)))


def ngrams() -> Column:
    """Hashes of all n-grams of a row with word hashes."""
    return F.concat("_w", "_bi")


def bucket(gram: str) -> Column:
    return F.pmod(F.col(gram), F.lit(BUCKETS)).cast("int")


def _targets(target_ids: DataFrame) -> DataFrame:
    ids = target_ids.select(F.col("doc_id").alias("_target")).where("_target IS NOT NULL").distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def bucket_counts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(bucket, t, r, tt, rr): n-grams of each bucket in the target (_target of ids) and in the raw corpus, and both totals."""
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_target"), "left")
    grams = with_word_hashes(marked).select(F.explode(ngrams()).alias("gram"), F.when(F.col("_target").isNotNull(), 1).otherwise(0).alias("t"))
    counts = grams.groupBy(bucket("gram").alias("bucket")).agg(F.sum("t").alias("t"), F.count("*").alias("r"))
    counts = stored(counts, "counts")  # at most BUCKETS rows, used twice
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("t").alias("tt"), F.sum("r").alias("rr"))))  # one row


def bucket_weights(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(bucket, weight): log ratio of each bucket's share in the target and in the raw corpus. At most BUCKETS rows."""
    share = lambda n, of: (F.col(n) + SMOOTHING) / (F.col(of) + SMOOTHING * BUCKETS)
    return bucket_counts(docs, _targets(target_ids)).select("bucket", F.log(share("t", "tt") / share("r", "rr")).alias("weight"))


def with_base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text hashes and the base statistics of every row of docs (doc_id, text). Null texts count as empty."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = with_word_hashes(docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("_t")))
    out = out.select(
        "doc_id", "_w", "_bi",
        F.size("_w").cast("long").alias("n_words"),
        solid_length(t).cast("long").alias("word_chars"),
        count_in(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.zip_with(_first(F.col("_bi"), 1), _shifted(F.col("_w"), 2), lambda a, b: F.xxhash64(a, b)).alias("_tri"),
    )
    repeats = F.size(F.array_distinct("_tri")) < F.size("_tri")
    placed = F.zip_with(F.col("_tri"), F.sequence(F.lit(0), F.size("_tri") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.when(repeats, F.array_sort(placed)))
    s = F.col("_sorted")
    twice = F.flatten(F.zip_with(_first(s, 1), _shifted(s, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(twice), lambda i: F.array(i, i + 1, i + 2)))))
    return out.select(
        "doc_id", "_w", "_bi", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(s.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(scored: DataFrame, threshold: Column) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(*NAMES, failed.alias("base_failed"), (~failed & F.coalesce(F.col("llr") >= threshold, F.lit(False))).alias("kept"), "llr")


def quality_rules(docs: DataFrame, target_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base statistics, base_failed, llr and kept for every row of docs (doc_id, text).

    target_ids (doc_id) names the trusted documents. A text without words has no llr and fails the base rules.
    Where the target is empty all ratios fall back on the smoothing. Repeated rows are judged each, null ids too.
    Scores and threshold are fixed values of one table's size; relative_rules' are not.
    """
    weights = bucket_weights(docs, target_ids)
    grams = with_base_rules(docs).withColumn("_row", F.monotonically_increasing_id()).select("_row", *NAMES, F.explode_outer(ngrams()).alias("gram"))
    scored = grams.select("_row", *NAMES, bucket("gram").alias("bucket")).join(F.broadcast(weights), "bucket", "left").groupBy("_row", *NAMES).agg(F.avg("weight").alias("llr"))
    return _judged(scored, F.lit(threshold))


def relative_rules(docs: DataFrame, target_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """quality_rules with scores that are comparable between sizes, and the threshold taken from the target.

    Each multinomial gets pseudo-counts of SHARE of its own total, so that they weigh the same in any table. An n-gram
    is rated by the other occurrences in both: a trusted document does not vouch for itself. The threshold is the
    given quantile of the scores of those trusted documents that pass the base rules, on a grid of GRID; without any,
    nothing is kept.
    """
    ids = _targets(target_ids)
    share = lambda n, of, own: (F.col(n) - own + SHARE * F.col(of) / BUCKETS) / (F.col(of) * (1 + SHARE) - own)
    weight = lambda own: F.when((F.col("tt") > 1) & (F.col("t") >= own), F.log(share("t", "tt", own) / share("r", "rr", 1)))
    weights = F.broadcast(bucket_counts(docs, ids).select("bucket", weight(0).alias("w0"), weight(1).alias("w1")))
    rows = with_base_rules(docs).withColumn("_row", F.monotonically_increasing_id()).join(ids, F.col("doc_id") == F.col("_target"), "left")
    rows = rows.withColumn("_own", F.col("_target").isNotNull().cast("int"))
    grams = rows.select("_row", "_own", *NAMES, F.explode_outer(ngrams()).alias("gram")).select("_row", "_own", *NAMES, bucket("gram").alias("bucket"))
    weight = F.when(F.col("_own") == 1, F.col("w1")).otherwise(F.col("w0"))
    scored = grams.join(weights, "bucket", "left").groupBy("_row", "_own", *NAMES).agg(F.avg(weight).alias("llr"))
    scored = stored(scored, "scored")
    step = F.floor(F.col("llr") / GRID)
    trusted = _judged(scored.where("_own = 1"), F.lit(float("-inf"))).where("kept").groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    found, need = trusted.orderBy("step").collect(), 0  # scores are bounded, and so are the steps
    for r in found:
        need += r["n"]
        if need > quantile * sum(x["n"] for x in found):
            return _judged(scored, F.lit(r["step"] * GRID))
    return _judged(scored, F.lit(float("inf")))
