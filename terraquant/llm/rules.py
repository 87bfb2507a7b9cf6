"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Text statistics are plain columns. Shallow boosted trees are grown on a bounded sample of labelled rows;
every path from a root becomes a rule, a conjunction of thresholds; lasso logistic regression gives each rule
a weight, mostly zero. What is left is one arithmetic expression over the statistics, so all documents are
scored in a single scan without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquant.llm.text import count_in, solid_length, words

#: Most labelled rows that are learnt from (taken in order of a hash of their id).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK = 24, 3, 48, 0.3
L1 = 0.001
STEPS = 1500
#: Documents with a score from here on are predicted to be good.
CUT = 0.3
FEATURES = ("log_words", "mean_word", "symbol_share", "upper_share", "shout_share", "digit_share", "distinct_share", "echo_share", "line_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_most, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def matches(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, at_most, t in self.terms:
            out &= (x[:, f] <= t) if at_most else (x[:, f] > t)
        return out

    def column(self) -> Column:
        out = None
        for f, at_most, t in self.terms:
            c = F.col(FEATURES[f]) <= F.lit(t) if at_most else F.col(FEATURES[f]) > F.lit(t)
            out = c if out is None else out & c
        return out


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.matches(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """Score of a row that has the feature columns."""
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z = z + F.when(r.column(), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def with_features(docs: DataFrame) -> DataFrame:
    """docs with the FEATURES added as doubles; null and empty texts have zeros."""
    t = F.col("_text")
    w = F.col("_words")
    n = F.size(w)
    length = F.greatest(F.length(t), F.lit(1))
    per_word = F.greatest(n, F.lit(1))

    def share_of(chars: str) -> Column:
        return count_in(t, chars) / length

    base = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", words(F.col("text")))
    echo = F.size(F.filter(F.zip_with(w, F.slice(w, F.lit(2), per_word), lambda a, b: a == b), lambda x: x))
    columns = {
        "log_words": F.log1p(n.cast("double")),
        "mean_word": solid_length(t) / per_word,
        "symbol_share": share_of("#*$%&|<>"),
        "upper_share": share_of(r"\p{Lu}"),
        "shout_share": share_of("!?"),
        "digit_share": share_of("0-9"),
        "distinct_share": F.size(F.array_distinct(w)) / per_word,
        "echo_share": echo / per_word,
        "line_words": n / (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1),
    }
    return base.select(*(F.col(f"`{c}`") for c in docs.columns), *(columns[k].cast("double").alias(k) for k in FEATURES))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, rng: np.random.Generator) -> tuple[list[tuple], np.ndarray]:
    """One regression tree on gradients: its paths (all nodes below the root) and its prediction of every row."""
    paths: list[tuple] = []
    out = np.zeros(len(x))
    stack = [(np.arange(len(x)), ())]
    while stack:
        rows, terms = stack.pop()
        if terms:
            paths.append(terms)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(terms) < DEPTH and len(rows) >= 20:
            for f in rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]:
                if not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                cg = np.bincount(codes[rows, f], g[rows], size).cumsum()[:-1]
                ch = np.bincount(codes[rows, f], h[rows], size).cumsum()[:-1]
                cn = np.bincount(codes[rows, f], minlength=size).cumsum()[:-1]
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                gain[(cn < 5) | (len(rows) - cn < 5)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (int(f), k))
        if best[1] is None:
            out[rows] = -total_g / (total_h + 1)
            continue
        f, k = best[1]
        left = codes[rows, f] <= k
        stack.append((rows[left], (*terms, (f, True, float(cuts[f][k])))))
        stack.append((rows[~left], (*terms, (f, False, float(cuts[f][k])))))
    return paths, out


def _lasso(z: np.ndarray, y: np.ndarray, l1: float) -> tuple[float, np.ndarray]:
    """Logistic lasso by accelerated proximal gradient; the intercept is not penalised."""
    n, p = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    step = 4.0 / max(np.linalg.eigvalsh(a.T @ a / n)[-1], 1e-9)
    w = v = np.zeros(p + 1)
    t = 1.0
    for _ in range(STEPS):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * l1, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            w = new
            break
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, l1: float = L1, seed: int = 7) -> RuleEnsemble:
    """Rule ensemble of features x and labels y (0/1). Without rows every score is 0.5; with one class, near that class."""
    if not len(y):
        return RuleEnsemble()
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleEnsemble(float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(q[q < x[:, f].max()])
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    z = np.full(len(y), np.log(prior / (1 - prior)))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        own, step = _grow(x, p - y, p * (1 - p), cuts, codes, rng)
        z += SHRINK * step
        paths |= dict.fromkeys(tuple(sorted(t)) for t in own)
    rules = [Rule(t) for t in paths]
    m = np.stack([r.matches(x) for r in rules], 1).astype(np.float64)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold on the same rows say the same
    first = np.sort(first)
    b, w = _lasso(m[:, first], y.astype(np.float64), l1)
    return RuleEnsemble(b, [Rule(rules[i].terms, float(c)) for i, c in zip(first, w) if abs(c) > 1e-9])


def held_out(doc_id: Column) -> Column:
    """Every fifth id by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most rows labelled documents that are not held out. Of contradicting labels the least counts."""
    order = F.xxhash64(F.col("_id"))
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label")).orderBy(order, "_id").limit(rows)
    # at most `rows` ids: small enough to broadcast whatever the input
    part = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    got = with_features(part).select("_id", "_label", *FEATURES).orderBy(order, *FEATURES).limit(rows).toArrow()
    x = np.stack([got.column(k).to_numpy() for k in FEATURES], 1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return x, got.column("_label").to_numpy().astype(np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """docs (all columns but clashing ones) with held_out, score and predicted added, for every row.

    Only text enters a score. Null and empty texts are scored as texts without words. Repeated rows get equal
    scores; without labels every score is 0.5. Columns of docs named like a result or feature are replaced.
    """
    taken = {*FEATURES, "held_out", "score", "predicted", "_text", "_words"}
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
    model = fit_rules(*training_rows(docs, labels, label, rows))
    out = with_features(kept).withColumn("score", model.column())
    return out.select(*(F.col(f"`{c}`") for c in kept.columns), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns, whatever they are called.

    Null and empty texts are judged as texts without words; repeated rows and null ids each like any other row. Without
    labels every score is 0.5, so all rows stay; an empty table gives an empty result.
    """
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_packed"))
    good = score_quality(packed, labels, **options).where("predicted = 1")
    return good.select(*(F.col("_packed").getField(c).alias(c) for c in docs.columns))
