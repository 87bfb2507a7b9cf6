"""The index of the Jaccard join: sketches, dealt lists, large groups of near copies, very long texts, rows without ids."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraquant.llm import jaccard
from terraquant.llm.text import shingle_sets

from .helpers import corpus, jaccard_classes


def without_ties(monkeypatch):
    monkeypatch.setattr(jaccard, "head_pairs", lambda reps, percent: reps.limit(0).select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))


def components(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}


def test_sketches_bound_differences_from_below():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(1, n + 2))).astype(np.uint64)]))
        differ = len(np.setxor1d(x, y))
        got = jaccard.sketch_distances([jaccard.sketch(x), jaccard.sketch(y)], np.array([0, 1]), np.array([1, 1]))
        assert got[0] <= differ and got[1] == 0
    x, y = np.arange(100, dtype=np.uint64), np.arange(100, 200, dtype=np.uint64)
    assert jaccard.sketch_distances([jaccard.sketch(x), jaccard.sketch(y)], np.array([0]), np.array([1]))[0] == 200


def test_linked_sizes_are_in_neighbouring_classes():
    for n in range(1, 4000):
        assert jaccard.size_class(-(-75 * n // 100), 75) >= jaccard.size_class(n, 75) - 1


@pytest.mark.parametrize(("limit", "partners"), [(3, 64), (8192, 1), (2, 0)])
def test_dealt_lists_lose_no_link(spark, monkeypatch, limit, partners):
    without_ties(monkeypatch)
    for name, value in (("FREQUENT_SETS", 2), ("LIST", limit), ("PARTNERS", partners)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed=30 + limit, groups=6)
    assert components(spark, rows) == jaccard_classes(rows)


def near_copies(rng, n, words=150):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.randrange(0, 14)):
            own[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("ties", [True, False])
def test_large_group_of_near_copies(spark, monkeypatch, ties):
    """2,000 texts that share most of their tokens: exact classes, and few candidates where groups were tied before."""
    if not ties:
        without_ties(monkeypatch)
    made = {}
    keep = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label="step": made.setdefault(label, keep(df, label)) if label == "pairs" else keep(df, label))
    rng = random.Random(11)
    rows = list(enumerate(near_copies(rng, 2000 if ties else 300)))
    off, val = shingle_sets(pa.array([t for _, t in rows]))
    names = np.unique(val)
    m = np.zeros((len(rows), len(names)), np.float32)
    m[np.repeat(np.arange(len(rows)), np.diff(off)), np.searchsorted(names, val)] = 1
    both, n = (m @ m.T).round().astype(np.int64), np.diff(off)
    links = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    want = np.arange(len(rows))
    while True:
        new = np.where(links, want[None, :], len(rows)).min(1)
        if (new == want).all():
            break
        want = new
    assert components(spark, rows) == dict(enumerate(want.tolist()))
    if ties:
        assert made["pairs"].count() <= 10 * len(rows)


def test_texts_of_a_hundred_thousand_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_SETS", 2)
    without_ties(monkeypatch)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    near, far = list(base), list(base)
    for k in range(0, len(base), 100):
        near[k] = "near"
    for k in range(0, len(base), 12):
        far[k] = "far"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "short one")]
    assert components(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_row_of_each_component_stays(spark):
    text = " ".join(map(str, range(40)))
    lone = " ".join(f"l{i}" for i in range(40))
    rows = [(None, lone), (None, lone + " tail"), (None, None), (None, ""), (None, text), (5, text), (5, text), (5, text + " tail"), (3, "something else"), (3, "something else"), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_gone", "_twice", "_all", "_id", "n", "c", "a b.c"):
        df = df.withColumn(c, F.lit(c))
    out = jaccard.keep_one_of_each(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted((x for x in got if x[0] is not None), key=str) == [(3, "something else"), (5, text), (8, None)]
    # rows without words stay all; of those that hang together without an id, the one with the smallest key's number
    nameless = [x[1] for x in got if x[0] is None]
    assert len(nameless) == 3 and {None, ""} < set(nameless) and (set(nameless) - {None, ""}) < {lone, lone + " tail"}
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_components(df.where("doc_id IS NULL OR doc_id = 5")).collect()}
    assert by[5, 36] == by[5, 37] == 5
    own = {r["component_id"] for r in jaccard.jaccard_components(df.where("doc_id IS NULL")).collect()}
    assert own == {None}
    assert jaccard.keep_one_of_each(df.limit(0)).count() == 0

