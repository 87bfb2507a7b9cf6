"""Jaccard join, line dedup, quality classifier, likelihood rules, pipeline."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraquant.llm import jaccard, likelihood, lines, queries, rules
from terraquant.llm.text import shingle_sets, word_hashes

from .helpers import base_rules, classes, corpus, jaccard_classes, sentence, shingles, words

DATA = "/root/testdata/sf0.001"


# -- shingles


def test_shingle_kernel_counts_distinct_sets():
    texts = [t for _, t in corpus()] + ["x" * 5000 + " " + "X" * 5000, "x" * 5000 + " " + "x" * 4999 + "y"]
    off, val = shingle_sets(pa.array(texts))
    keys = {}
    for i, t in enumerate(texts):
        s = frozenset(shingles(t))
        own = tuple(val[off[i] : off[i + 1]].tolist())
        assert len(own) == len(s) == len(set(own)) and list(own) == sorted(own)
        assert keys.setdefault(s, own) == own
    assert len(set(keys.values())) == len(keys)
    sliced = pa.array(["a b", *texts]).slice(1)
    assert (shingle_sets(sliced)[1] == val).all()
    assert len(word_hashes(pa.array([], pa.string()))[0]) == 0


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(3, 90))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 4))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(x) == both == len(y) or 100 * both < 75 * (len(x) + len(y) - both):
            continue
        often = np.unique(np.concatenate([x, y]))[rng.random(len(np.union1d(x, y))) < rng.choice([0, 0.3, 0.9, 1.0])]
        (r1, o1), (r2, o2) = jaccard.prefix(x, often), jaccard.prefix(y, often)
        assert len(np.intersect1d(r1, r2)) >= 1 or len(np.intersect1d(o1, o2)) >= 2


def joined(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df, jaccard.jaccard_components(df, **extra).collect()


@pytest.mark.parametrize("frequent", [24, 2])
def test_join_equals_all_pairs(spark, monkeypatch, frequent):
    # the lower bound makes nearly all tokens frequent, so that combinations do the work
    monkeypatch.setattr(jaccard, "FREQUENT_SETS", frequent)
    rows = corpus(seed=frequent)
    _, got = joined(spark, rows)
    want = jaccard_classes(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((i, len(shingles(t)), want[i]) for i, t in rows)


def test_join_without_head_pairs_is_complete(spark, monkeypatch):
    """The prefix index alone finds every link between groups."""
    monkeypatch.setattr(jaccard, "head_pairs", lambda reps, percent: reps.limit(0).select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))
    for frequent in (24, 2):
        monkeypatch.setattr(jaccard, "FREQUENT_SETS", frequent)
        rows = corpus(seed=9, groups=5)
        _, got = joined(spark, rows)
        want = jaccard_classes(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_join_of_awkward_rows(spark):
    text = " ".join(map(str, range(40)))
    near = text + " tail"
    rows = [(7, text), (7, text), (3, near), (None, text), (None, "alone and without an id here"), (9, None), (9, None), (4, text), (4, "another text of the same document id entirely"), (2, "another text of the same document id entirely"), (11, "")]
    _, got = joined(spark, rows)
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[7, 36] == by[3, 37] == by[4, 36] == by[4, 4] == by[2, 4] == 2
    assert by[None, 36] == 2 and by[None, 2] is None and by[9, 0] == 9 and by[11, 0] == 11
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard.keep_one_of_each(df.withColumn("component_id", F.lit("own")).withColumn("n", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "component_id", "n"]
    assert {r["doc_id"] for r in kept.collect()} == {2, 9, 11, None}


def test_cross_pairs_of_long_runs():
    rng = np.random.default_rng(0)
    n = 700
    token, doc, size, group = np.zeros(n, np.int64), np.arange(n), rng.integers(50, 100, n), rng.integers(0, 400, n)
    got = {(a, b) for x, y, _ in jaccard.cross_pairs(token, doc, size, group, size) for a, b in zip(x.tolist(), y.tolist())}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if group[i] != group[j] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j])}
    assert got == want


# -- lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def test_banded_distance_equals_levenshtein(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        a = [rng.choice("abé") for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            k, op = rng.randrange(len(b) + 1), rng.randrange(3)
            b[k : k + (op > 0)] = [] if op == 1 else [rng.choice("abé")]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        assert df.where(lines.within(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0


@pytest.mark.parametrize("crowded", [64, 2])
def test_line_classes_equal_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(lines, "CROWDED", crowded)
    rng = random.Random(5)
    pool = ["a shared line that many texts hold", "short", "  padded line of some length\t", ""]
    for _ in range(30):
        base = sentence(rng, rng.randrange(3, 9), 50)
        pool += [base, base[:7] + "#" + base[7:], base[:-1], base[:3] + "q" + base[4:], "a shared line that many texts holds" + str(rng.randrange(9))]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(70, None), (71, ""), (None, pool[0]), (5, "one more")]
    strip = " \t\n\x0b\x0c\r"
    own = {}
    for i, t in docs:
        own.setdefault(i, []).extend(x for x in (y.strip(strip) for y in (t or "").split("\n")) if x)
    all_lines = sorted({x for v in own.values() for x in v})
    cls = classes([(a, b) for a, b in itertools.combinations(all_lines, 2) if min(len(a), len(b)) >= 16 and one_edit(a, b)], all_lines)
    size = {}
    for x in all_lines:
        size[cls[x]] = size.get(cls[x], 0) + 1
    first = {}
    for i in sorted(own, key=lambda v: (v is None, v or 0)):
        for x in own[i]:
            first.setdefault(cls[x], i)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        v = own[r["doc_id"]]
        kept = len({cls[x] for x in v if first[cls[x]] == r["doc_id"]})
        assert (r["n_lines"], r["n_removed"], r["n_near"]) == (len(v), len(v) - kept, sum(size[cls[x]] > 1 for x in v)), r
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("crowded", [64, 2])
def test_similar_lines_equal_all_pairs(spark, monkeypatch, crowded):
    """Short lines with any edits, long ones with changed words and dates, and one without spaces."""
    monkeypatch.setattr(lines, "CROWDED", crowded)
    rng = random.Random(8)
    pool = ["Les.", "Let.", "release 9", "release 8", "Copyright 2019 by the authors of it", "Copyright 2021 by the authors of it", "x" * 30 + "".join(map(str, range(60))), "x" * 30 + "".join(map(str, range(59))) + "ab"]
    for k in range(24):
        base = sentence(rng, 3 + k if k < 9 else rng.randrange(12, 90))
        pool.append(base)
        for _ in range(3):
            w = list(base.split())
            if len(base) < lines.SHORT:
                w = list(base)
                for _ in range(rng.randrange(1, 2 + len(base) * 15 // 100)):
                    at = rng.randrange(len(w))
                    w[at : at + rng.randrange(2)] = rng.choice(["", "é", "7"])
                pool.append("".join(w).strip())
            else:
                for at in {rng.randrange(len(w)) for _ in range(1 + len(w) // 16)}:
                    w[at] = f"n{rng.randrange(99)}"
                pool.append(" ".join(w))
    pool = sorted(set(pool))
    docs = [(i, "\n".join(pool[i::9])) for i in range(9)]
    links = [(a, b) for a, b in itertools.combinations(pool, 2) if abs(len(a) - len(b)) <= max(len(a), len(b)) * 15 // 100 and edits(a, b) <= max(len(a), len(b)) * 15 // 100]
    assert len(links) > 80
    df = spark.createDataFrame(docs, "doc_id long, text string")
    name = {r["h"]: r["line"] for r in lines.document_lines(df).collect()}
    got = [(name[r["a"]], name[r["b"]]) for r in lines.similar_links(df).collect()]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in links}
    assert classes(got, pool) == classes(links, pool)
    assert sum(r["n_near"] for r in lines.dedup_lines(df, share=15).collect()) == len({x for p in links for x in p})
    assert lines.similar_links(df.limit(0)).count() == 0


def test_texts_are_rebuilt_from_kept_lines(spark):
    near, nearer = "the same sentence with one word in it", "the same sentence with one ward in it"
    rows = [(2, f"{near}\nonly here\n\n  {nearer} "), (1, f"first\n{nearer}\nfirst\n"), (3, near), (3, f"new\n{near}"), (None, "new\nlast"), (4, None), (5, ""), (1, "first")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    got = {r["n"]: r for r in lines.dedup_texts(df, share=15).collect()}
    assert [got[n]["text"] for n in range(len(rows))] == ["only here\n", f"first\n{nearer}\n", "", "new", "last", None, "", ""]
    assert [[x["pos"] for x in got[n]["removed"]] for n in range(len(rows))] == [[0, 3], [2], [0], [1], [0], [], [], [0]]
    assert len({x["class_id"] for n in (0, 2) for x in got[n]["removed"]}) == 1
    assert lines.dedup_texts(df.limit(0)).count() == 0
    flags = lines.line_flags(df, share=15).collect()
    assert sum(r["keep"] for r in flags) == len({r["class_id"] for r in flags}) == 5


# -- quality classifier


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(rules.FEATURES)))
    y = ((x[:, 2] > 0.3) & (x[:, 5] < 0.5) | (x[:, 0] > 1.2)).astype(int)
    model = rules.fit_rules(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in rules.FEATURES))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(got, model.score(x[:50]))
    assert rules.fit_rules(x[:0], y[:0]).score(x[:1])[0] == 0.5
    assert rules.fit_rules(x, np.ones(600)).score(x[:1])[0] > 0.9


def test_classifier_learns_and_handles_awkward_rows(spark):
    docs, labels = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    odd = spark.createDataFrame([(None, "a null id"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "x " * 50_000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("own")).withColumn("echo_share", F.lit(1))
    got = rules.score_quality(df, labels).toPandas()
    assert len(got) == docs.count() + 4 and got["score"].between(0, 1).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    test = known[known["held_out"]]
    assert ((test["predicted"] == test["quality"]).mean()) > 0.95
    assert all(bool(h) == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i, h in zip(known["doc_id"], known["held_out"]))
    assert (got["predicted"] == (got["score"] >= 0.3).astype(int)).all()
    assert rules.score_quality(df.limit(3), labels.limit(0)).select("score").distinct().first()[0] == 0.5
    assert rules.score_quality(df.limit(0), labels).count() == 0


# -- likelihood rules


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [t for _, t in corpus()] + ["a a a a a", "x y z x y z\nx y z\n\n \nx y z", "#*$%&|<> é", "a b a b a b c", "L1 a\nL1 a\nL1 a \n", sentence(rng, 5000, 30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (3,)], "doc_id long")
    got = likelihood.quality_rules(df, target).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    own = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=key)
    assert own == sorted(((i, *base_rules(t)) for i, t in rows), key=key)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= likelihood.THRESHOLD)
    assert likelihood.quality_rules(df.limit(0), target).count() == 0
    assert likelihood.quality_rules(df, target.limit(0)).count() == len(rows)


def test_likelihood_ratio_equals_brute_force(spark):
    """A text's llr is the mean log ratio of its n-grams, hashed as Spark hashes them."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d e", "x y", "x x x y", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["llr"] for r in likelihood.quality_rules(df, df.where("doc_id < 2").select("doc_id")).collect()}
    grams = {i: [*w, *zip(w, w[1:])] for i, t in rows for w in [words(t)]}
    count = lambda ids, g: sum(x == g for i in ids for x in grams[i])
    total = lambda ids: sum(len(grams[i]) for i in ids)
    b, raw, target = likelihood.BUCKETS, range(5), range(2)
    for i, own in grams.items():
        if own:
            llr = np.mean([np.log((count(target, g) + 1) / (total(target) + b)) - np.log((count(raw, g) + 1) / (total(raw) + b)) for g in own])
            assert got[i] == pytest.approx(llr)
    assert got[4] is None


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_verdicts_do_not_depend_on_the_size(spark, size):
    where = DATA.replace("0.001", size)
    rated = queries.op4_rate_likelihood(spark, where).where("NOT base_failed").join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id", "left")
    lost = {r["quality"]: r["lost"] for r in rated.groupBy("quality").agg(F.avg(F.when(F.col("kept"), 0).otherwise(1)).alias("lost")).collect()}
    assert lost[1] <= 0.02 and lost[None] < 0.15 and lost.get(0, 1) > 0.5


def test_relative_ratio_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d e", "x y", "x x x y", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["llr"] for r in likelihood.relative_rules(df, df.where("doc_id < 2").select("doc_id")).collect()}
    grams = {i: [*w, *zip(w, w[1:])] for i, t in rows for w in [words(t)]}
    every, trusted = [g for v in grams.values() for g in v], [g for i in range(2) for g in grams[i]]
    s, b = likelihood.SHARE, likelihood.BUCKETS
    rate = lambda g, of, own: (of.count(g) - own + s * len(of) / b) / (len(of) * (1 + s) - own)
    for i, own in grams.items():
        if own:
            assert got[i] == pytest.approx(np.mean([np.log(rate(g, trusted, int(i < 2)) / rate(g, every, 1)) for g in own]))
    assert got[4] is None
    assert likelihood.relative_rules(df, df.limit(0).select("doc_id")).where("kept OR llr IS NOT NULL").count() == 0
    assert likelihood.relative_rules(df.limit(0), df.select("doc_id")).count() == 0


# -- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in rules.score_quality(docs, labels).where("predicted = 1").collect()}
    comp = jaccard_classes([(i, text[i]) for i in good])
    one = {i for i in good if comp[i] == i}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i in one if not any(s and len(s & shingles(text[i])) >= 0.75 * len(s) for s in items)}
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert {"shard", "slot", *docs.columns} == set(out.columns)
    assert set(out["doc_id"]) <= clean and out["doc_id"].value_counts().max() <= 2
    from terraquant.llm import mixing

    plan = mixing.mix(docs.where(F.col("doc_id").isin(sorted(clean)))).toPandas()
    want = {r.doc_id: int(np.ceil(r.taken / r.size)) for r in plan.itertuples() if r.taken > 0}
    assert out["doc_id"].value_counts().to_dict() == want
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_all_queries_are_registered(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert queries.op9_assign_shards(spark, DATA).count() == 200
