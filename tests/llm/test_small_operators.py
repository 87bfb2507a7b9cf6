"""Sharding, mixing, URL rules, decontamination, token counts, packing: edge cases and brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraquant.llm import bpe, decontam, maglev, mixing, packing, urls
from terraquant.llm.queries import tokenizer_path

from .helpers import corpus, sentence, shingles, words


# -- sharding


def test_table_is_balanced_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    table = maglev.lookup_table(names, 2003)
    n = Counter(table)
    assert set(n) == set(range(20)) and max(n.values()) - min(n.values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.2 * 2003
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            maglev.lookup_table(*bad)


def test_shards_of_awkward_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (7, None)], "doc_id long, Shard string")
    rows = maglev.assign_shards(df, n_shards=3, size=11).collect()
    assert len(rows) == 4 and all(0 <= r["shard"] < 3 for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert maglev.assign_shards(df.limit(0)).count() == 0
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    maglev.write_shards(docs, str(tmp_path / "out"), n_shards=4, files_per_shard=2, size=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


# -- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, spare = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    for _ in range(200):
        open_ = [s for s in names if target[s] < epochs * sizes[s] - 1e-9]
        if spare < 1e-9 or not open_:
            break
        total, rest = sum(w[s] for s in open_), 0.0
        for s in open_:
            target[s] += spare * w[s] / total
            rest += max(0.0, target[s] - epochs * sizes[s])
            target[s] = min(target[s], epochs * sizes[s])
        spare = rest
    return target


def test_mix_meets_budgets(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"])) for i in range(400)]
    rows += [(None, "x y", "a"), (1, rows[1][1], rows[1][2]), (900, None, "b"), (901, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_rows=16).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(sizes.values()) == sum(len(words(t)) for _, t, _ in rows)
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
    again = mixing.mix(df.repartition(5), block_rows=1000).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df.withColumn("size", F.lit("own")))
    assert kept.columns == ["doc_id", "text", "source", "size"] and 0 < kept.count()


# -- URL rules


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_url_rules(spark):
    given = ["http://Spam.Example.ORG/es/7?x=1", "https://example.org/en/12#t", "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/fr", "http://com/de/x", "http://x.com/de/?q", "ftp://h?/en/", "http://h#/x", "://", "no url", "", None, "http://a.org", "http://ÀB.org/É", "a://b://c/d", "http://u.net:80/x"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, urls.page_outcomes(pages)).collect()}
    for i, u in enumerate(given):
        host, path, rule, verdict = brute_rule(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or "allow")
    assert urls.judge_urls(pages.limit(0), urls.page_outcomes(pages.limit(0))).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [("good.a.net", 0)] * 200 + [("bad.b.net", 1)] * 60 + [("x.b.net", 1)] * 60 + [("new.b.net", 1), ("new.a.net", 1), ("ok.c.net", 0), (None, 1), ("q.c.net", None)]
    rep = {r["host"]: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert set(rep) == {"good.a.net", "bad.b.net", "x.b.net", "new.b.net", "new.a.net", "ok.c.net"}
    assert rep["bad.b.net"]["bound"] > 0.8 and rep["good.a.net"]["rate"] < 0.05
    assert rep["new.a.net"]["rate"] < rep["new.b.net"]["rate"]  # one bad page counts less beside a good domain
    pages = spark.createDataFrame([(1, "http://bad.b.net/x"), (2, "http://good.a.net/"), (3, "http://other.net/")], "page_id long, url string")
    verdict = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert verdict == {1: "block", 2: "allow", 3: "allow"}


def test_junk_pages(spark):
    body = lambda t: f"<html><head><title>A*B*C*</title><script>var x='***'</script></head><body><p>{t}</p></body></html>"
    pages = [body("plain words here"), body("AB*** CD### EF$$$"), body("ALL CAPS SHOUTED OUT"), body("word " * 40), body(""), None]
    df = spark.createDataFrame([(f"http://h{i}.net/", p) for i, p in enumerate(pages)], "url string, html string")
    got = {r["host"]: r["bad"] for r in urls.page_outcomes(df).collect()}
    assert [got[f"h{i}.net"] for i in range(6)] == [0, 1, 1, 1, None, None]


# -- decontamination


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, n)) for i, n in enumerate((3, 4, 5, 6, 9, 15, 33, 64, 65, 120))] + [(90, ""), (91, None), (92, "  ")]
    docs = []
    for i, (_, t) in enumerate(items):
        w = words(t)
        for cut in (0, len(w) // 8, len(w) // 5, len(w) // 3):
            docs.append((len(docs), sentence(rng, 300) + " " + " ".join(w[cut:]).upper() + "\n" + sentence(rng, 100)))
    docs += [(500, None), (501, ""), (502, sentence(rng, 9000)), (None, items[6][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, [1], "y") for i, t in docs], "doc_id long, text string, item_ids array<int>, Containment string")
    sets = {i: shingles(t) for i, t in items}
    want = []
    for d, t in docs:
        w = words((t or "").lower())
        grams = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        hit = []
        for i, s in sets.items():
            n = len(next(iter(s))) if s else 0
            share = len(s & grams[n]) / len(s) if s else 0
            if s and share >= 0.75:
                hit.append((i, share))
        want.append((d, sorted(i for i, _ in hit), round(max([c for _, c in hit], default=0.0), 9)))
    for block in (20_000, 3):
        decontam.BLOCK_ITEMS = block
        got = decontam.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        key = lambda x: (x[0] is None, x[0] or 0)
        assert sorted([(r["doc_id"], list(r["item_ids"]), round(r["containment"], 9)) for r in got], key=key) == sorted(want, key=key)
        assert all(r["contaminated"] == bool(r["item_ids"]) for r in got)
    decontam.BLOCK_ITEMS = 20_000
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(df, none).where("contaminated").count() == 0


# -- token counts and packing

TEXTS = ["", None, "Hello world's  end", "a\n\n b \t c\u00a0d\u2003e ", "<|endoftext|>", "x!!<|endoftext|>  y", "é日本語 123abc½Ⅷ", "don't WE'LL 'sx \x1c\x85 z", "   ", "word " * 3000, "😀👍🏽 a\u0301", "\r\n\x0b\x0c"]


def test_token_counts_equal_the_tokenizer(spark):
    tok = bpe.tokenizer(tokenizer_path())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])] + [(100 + i, t) for i, (_, t) in enumerate(corpus())]
    got = bpe.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), limit=100).collect()
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    want = sorted((i if i is not None else -1, len((t or "").encode()), count(t), count(t) > 100) for i, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert bpe.count_tokens(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_capacity_tree_and_packing_rule():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 65) for _ in range(300)]
    rows = packing.best_fit_decreasing(lengths, 64)
    assert sorted(i for r in rows for i in r) == list(range(300))
    assert all(sum(lengths[i] for i in r) <= 64 for r in rows)
    free, expected = [], []
    for i in sorted(range(300), key=lambda j: -lengths[j]):
        fit = [k for k, f in enumerate(free) if f >= lengths[i]]
        if fit:
            k = min(fit, key=lambda k: free[k])
            free[k] -= lengths[i]
        else:
            free.append(64 - lengths[i])
    expected = sorted(free)
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == expected
    for bad in ([0], [65]):
        with pytest.raises(ValueError):
            packing.best_fit_decreasing(bad, 64)


def test_packed_rows_give_back_every_document(spark, tmp_path):
    tok = bpe.tokenizer(tokenizer_path())
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50 + i, t) for i, (_, t) in enumerate(corpus(groups=3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(df, tokenizer_path(), row_tokens=256, group_tokens=4000)
    packing.write_binary(packed, str(tmp_path))
    parts = defaultdict(dict)
    ids = set()
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        assert r["pack_id"] not in ids
        ids.add(r["pack_id"])
        matrix, position, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(matrix) == len(position) == 256 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 256
        assert (matrix[cu[-1] :] == packing.PAD).all()
        for d, k, a, b in zip(r["doc_ids"], r["piece_numbers"], cu, cu[1:]):
            parts[d][k] = matrix[a:b].tolist()
            assert position[a:b].tolist() == list(range(b - a))
    for d, t in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert [x for k in sorted(parts[d]) for x in parts[d][k]] == want
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0
