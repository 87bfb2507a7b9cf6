"""Host reputation against plain Python, and verdicts of hosts with and without outcomes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from terraquant.llm import rules, urls

DATA = "/root/testdata/sf0.001"


def site(host):
    return re.sub(r"\.*(:[0-9]*)?$", "", re.sub("^.*@", "", host), count=1)


def place(s):
    """(registered domain, suffix) of a site."""
    if re.fullmatch(r"\[.*|[0-9.]+", s):
        return s, ""
    parts = s.split(".")
    k = 2 if ".".join(parts[-2:]) in urls.SUFFIXES else 1
    return ".".join(parts[-k - 1 :]), ".".join(parts[-k:])


def brute(outcomes):
    """Posterior (n, bad, rate, strength) by site, domain, suffix, and the overall rate, in plain loops."""
    rows = [(site(h), b) for h, b in outcomes if h is not None and b is not None]
    overall = (sum(b for _, b in rows) + 1) / (len(rows) + 2)

    def level(key, parent):
        n, bad, up = {}, {}, {}
        for s, b in rows:
            k = key(s)
            n[k], bad[k], up[k] = n.get(k, 0) + 1, bad.get(k, 0) + b, parent(s)
        noise = sum(up[k] * (1 - up[k]) for k in n)
        inside = sum(up[k] * (1 - up[k]) * n[k] for k in n)
        spread = sum(n[k] * (bad[k] / n[k] - up[k]) ** 2 for k in n)
        share = max(0.0, min(1.0, (spread - noise) / max(inside - noise, 1e-9)))
        strength = max(urls.STRENGTH[0], min(urls.STRENGTH[1], 1 / max(share, 1e-9) - 1))
        return {k: (n[k], bad[k], (bad[k] + strength * up[k]) / (n[k] + strength)) for k in n}, strength

    suffix, s3 = level(lambda s: place(s)[1], lambda s: overall)
    domain, s2 = level(lambda s: place(s)[0], lambda s: suffix[place(s)[1]][2])
    own, s1 = level(lambda s: s, lambda s: domain[place(s)[0]][2])
    return own, domain, suffix, overall, (s1, s2, s3)


def bound(rate, pages):
    return max(0.0, rate - urls.Z * math.sqrt(rate * (1 - rate) / (pages + 1)))


def outcomes(seed):
    rng = random.Random(seed)
    out = [(None, 1), ("q.net", None), ("", 0), ("user@h.a.co.uk:80", 1), ("10.0.0.1", 1), ("10.0.0.2:8080", 0)]
    for _ in range(40):
        host = f"h{rng.randrange(3)}.d{rng.randrange(6)}.{rng.choice(['com', 'co.uk', 'example.com', 'net'])}"
        p = rng.choice([0.02, 0.9])
        out += [(host, int(rng.random() < p)) for _ in range(rng.randrange(1, 40))]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_equal_plain_loops(spark, seed):
    given = outcomes(seed)
    own, domain, suffix, overall, (s1, s2, s3) = brute(given)
    df = spark.createDataFrame(given, "host string, bad int")
    got = {r["host"]: r for r in urls.host_reputation(df).collect()}
    assert set(got) == set(own)
    for k, (n, bad, rate) in own.items():
        assert (got[k]["n"], got[k]["bad"]) == (n, bad)
        assert got[k]["rate"] == pytest.approx(rate, abs=1e-9) and got[k]["bound"] == pytest.approx(bound(rate, n + s1), abs=1e-9)
    fresh = ["new.d1.com", "new.d1.co.uk", "h0.other.net", "h0.other.example.com", "first.of.dev", *own]
    post = {r["site"]: r for r in urls.site_posteriors(spark.createDataFrame([(h,) for h in fresh], "site string"), df).collect()}
    assert len(post) == len(fresh)
    for h in fresh:
        d, x = place(h)
        if h in own:
            rate, weight = own[h][2], own[h][0] + s1
        elif d in domain:
            rate, weight = domain[d][2], s1
        elif x in suffix:
            rate, weight = suffix[x][2], min(s1, s2)
        else:
            rate, weight = overall, min(s1, s2, s3)
        assert post[h]["bad_rate"] == pytest.approx(rate, abs=1e-9) and post[h]["bad_bound"] == pytest.approx(bound(rate, weight), abs=1e-9)


def test_hosts_without_outcomes_follow_their_domain(spark):
    rows = [(f"h{k}.bad.com", 1) for k in range(30) for _ in range(20)] + [(f"h{k}.good{k}.com", 0) for k in range(60) for _ in range(20)]
    pages = spark.createDataFrame([(1, "http://fresh.bad.com/"), (2, "http://fresh.good1.com/"), (3, "http://unseen.com/"), (4, "http://h1.bad.com:8080/x"), (5, None), (5, None), (None, "x")], "page_id long, url string").withColumn("site", F.lit("own")).withColumn("bad_rate", F.lit("own"))
    got = urls.judge_urls(pages, spark.createDataFrame(rows, "host string, bad int"), rules=()).collect()
    verdict = {r["page_id"]: r["verdict"] for r in got if r["page_id"]}
    assert len(got) == 7 and verdict == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}
    empty = urls.judge_urls(pages, spark.createDataFrame([], "host string, bad int")).collect()
    assert {(r["verdict"], r["bad_rate"]) for r in empty} == {("allow", None)}


def test_sites_domains_and_suffixes(spark):
    want = {"A.b.co.uk": ("A.b.co.uk", "b.co.uk", "co.uk"), "u:p@x.y.net:80": ("x.y.net", "y.net", "net"), "x.net.": ("x.net", "x.net", "net"), "127.0.0.1:80": ("127.0.0.1", "127.0.0.1", ""), "[::1]:80": ("[::1]", "[::1]", ""), "localhost": ("localhost", "localhost", "localhost"), "": ("", "", ""), "m.shop.example.com": ("m.shop.example.com", "shop.example.com", "example.com")}
    df = spark.createDataFrame([(h,) for h in want], "h string").withColumn("s", urls.site_of(F.col("h")))
    got = {r["h"]: (r["s"], r["d"], r["x"]) for r in df.withColumn("d", urls.domain_of(F.col("s"))).withColumn("x", urls.suffix_of(F.col("s"))).collect()}
    assert got == want


def test_classifier_labels_pages(spark):
    """Outcomes by the quality classifier of the visible text; a host of junk is blocked, others are not."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fit_rules(*rules.training_rows(docs, labels))
    good = [r["text"] for r in docs.join(labels, "doc_id").where("quality = 1").limit(30).collect()]
    junk = [r["text"] for r in docs.join(labels, "doc_id").where("quality = 0").limit(30).collect()]
    assert len(good) > 10 and len(junk) > 10
    body = lambda t: "<html><head><title>x</title></head><p>" + t.replace("<", " ").replace("&", " ") + "</p></html>"
    rows = [(f"http://g{i % 3}.fine.net/", body(good[i % len(good)])) for i in range(60)] + [("http://bad.junk.org/", body(junk[i % len(junk)])) for i in range(60)] + [("http://e.fine.net/", None), (None, "<p></p>")]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = urls.judge_urls(pages, urls.page_outcomes(pages, model), rules=()).collect()
    verdict = {r["host"]: r["verdict"] for r in got}
    assert verdict == {"g0.fine.net": "allow", "g1.fine.net": "allow", "g2.fine.net": "allow", "bad.junk.org": "block", "e.fine.net": "allow", "": "allow"}
