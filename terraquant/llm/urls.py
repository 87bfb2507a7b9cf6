"""URL filtering: longest-match allow and block rules, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are pooled by suffix, registered domain and host. Each level's bad
rate gets a beta prior centred on its parent's posterior mean; the prior's strength is estimated from the
spread between siblings (beta-binomial moments), so a host with few pages leans on its domain, and a
domain on its suffix. A host is blocked when the lower posterior bound of its bad rate reaches a threshold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraquant.llm.rules import CUT, RuleEnsemble, with_features
from terraquant.llm.text import count_in, words
from terraquant.session import stored

#: The production rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked when its bad rate is at least THRESHOLD with about 95 % posterior probability.
THRESHOLD = 0.3
Z = 1.645
# Suffixes of two labels under which names are registered; the last three are the test tables' hosting domains.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn",
    "com.tw", "com.hk", "com.sg", "com.mx", "com.ar", "com.tr", "co.in", "co.id", "co.il", "co.za",
    "example.com", "example.net", "example.org",
)
#: Bounds of an estimated prior strength, in pages.
STRENGTH = (2.0, 1000.0)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; the rule table is code, so this is one CASE. The first of equal rules wins."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + rest))
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def site_of(host: Column) -> Column:
    """The host that reputations are kept by: without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[0-9]*)?$", "")


def _address(site: Column) -> Column:
    return site.rlike(r"^(\[.*|[0-9.]+)$")


def suffix_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """What names are registered under: the last two labels where listed, else the last; empty for addresses."""
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Registered domain: one label below the suffix; an address is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(_address(site), site).when(two.isin(*suffixes), F.substring_index(site, ".", -3)).otherwise(two)


def _level(children: DataFrame, child: str) -> DataFrame:
    """Posterior mean (rate) and prior strength of each child, given its n, bad and its parent's mean prior."""
    p = F.col("prior")
    w = children.agg(
        F.sum("n").alias("n_all"), F.count("*").alias("k"), F.sum(p * (1 - p) * F.col("n")).alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("spread"), F.sum(p * (1 - p)).alias("noise"),
    )
    # E[spread] = noise + (between-sibling share) * (inside - noise)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("spread") - F.col("noise")) / F.greatest(F.col("inside") - F.col("noise"), F.lit(1e-9))))
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), 1 / F.greatest(share, F.lit(1e-9)) - 1))
    out = children.crossJoin(F.broadcast(w.select(strength.alias("strength"))))  # one row
    return out.withColumn("rate", (F.col("bad") + F.col("strength") * p) / (F.col("n") + F.col("strength")))


def _bound(rate: Column, pages: Column) -> Column:
    """Lower posterior bound of a bad rate whose prior and outcomes weigh as many pages."""
    return F.greatest(F.lit(0.0), rate - Z * F.sqrt(rate * (1 - rate) / (pages + 1)))


def reputation_levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior (key, n, bad, rate, strength) of sites, domains and suffixes, and the overall rate in one row."""
    site = outcomes.where("bad IS NOT NULL AND host IS NOT NULL").groupBy(site_of(F.col("host")).alias("site")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    site = stored(site.withColumn("domain", domain_of(F.col("site"))).withColumn("suffix", suffix_of(F.col("site"))), "sites")
    domain = stored(site.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffix = stored(domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = stored(suffix.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior")).where("prior IS NOT NULL"), "overall")
    suffix = stored(_level(suffix.crossJoin(F.broadcast(overall)), "suffix"), "suffix-rates")  # one row
    domain = stored(_level(domain.join(suffix.select("suffix", F.col("rate").alias("prior")), "suffix"), "domain"), "domain-rates")
    site = stored(_level(site.join(domain.select("domain", F.col("rate").alias("prior")), "domain"), "site"), "site-rates")
    return site, domain, suffix, overall


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) from outcomes (host, bad 0/1), by site_of the hosts. Null outcomes do not count; without any, the result is empty."""
    site, *_ = reputation_levels(outcomes)
    return site.select(F.col("site").alias("host"), "n", "bad", "rate", _bound(F.col("rate"), F.col("n") + F.col("strength")).alias("bound"))


def site_posteriors(sites: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(site, bad_rate, bad_bound) of every site (distinct).

    One without outcomes has the posterior of its domain, else its suffix, else all sites, less certain by the levels between; null without any outcome.
    """
    site, domain, suffix, overall = reputation_levels(outcomes)
    # one row: the strengths of the levels
    ones = overall
    for name, level in (("s1", site), ("s2", domain), ("s3", suffix)):
        ones = ones.crossJoin(F.broadcast(level.agg(F.max("strength").alias(name))))
    named = sites.select("site", domain_of(F.col("site")).alias("domain"), suffix_of(F.col("site")).alias("suffix"))
    named = named.join(site.select("site", F.col("rate").alias("r1"), (F.col("n") + F.col("strength")).alias("t1")), "site", "left")
    named = named.join(domain.select("domain", F.col("rate").alias("r2")), "domain", "left").join(suffix.select("suffix", F.col("rate").alias("r3")), "suffix", "left")
    named = named.join(F.broadcast(ones), F.lit(True), "left")
    rate = F.coalesce("r1", "r2", "r3", "prior")
    weight = F.coalesce("t1", F.when(F.col("r2").isNotNull(), F.col("s1")), F.when(F.col("r3").isNotNull(), F.least("s1", "s2")), F.least("s1", "s2", "s3"))
    return named.select("site", rate.alias("bad_rate"), _bound(rate, weight).alias("bad_bound"))


def visible_text(html: Column) -> Column:
    """Text of a page without markup, scripts, styles, head and navigation."""
    hidden = r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"
    return F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), hidden, " "))


def page_outcomes(pages: DataFrame, model: RuleEnsemble | None = None, cut: float = CUT) -> DataFrame:
    """(host, bad): outcome label of every page (url, html) from its own visible text; null where no text is visible.

    With a model, a page is bad when the quality classifier scores its text below cut. Without one, when it is junk: over
    a tenth symbols, over four tenths of the characters upper case, or (from 20 words) under a fifth of the words distinct.
    Null urls have an empty host. Repeated pages count each.
    """
    texts = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), visible_text(F.col("html")).alias("text"))
    if model is not None:
        texts = stored(texts, "visible")  # the statistics read a text many times, the markup is stripped once
        scored = with_features(texts).withColumn("_score", model.column())
        return scored.select("host", F.when(F.col("text") != "", (F.col("_score") < cut).cast("int")).alias("bad"))
    parts = texts.select("host", F.col("text").alias("_text"), words(F.col("text")).alias("_words"))
    n = F.length("_text")
    symbols, upper = count_in(F.col("_text"), "#*$%&|<>"), count_in(F.col("_text"), r"\p{Lu}")
    junk = (symbols > 0.1 * n) | (upper > 0.4 * n) | ((F.size("_words") >= 20) & (F.size(F.array_distinct("_words")) < 0.2 * F.size("_words")))
    return parts.select("host", F.when(n > 0, junk.cast("int")).alias("bad"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) for every row of pages (page_id, url).

    Null urls and urls without :// have empty host and path, fit no rule and are judged like the host ''. A host
    without labelled pages is judged by its registered domain's posterior, else its suffix's, else that of all hosts;
    without any outcome it is allowed, with null rate and bound. Repeated rows and null ids are kept as they are, extra
    columns are not read.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    parsed = parsed.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("site", site_of(F.col("host")))
    rep = stored(site_posteriors(parsed.select("site").distinct(), outcomes), "posteriors")
    own = F.when(F.col("bad_bound") >= threshold, F.lit("block")).otherwise("allow")
    return parsed.join(rep, "site", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "bad_rate", "bad_bound")
