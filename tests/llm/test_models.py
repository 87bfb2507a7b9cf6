"""The parts of the rule ensemble, the lookup table and the token counts against plain computations."""

import hashlib

import numpy as np
import pytest

from terraquant.llm import bpe, maglev, rules
from terraquant.llm.queries import tokenizer_path


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(int)
    flip = rng.random(n) < 0.05
    return x, np.where(flip, 1 - y, y)


def test_lasso_meets_its_optimality_conditions():
    x, y = sample()
    z = np.column_stack([x[:, f] > t for f in range(4) for t in (-1, -0.5, 0, 0.3, 0.5, 1.2)]).astype(float)
    for l1 in (0.001, 0.01, 0.05):
        b, w = rules._lasso(z, y.astype(float), l1)
        grad = np.column_stack([np.ones(len(z)), z]).T @ (1 / (1 + np.exp(-(b + z @ w))) - y) / len(y)
        assert abs(grad[0]) < 1e-3
        on = np.abs(w) > 1e-9
        assert np.abs(grad[1:][on] + l1 * np.sign(w[on])).max(initial=0) < 1e-3  # active rules: the gradient balances the penalty
        assert np.abs(grad[1:][~on]).max(initial=0) <= l1 + 1e-3  # the others can't gain
    assert (np.abs(rules._lasso(z, y.astype(float), 10.0)[1]) < 1e-9).all()


def test_first_split_is_the_best_of_all(monkeypatch):
    """With all features drawn, the root of a tree is the split of greatest gain over every feature and cut."""
    x, y = sample()
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 20)[1:-1])) for f in range(4)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)

    class All:
        def permutation(self, n):
            return _Whole(n)

    class _Whole(list):
        def __init__(self, n):
            super().__init__(range(n))

        def __getitem__(self, at):  # every feature is looked at
            return list(range(len(self)))

    paths, out = rules._grow(x, g, h, cuts, codes, All())
    best = None
    for f in range(4):
        for t in cuts[f]:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < 5:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best or (gain, f, t), (gain, f, t))
    first = {t[0] for t in paths}
    assert first == {(best[1], True, float(best[2])), (best[1], False, float(best[2]))}
    # a leaf's value is its regularised step
    for terms in paths:
        rows = rules.Rule(terms).matches(x)
        if len(set(out[rows].round(12))) == 1:
            assert out[rows][0] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1))


def test_ensemble_learns_the_rules():
    x, y = sample(2000)
    model = rules.fit_rules(x[:1500], y[:1500])
    s, t = model.score(x[1500:]), y[1500:]
    ranks = (s[t == 1][:, None] > s[t == 0][None]).mean() + 0.5 * (s[t == 1][:, None] == s[t == 0][None]).mean()
    assert ranks > 0.93 and 0 < len(model.rules) < 150


def test_table_is_filled_in_turns():
    """The lookup table by a plain loop: each shard in turn takes its next free slot in its own order."""
    names, size = [f"n{i}" for i in range(7)], 101
    number = lambda text, what: int(hashlib.md5(f"{what}:{text}".encode()).hexdigest()[:15], 16)
    orders = [[(number(n, "offset") + k * (number(n, "stride") % (size - 1) + 1)) % size for k in range(size)] for n in names]
    assert all(sorted(o) == list(range(size)) for o in orders)
    owner, free = {}, set(range(size))
    while free:
        for i, order in enumerate(orders):
            if free:
                slot = next(s for s in order if s in free)
                owner[slot] = i
                free.discard(slot)
    assert maglev.lookup_table(names, size) == [owner[s] for s in range(size)]


def test_new_letters_and_odd_spaces_count_like_the_library(spark):
    """Letters, digits and spaces newer or rarer than the JVM's tables know."""
    tok = bpe.tokenizer(tokenizer_path())
    texts = ["Ᲊᲊ x", "\U00010d50\U00010d70 abc", "ꟋꟚꟜ", "\U0001fae9 \U0001fadc", "\U00016d40\U00016d70 1", "᠎ a᠎b", "a⁠b﻿c", "\x85a\x1c b\x1f", "\U0001ccf0\U0001ccf9", "ࢗx", "\U000323b0 \U0002ebf0", "ⅷ½ ²x", "　　a   b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, tokenizer_path()).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
