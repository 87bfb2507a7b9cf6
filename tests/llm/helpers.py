"""Brute-force versions of the text operators, and small tables with awkward rows."""

import random
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(links, names):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def jaccard_classes(rows, percent=75):
    """doc_id -> component, by all pairs; a repeated id is one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return classes(links, {i for i, _ in sets})


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, groups=12):
    """(doc_id, text): unique texts, exact and near copies, shared passages, short, empty, null and long ones."""
    rng = random.Random(seed)
    out = []
    passage = sentence(rng, 60)
    add = lambda t: out.append((len(out) * 3 + 5, t))
    for g in range(groups):
        base = sentence(rng, rng.randrange(30, 160)).split()
        add(" ".join(base))
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            add(" ".join(copy) if g % 2 else " ".join(copy).upper())
        add(passage + " " + sentence(rng, rng.randrange(1, 90)))
    add(passage)
    for t in ("", None, "  \n\t", "one", "ONE", "two words", "a b c d", "A b c d", "a b c d e", "a b c d e f", "é É\u00a0x y z"):
        add(t)
    add(sentence(rng, 6000))
    rng.shuffle(out)
    return out


def postings(rows):
    index = defaultdict(list)
    for i, t in rows:
        for s in shingles(t):
            index[s].append(i)
    return index


def base_rules(text):
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
