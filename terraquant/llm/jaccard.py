"""Exact Jaccard join of shingle sets by token-combination prefixes.

Sets are ordered by (frequency class, hash). Class 1 holds rare shingles, class 2 the frequent
ones: a table of bounded size from exact counts of the tokens that prefixes would hold. Any table gives right
results, as only the order depends on it. A set of n shingles may miss q = n - ceil(t*n) of them in a linked set. Its prefix is the
first q + 1 rare shingles; where it has fewer, the prefix is extended into class 2 until removing any q
tokens still leaves one rare token or two frequent ones. So linked sets share a rare prefix token or a pair
of frequent ones: rare tokens are indexed singly, frequent ones as two-token combinations.

Copies collapse first (one set, one representative). Then the first tokens of each prefix tie every set to
the smallest set with that token and to a neighbour in size, which merges groups of near copies at a cost linear
in their size. The
prefix index over all representatives then yields only pairs from different groups, and frequent tokens
that stay within one group are not combined, so no group is expanded into all its pairs. Combinations are dealt
by their first token, long lists in cells of bounded size. What a pair can share beyond its first common token,
and a parity sketch of both sets, rule most candidates out where they meet, without losing a link. The
others are verified on the whole sets; components are those of all verified links.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terraquant.llm.text import chunks, in_sorted, long_lists, shingle_sets
from terraquant.operators.components import connected_components
from terraquant.session import stored

#: Similarity of linked sets, in hundredths.
PERCENT = 75
#: Bound of the table of frequent shingles (8 MB), and the number of texts from which a prefix token is frequent.
FREQUENT = 1 << 20
FREQUENT_SETS = 24
#: Rounds in which tokens are counted, how far they look beyond a grown prefix, and the number of texts from which a token found in the last one asks for another.
COUNT_ROUNDS = 3
AHEAD = 3
MANY_SETS = 1000
#: First prefix tokens of each class that tie near copies together.
HEADS = 6
#: Least and greatest width, in bits, of a set's parity sketch.
SKETCH = (256, 8192)
#: Rows of a frequent token's list that meet in one task; longer lists are dealt in cells of so many.
LIST = 8192
#: Index rows of rare tokens that a worker holds at a time.
PROBE_ROWS = 100_000
#: Partners of a frequent token that an index row carries; with more it carries none and meets the whole list.
PARTNERS = 64
#: Numbers from here on stand for documents without an id while components are found.
UNNAMED = 1 << 62
#: Words of 64 bits in the filter of candidate ids (2 MB); it only saves work.
FILTER_WORDS = 1 << 18


def _misses(n: np.ndarray | int, percent: int):
    """Most shingles of a set of n that a linked set may lack."""
    return n - (percent * n + 99) // 100


def frequent_shingles(docs: DataFrame, percent: int = PERCENT) -> np.ndarray:
    """Sorted hashes of tokens that FREQUENT_SETS texts or more share, at most FREQUENT (the most frequent).

    The tokens of all texts' first prefixes are counted exactly, combined before the shuffle. Prefixes with frequent tokens
    grow, so further rounds count the tokens that they grow into, and AHEAD times as many beyond. Rounds end when
    they find nothing, after COUNT_ROUNDS as soon as they find no token of MANY_SETS.
    """
    table = np.zeros(0, np.uint64)
    for turn in itertools.count(1):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def fresh(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                for b in chunks(batch, 0):
                    off, val = shingle_sets(b.column(0))
                    out = [val[:0]]
                    for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                        first, _ = prefix(val[x:y], known[:0], percent)
                        if not len(known):
                            out.append(first)
                        elif grown := int(in_sorted(first, known).sum()):
                            beyond = val[x + len(first) : y]
                            out.append(beyond[~in_sorted(beyond, known)][: grown * (1 + AHEAD)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["token"])

        counts = docs.select("text").mapInArrow(fresh, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_SETS)
        got = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
        found = got.column("token").to_numpy().astype(np.int64).view(np.uint64)
        table = np.unique(np.concatenate([table, found]))
        if not len(found) or len(table) >= FREQUENT or (turn >= COUNT_ROUNDS and got.column("n")[0].as_py() < MANY_SETS):
            return table


def prefix(values: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(rare, frequent) prefix tokens of one sorted set. Sets that can only be linked with an equal set have none."""
    n = len(values)
    q = int(_misses(n, percent))
    # a linked set that is not equal has n + 1 shingles at least, or n - 1 at most
    if n == 0 or (100 * n < percent * (n + 1) and 100 * (n - 1) < percent * n):
        return values[:0], values[:0]
    often = in_sorted(values, frequent)
    rare = values[~often]
    if len(rare) > q:
        return rare[: q + 1], values[:0]
    return rare, values[often][: q + 2 - len(rare)]


def _named(ids: pa.Array, keys: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids of documents; a null one with words gets a number from UNNAMED on that depends on its set alone."""
    given, some = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
    return pa.array(np.where(some, given, UNNAMED | (keys & (UNNAMED - 1))), pa.int64(), mask=~some & (sizes == 0))


def _set_keys(off: np.ndarray, val: np.ndarray) -> np.ndarray:
    """128-bit key of each set, in two numbers."""
    out = np.zeros((len(off) - 1, 2), np.int64)
    for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        out[i] = np.frombuffer(xxhash.xxh3_128_digest(val[x:y].tobytes()), np.int64)
    return out


def document_sets(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(doc_id, id, n, k1, k2, rare, often, sketch) of each row: id as in _named, set size, 128-bit key of the set, prefix tokens by class; sketch only where frequent ones may be combined."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, 1):
                off, val = shingle_sets(b.column(1))
                keys, rare, often, bits = _set_keys(off, val), [], [], []
                for x, y in zip(off[:-1].tolist(), off[1:].tolist()):
                    r, o = prefix(val[x:y], table.value, percent)
                    rare.append(r)
                    often.append(o)
                    bits.append(sketch(val[x:y]) if len(o) > 1 else b"")
                lists = [long_lists(np.concatenate([[0], np.cumsum([len(x) for x in part])]), np.concatenate(part)) for part in (rare, often)]
                n = np.diff(off)
                yield pa.RecordBatch.from_arrays([b.column(0), _named(b.column(0), keys[:, 0], n), pa.array(n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), *lists, pa.array(bits)], ["doc_id", "id", "n", "k1", "k2", "rare", "often", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, id long, n long, k1 long, k2 long, rare array<long>, often array<long>, sketch binary")


def _id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bit filter of fixed size over the ids: bits are combined on the executors, at most FILTER_WORDS rows come back."""
    hashed = ids.select(F.xxhash64(F.col(column)).alias("h"))
    words = hashed.groupBy(F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS)).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out


def candidate_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, n, s) of documents whose ids occur in pairs (a, b), of few others that the filter lets through, and of rows without an id."""
    bits = docs.sparkSession.sparkContext.broadcast(_id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy()
            hit = ((bits.value[(h >> 6) % FILTER_WORDS] >> (h & 63)) & 1).astype(bool)
            some = batch.filter(pa.array(hit | pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)))
            for b in chunks(some, 1) if some.num_rows else ():
                off, val = shingle_sets(b.column(1))
                n, ids = np.diff(off), b.column(0)
                if ids.null_count:
                    ids = _named(ids, _set_keys(off, val)[:, 0], n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), long_lists(off, val)], ["doc_id", "n", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    return rows.mapInArrow(run, "doc_id long, n long, s array<long>").where("doc_id IS NOT NULL")


def verified(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    sets = candidate_sets(docs, pairs)
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _sizes_link(na, nb, percent: int):
    return (100 * F.least(na, nb)) >= percent * F.greatest(na, nb)


def head_pairs(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with the smallest-id set that shares one of its first prefix tokens, and with the next one in size.

    Neighbours in size are taken within parts of a token's sets of about LIST, so no task has to sort a large group whole.
    """
    heads = reps.select("doc_id", "n", F.explode(F.concat(F.slice("rare", 1, HEADS), F.slice("often", 1, 2 * HEADS))).alias("token"))
    least = heads.groupBy("token").agg(F.min(F.struct("doc_id", "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select("token", "c", F.ceil(F.col("m") / LIST).alias("parts"))
    shared = heads.join(least, "token").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    part = Window.partitionBy("token", "part").orderBy("n", "doc_id")
    placed = shared.withColumn("beside", F.lag(F.struct("doc_id", "n")).over(part))
    near = placed.select("doc_id", "n", F.explode(F.array("c", "beside")).alias("c"))
    pairs = near.where(F.col("c").isNotNull() & (F.col("doc_id") != F.col("c.doc_id"))).where(_sizes_link(F.col("n"), F.col("c.n"), percent))
    return pairs.select(F.greatest("doc_id", "c.doc_id").alias("a"), F.least("doc_id", "c.doc_id").alias("b")).distinct()


def cross_pairs(token: np.ndarray, doc: np.ndarray, size: np.ndarray, group: np.ndarray, cap: np.ndarray, percent: int = PERCENT, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (a, b, tokens shared): documents that share a token, differ in group, and whose sizes allow a link.

    cap bounds what a document can share with another one.
    """
    names, doc = np.unique(doc, return_inverse=True)
    order = np.lexsort((size, token))
    token, doc, size, group, cap = token[order], doc[order], size[order], group[order], cap[order]
    held: list[np.ndarray] = []
    n_held = 0

    def counted() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, c = np.unique(np.concatenate(held), return_counts=True)
        return names[k // len(names)], names[k % len(names)], c

    for i, j in runs(np.unique(token, return_inverse=True)[1], size, percent):
        fine = (group[i] != group[j]) & (doc[i] != doc[j])
        fine &= (100 + percent) * np.minimum(cap[i], cap[j]) >= percent * (size[i] + size[j])
        x, y = doc[i[fine]], doc[j[fine]]
        held.append(np.minimum(x, y) * len(names) + np.maximum(x, y))
        n_held += len(x)
        if n_held >= block:
            yield counted()
            held, n_held = [], 0
    if n_held:
        yield counted()


def runs(key: np.ndarray, size: np.ndarray, percent: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j), i < j, of rows with one key whose sizes allow a link; rows are sorted by (key, size)."""
    wide = np.int64(1) << 32
    reach = np.searchsorted(key * wide + size, key * wide + 100 * size // percent, side="right")
    count = np.maximum(reach - np.arange(1, len(key) + 1), 0)
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(key):
        end = max(at + 1, int(np.searchsorted(total, total[at] + step, side="right")) - 1)
        n = count[at:end]
        i = np.repeat(np.arange(at, end), n)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(total[at:end] - total[at], n)
        at = end


def sketch(values: np.ndarray) -> bytes:
    """Parity sketch of a set: bit h mod w is the parity of the members there, w the power of two from the set's size on."""
    w = min(SKETCH[1], max(SKETCH[0], 1 << (len(values) - 1).bit_length()))
    return np.packbits(np.bincount((values & np.uint64(w - 1)).astype(np.int64), minlength=w).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distances(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of sets: differing bits of their sketches, the wider one folded. The sets differ in as many members at least."""
    width = np.fromiter(map(len, sketches), np.int64, count=len(sketches))
    level, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)
    for w in np.unique(level).tolist():
        pairs = np.flatnonzero(level == w)
        rows = np.unique(np.concatenate([i[pairs], j[pairs]]))
        bits = np.empty((len(rows), w // 8), np.uint64)
        for v in np.unique(width[rows]).tolist():
            own = np.flatnonzero(width[rows] == v)
            parts = np.frombuffer(b"".join(sketches[rows[k]] for k in own.tolist()), np.uint64).reshape(len(own), v // w, w // 8)
            bits[own] = np.bitwise_xor.reduce(parts, axis=1)
        step = max(1, (1 << 25) // w)
        for k in range(0, len(pairs), step):
            p = pairs[k : k + step]
            out[p] = np.bitwise_count(bits[np.searchsorted(rows, i[p])] ^ bits[np.searchsorted(rows, j[p])]).sum(1)
    return out


def size_class(n: np.ndarray | int, percent: int):
    """Class of a set's size; linked sets are in the same class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (1.0001 * np.log(100 / percent))).astype(np.int64)


class Cells:
    """How the long lists of frequent tokens are dealt: cells by group (the token's most common one or others), size class and a hash of the id.

    Two cells meet in one task each, unless both hold the common group or their sizes allow no link; nothing is left out.
    """

    def __init__(self, counts: Iterator[tuple[int, int, bool, int, int]], limit: int):
        """counts: (token, common group, in it, size class, rows)."""
        self.common: dict[int, int] = {}
        self.cells: dict[int, list[tuple[bool, int, int]]] = {}
        self.first: dict[tuple[int, bool, int], tuple[int, int]] = {}
        for token, common, within, size, rows in counts:
            self.common[token] = common
            cells, parts = self.cells.setdefault(token, []), -(-rows // limit)
            self.first[token, within, size] = len(cells), parts
            cells += [(within, size, k) for k in range(parts)]

    def deals(self, token: int, doc: int, group: int, n: int, most: int, percent: int) -> list[tuple[int, int]]:
        """(deal, side) of one row of a token's list; sides 0 and 1 of a deal meet, side 2 meets itself. most: largest set that may link."""
        if 100 * most < percent * n:
            return []
        cells = self.cells.get(token)
        if cells is None:
            return [(token << 32, 2)]
        within, size = group == self.common[token], int(size_class(n, percent))
        start, parts = self.first[token, within, size]
        own, top, out = start + xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True)) % parts, int(size_class(most, percent)), []
        for k, (other, near, _) in enumerate(cells):
            if not (within and other) and abs(near - size) <= 1 and near <= top:
                out.append(((token << 32) + min(own, k) * len(cells) + max(own, k) + 1, 2 if k == own else int(k < own)))
        return out


def close_pairs(deal: np.ndarray, side: np.ndarray, doc: np.ndarray, size: np.ndarray, group: np.ndarray, before: np.ndarray, partners: pa.ListArray, sketches: list[bytes], percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (a, b): rows that meet in a deal, share a second token too (partners; null: not known), and may link.

    before counts the set's tokens that come before the shared one in the order of tokens: where that is the first token that
    two sets share, no more than the rest can be shared. Sketches bound from below in how many members the sets differ.
    """
    order = np.lexsort((size, deal))
    known = pc.is_valid(partners).to_numpy(zero_copy_only=False)
    starts, flat = partners.offsets.to_numpy(), partners.values.to_numpy()

    def meet(x: int, y: int) -> bool:
        return not (known[x] and known[y]) or bool(np.isin(flat[starts[x] : starts[x + 1]], flat[starts[y] : starts[y + 1]]).any())

    for i, j in runs(np.unique(deal[order], return_inverse=True)[1], size[order], percent):
        i, j = order[i], order[j]
        both = size[i] + size[j]
        need = -(-percent * both // (100 + percent))
        fine = (group[i] != group[j]) & (doc[i] != doc[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (np.minimum(size[i] - before[i], size[j] - before[j]) >= need)
        i, j, most = i[fine], j[fine], (both - 2 * need)[fine]
        near = sketch_distances(sketches, i, j) <= most
        i, j = i[near], j[near]
        again = np.fromiter((meet(x, y) for x, y in zip(i.tolist(), j.tolist())), bool, count=len(i))
        x, y = doc[i[again]], doc[j[again]]
        if len(x):
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pairs[:, 0], pairs[:, 1]


def by_key(batches: Iterator[pa.RecordBatch], rows: int, use: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What use makes of batches sorted by their first column, in tables of about rows that hold each key whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            whole = pa.Table.from_batches(held)
            keys = whole.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from use(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
    if held:
        yield from use(pa.Table.from_batches(held))


def index_pairs(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs from different groups that share a signature and may link. reps: doc_id, n, grp, rare, often, sketch."""
    limit, most_partners = LIST, PARTNERS

    def probe_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(held: pa.Table) -> Iterator[pa.RecordBatch]:
            token, doc, size, group = (held.column(k).to_numpy() for k in range(4))
            for x, y, c in cross_pairs(token, doc, size, group, size, percent):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(c.astype(np.int64))], ["a", "b", "c"])

        yield from by_key(batches, PROBE_ROWS, meet)

    single = reps.select(F.explode("rare").alias("token"), "doc_id", "n", "grp").repartition("token").sortWithinPartitions("token").mapInArrow(probe_rare, "a long, b long, c long")
    found = within_bound(single.groupBy("a", "b").agg(F.sum("c").alias("rare")), reps, percent)
    # sets that share rare tokens too have met there: below none of a set's rare tokens is shared
    often = reps.where(F.size("often") > 1)
    listed = often.select("grp", F.explode("often").alias("token")).groupBy("token", "grp").agg(F.count("*").alias("m"))
    listed = listed.groupBy("token").agg(F.sum("m").alias("m"), F.max_by("grp", F.struct("m", "grp")).alias("common"), F.count("*").alias("k")).where("k > 1")
    # at most as many rows as the table of frequent shingles
    contested = stored(listed.select("token", "m", "common"), "contested")
    table = np.sort(contested.select("token").toArrow().column(0).to_numpy().astype(np.int64))
    if len(table) < 2:
        return found
    long = contested.where(F.col("m") > limit).select("token", "common")
    spread = often.select("grp", "n", F.explode("often").alias("token")).join(F.broadcast(long), "token")  # a part of that table
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * np.log(100 / percent)))
    counts = spread.groupBy("token", "common", (F.col("grp") == F.col("common")).alias("within"), size.alias("size")).agg(F.count("*").alias("m")).collect() if long.limit(1).count() else []
    cells = Cells(((int(np.searchsorted(table, r["token"])), r["common"], r["within"], r["size"], r["m"]) for r in sorted(counts)), limit)
    shared = reps.sparkSession.sparkContext.broadcast((table, cells))
    names = ["deal", "side", "doc_id", "n", "grp", "before", "partners", "sketch"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells = shared.value
        for b in batches:
            out: list[tuple] = []
            for doc, n, grp, rare, tokens, bits in zip(*(b.column(k).to_pylist() if k != 4 else b.column(k) for k in range(6))):
                t = tokens.values.to_numpy()
                at = np.searchsorted(table, t)
                at[at == len(table)] = 0
                hit = np.flatnonzero(table[at] == t)
                own = at[hit].tolist()
                for k in range(len(own) - 1):  # combinations by their first token: the last one has no partner
                    before = rare + int(hit[k])
                    most = (100 + percent) * (n - before) // percent - n
                    partners = own[k + 1 :] if len(own) - k - 1 <= most_partners else None
                    out += [(deal, side, doc, n, grp, before, partners, bits) for deal, side in cells.deals(own[k], doc, grp, n, most, percent)]
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    def probe_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: pa.Table) -> Iterator[pa.RecordBatch]:
            fixed = [held.column(k).to_numpy() for k in range(6)]
            for x, y in close_pairs(*fixed, held.column(6).combine_chunks(), held.column(7).to_pylist(), percent):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        yield from by_key(batches, limit, close)

    rows = often.select("doc_id", "n", "grp", F.size("rare").alias("rare"), "often", "sketch").mapInArrow(deal_out, "deal long, side int, doc_id long, n long, grp long, before long, partners array<int>, sketch binary")
    double = rows.repartition("deal").sortWithinPartitions("deal").mapInArrow(probe_often, "a long, b long")
    return found.unionByName(double).distinct()


def within_bound(counts: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs (a, b, rare) whose shared rare prefix tokens leave room for a link.

    Of two prefixes one ends first in the order of tokens; the rare tokens that the sets share up to there were counted, its
    frequent ones may all be shared, and so may the rest of that set.
    """
    flip = F.col("last").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    last = F.when(F.size("often") > 0, F.element_at("often", -1)).otherwise(F.element_at("rare", -1))
    ends = reps.select("doc_id", "n", (F.col("n") - F.size("rare") - F.size("often")).alias("rest"), F.size("often").alias("many"), (F.size("often") > 0).cast("int").alias("class"), last.alias("last"))
    ends = ends.select("doc_id", "n", "rest", "many", F.struct("class", flip.alias("at")).alias("end"))
    side = lambda k: ends.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"rest{k}"), F.col("many").alias(f"many{k}"), F.col("end").alias(f"end{k}"))
    most = F.col("rare") + F.least("manya", "manyb") + F.when(F.col("enda") <= F.col("endb"), F.col("resta")).otherwise(F.col("restb"))
    # 100 * i >= percent * (na + nb - i)
    return counts.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _components(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, n, k1, k2, ...) of every row, and the component (n, k1, k2, c) of every set with words."""
    texts = docs.select("doc_id", "text")
    frequent = frequent_shingles(texts, percent)
    sets = stored(document_sets(texts, frequent, percent), "sets")
    with_words = sets.where("n > 0")
    reps = stored(with_words.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep")), "reps")
    own = with_words.join(reps, ["n", "k1", "k2"]).where("id = rep").select(F.col("id").alias("doc_id"), "n", "k1", "k2", "rare", "often", "sketch")
    own = stored(own.where("size(rare) + size(often) > 0").dropDuplicates(["doc_id", "n", "k1", "k2"]).drop("k1", "k2"), "own")
    heads = stored(verified(texts, stored(head_pairs(own, percent), "heads"), percent), "links")
    groups = stored(connected_components(heads, "a", "b"), "groups")
    grouped = own.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"), "rare", "often", "sketch")
    found = stored(index_pairs(grouped, percent), "pairs")
    links = heads.unionByName(verified(texts, found, percent))
    # texts of one doc_id hang together
    same = with_words.join(reps, ["n", "k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    repeated = with_words.groupBy("id").agg(F.min(F.struct("n", "k1", "k2")).alias("lo"), F.max(F.struct("n", "k1", "k2")).alias("hi")).where("lo <> hi").select(F.col("id").alias("a"))
    bridges = same.join(repeated, "a", "left_semi")
    comps = stored(connected_components(stored(links.unionByName(bridges), "links"), "a", "b"), "components")
    named = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("c"))
    return sets, named


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    n_shingles counts distinct five-word shingles of the lower-cased text (A-Z only); a text of one to four words
    is one shingle. Sets link when 100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable. Null, empty and word-less texts have size 0 and stay alone. Rows that repeat a doc_id are one
    document: their texts' components are joined. A row with a null doc_id is linked like any other; its component_id
    is null where no row of the component has an id. Shingles are compared by 64-bit hashes; ids are below 2**62.
    """
    sets, named = _components(docs, percent)
    out = sets.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("c") < UNNAMED, F.col("c")), "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: of the document whose doc_id names it.

    Of rows that repeat that doc_id, the one with the smallest set and text stays; so too in a component of which no row has
    an id. Rows without an id and without words stay all. Any columns are allowed; an empty table gives an empty result.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sets, named = _components(docs, percent)
    sets = sets.select("doc_id", "id", "n", "k1", "k2")
    joined = stored(sets.join(named, ["n", "k1", "k2"], "left").select("doc_id", "id", F.coalesce("c", "id").alias("c")), "named")
    # the document that names a component stays, whole
    gone = joined.where("doc_id IS NOT NULL AND id <> c").select(F.col("doc_id").alias("_gone")).distinct()
    repeated = stored(joined.where("doc_id IS NOT NULL AND id = c").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("m")).where("m > 1").select("_twice"), "repeated")
    out = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    nameless = joined.where("doc_id IS NULL").limit(1).count() > 0
    if not nameless and not repeated.limit(1).count():
        return out.select(*columns)
    alone = joined.where("doc_id IS NULL AND id = c").select(F.col("id").alias("_alone")).distinct()
    twice = docs["doc_id"].cast("long") == repeated["_twice"]
    plain = out.where("doc_id IS NOT NULL").join(repeated, twice, "left_anti").select(*columns)
    rows = F.struct(*columns).alias("_all")
    order = F.struct(F.length("text").alias("n"), F.col("text").alias("t"))
    least = F.min_by("_all", "_order")
    several = out.join(repeated, twice, "left_semi").select("doc_id", rows, order.alias("_order"))
    picked = several.groupBy("doc_id").agg(least.alias("_all"))
    nulls = row_ids(docs.where("doc_id IS NULL").select("doc_id", "text", rows))
    silent = nulls.where("_id IS NULL").select("_all")
    first = nulls.join(alone, F.col("_id") == F.col("_alone"), "left_semi").withColumn("_order", F.struct(F.length("_all.text").alias("n"), F.col("_all.text").alias("t"))).groupBy("_id").agg(least.alias("_all"))
    for part in (picked, silent, first):
        plain = plain.union(part.select(*(F.col("_all").getField(c).alias(c) for c in docs.columns)))
    return plain


def row_ids(rows: DataFrame) -> DataFrame:
    """(_id, _all) of rows (doc_id, text, _all): the id that document_sets gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, 1):
                off, val = shingle_sets(b.column(1))
                yield pa.RecordBatch.from_arrays([_named(b.column(0).cast(pa.int64()), _set_keys(off, val)[:, 0], np.diff(off)), b.column(2)], ["_id", "_all"])

    return rows.mapInArrow(run, StructType([StructField("_id", LongType()), StructField("_all", rows.schema["_all"].dataType)]))
