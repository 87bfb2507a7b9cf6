"""Benchmark decontamination by size-partitioned bottom-k MinHash containment search.

Test items are partitioned by their number of distinct five-word shingles. In a partition with at most u
shingles an item's sketch holds its k smallest shingle hashes, k = u - ceil(t*u) + 1: a document that
contains at least the share t of an item misses too few shingles to miss the whole sketch, however long the
document is, so the search loses nothing. A document's shingles probe the merged sketches by binary search;
each item hit is then verified by exact containment of all its shingles. Documents are never shuffled.
Items are a query set: they are taken in blocks of bounded size, each block being broadcast to one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquant.llm.text import SHINGLE, chunks, shingle_sets, window_hashes, word_hashes
from terraquant.session import stored

THRESHOLD = 0.75
#: Items, and bytes of item text, in one broadcast block.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20


class ItemIndex:
    """Sketches and shingle sets of one block of items."""

    def __init__(self, texts: list[str], threshold: float = THRESHOLD):
        arr = pa.array(texts, pa.string())
        off, val = shingle_sets(arr)
        doc, _ = word_hashes(arr)
        n_words = np.bincount(doc, minlength=len(texts))
        self.offsets, self.values = off, val
        self.sizes = np.diff(off)
        #: word counts of short items, which are one shingle of their whole text
        self.short = sorted({int(n) for n in n_words if 0 < n < SHINGLE})
        self.need = np.array([math.ceil(threshold * s - 1e-9) for s in self.sizes], np.int64)
        token, item = [], []
        for i, s in enumerate(self.sizes.tolist()):
            if s:
                upper = max(s, (1 << (s - 1).bit_length()))  # the partition's largest size
                k = min(s, upper - math.ceil(threshold * upper - 1e-9) + 1)
                token.append(val[off[i] : off[i] + k])
                item.append(np.full(k, i, np.int64))
        token = np.concatenate(token) if token else np.zeros(0, np.uint64)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        order = np.argsort(token, kind="stable")
        self.token, self.item = token[order], item[order]
        self.token_set = np.unique(self.token)

    def probe(self, texts: pa.Array) -> list[list[tuple[int, float]]]:
        """(item, containment) of the verified hits in each text."""
        found: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
        if not len(self.token):
            return found
        doc, word = word_hashes(texts)
        d, h = window_hashes(doc, word, SHINGLE)
        parts = [(d, h), *(window_hashes(doc, word, n) for n in self.short)]
        d, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at = np.searchsorted(self.token_set, h)
        at[at == len(self.token_set)] = 0
        for i in np.unique(d[self.token_set[at] == h]).tolist():
            own = np.unique(h[d == i])
            left = np.searchsorted(self.token, own)
            right = np.searchsorted(self.token, own, side="right")
            items = np.unique(np.concatenate([self.item[a:b] for a, b in zip(left, right) if b > a]))
            for j in items.tolist():
                mine = self.values[self.offsets[j] : self.offsets[j + 1]]
                at_own = np.searchsorted(own, mine)
                at_own[at_own == len(own)] = 0
                n = int((own[at_own] == mine).sum())
                if n >= self.need[j]:
                    found[i].append((j, n / len(mine)))
        return found


def item_blocks(items: DataFrame, text: str = "text") -> Iterator[list]:
    """Items in blocks of bounded count and bytes; an item over the bound makes a block of its own."""
    block, size = [], 0
    for row in items.select("item_id", text).where(f"{text} IS NOT NULL").toLocalIterator():
        n = len(row[1].encode())
        if block and (len(block) >= BLOCK_ITEMS or size + n > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (all columns) with contaminated boolean, item_ids array<long> and containment double (the largest, else 0).

    A document is contaminated by an item when it holds at least the share threshold of the item's distinct
    shingles. Null, empty and word-less texts (on either side) match nothing. An item of one to four words is one
    shingle and matches where its words stand in a row. An item without an id contaminates, but is not listed.
    Items that repeat are listed once; repeated rows and null ids of docs are searched like any other row. Columns of
    these three names in docs are replaced.

    Every block of items is one pass; between blocks the result is stored, so a task never holds more than one block.
    """
    names = ("contaminated", "item_ids", "containment")
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names))
    out = kept.withColumn("item_ids", F.lit([]).cast("array<long>")).withColumn("containment", F.lit(0.0))
    column = next(i for i, c in enumerate(kept.columns) if c.lower() == "text")
    for n_block, block in enumerate(item_blocks(items)):
        index = ItemIndex([t for _, t in block], threshold)
        ids = [i for i, _ in block]

        def search(batches: Iterator[pa.RecordBatch], index=index, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in chunks(batch, column):
                    old_ids, old_best = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                    for i, hits in enumerate(index.probe(b.column(column))):
                        if hits:
                            old_ids[i] = sorted({*old_ids[i], *(ids[j] for j, _ in hits if ids[j] is not None)})
                            old_best[i] = max(old_best[i], *(c for _, c in hits))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(old_ids, b.schema.field(b.num_columns - 2).type), pa.array(old_best, pa.float64())], schema=b.schema)

        if n_block:
            out = stored(out, "searched")
        out = out.mapInArrow(search, out.schema)
    return out.withColumn("contaminated", F.col("containment") > 0)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that no item contaminates, with their own columns, whatever they are called."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_packed"))
    clean = find_contamination(packed, items, threshold).where(~F.col("contaminated"))
    return clean.select(*(F.col("_packed").getField(c).alias(c) for c in docs.columns))
