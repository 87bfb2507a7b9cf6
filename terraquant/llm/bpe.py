"""Byte-level BPE: exact token counts and ids by pre-token, without a shuffle of pre-tokens.

Spark's regular expressions cut each text into pre-tokens inside the scan. A first pass over all texts
lets every task summarise its most frequent pre-tokens; only those bounded summaries are merged, giving
a table of at most FREQUENT pre-tokens that is broadcast. A second pass looks each distinct pre-token of
a batch up in that table, then in the worker's cache, and encodes what is left with the tokenizer itself.
The table only saves work: counts do not depend on what it holds.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The byte-level pre-tokenizer's pattern (Unicode classes) and its special string.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Pre-tokens in the broadcast table, and in one task's summary.
FREQUENT = 32_768
TASK_SUMMARY = 16_384
#: A worker's cache is emptied when it holds so many pre-tokens.
CACHE_LIMIT = 400_000
#: Tokens beyond which a document is over the limit.
LIMIT = 1024

_CACHE: dict[tuple[str, str], dict[str, object]] = {}
_TOKENIZERS: dict[str, object] = {}
_IDS: dict[str, PieceIds] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def pieces(text: Column, special: str = SPECIAL) -> Column:
    """Pre-tokens of a text; null where the special string occurs, as that is cut out before pre-tokens are."""
    t = F.coalesce(text, F.lit(""))
    return F.when(~F.contains(t, F.lit(special)), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))


def _encoded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pre-token count of each row, code of each pre-token, and the distinct pre-tokens."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(lists.flatten())
    return counts, enc.indices.to_numpy(zero_copy_only=False), enc.dictionary.to_pylist()


def _bounded(total: Counter, keep: int) -> Counter:
    """Misra-Gries step: subtract the first dropped count, so that memory stays bounded and frequent pre-tokens stay."""
    if len(total) <= 8 * keep:
        return total
    top = total.most_common(4 * keep + 1)
    floor = top[-1][1]
    return Counter({w: c - floor for w, c in top[:-1] if c > floor})


def frequent_pieces(texts: DataFrame, special: str = SPECIAL, keep: int = FREQUENT, per_task: int = TASK_SUMMARY) -> list[str]:
    """The most frequent pre-tokens of all texts (at most keep), from bounded per-task summaries."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            _, codes, names = _encoded(b.column(0))
            if names:
                for w, c in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
                    total[w] += c
                total = _bounded(total, per_task)
        top = total.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"])

    cut = texts.select(pieces(F.col("text"), special).alias("pieces"))
    rows = cut.mapInArrow(summarise, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(keep)
    return [r["piece"] for r in rows.collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, special: str = SPECIAL) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    Exactly the counts of the tokenizer file at path (which every worker opens), without added tokens. A null
    text counts as empty: no bytes, no tokens. Repeated rows and null ids are counted like any other row; an
    empty table gives an empty result. over_limit: more than limit tokens.
    """
    frequent = frequent_pieces(docs, special)
    tok = tokenizer(path)
    lengths = dict(zip(frequent, (len(e.ids) for e in tok.encode_batch(frequent, add_special_tokens=False)))) if frequent else {}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)  # at most FREQUENT entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        cache, lengths = _CACHE.setdefault((path, "count"), {}), shared.value
        for b in batches:
            counts, codes, names = _encoded(b.column(2))
            table = np.zeros(len(names), np.int64)
            missed = []
            for i, w in enumerate(names):
                n = lengths.get(w) or cache.get(w)
                if n:
                    table[i] = n
                else:
                    missed.append(i)
            if missed:
                if len(cache) > CACHE_LIMIT:
                    cache.clear()
                for i, e in zip(missed, t.encode_batch_fast([names[i] for i in missed], add_special_tokens=False)):
                    table[i] = cache[names[i]] = len(e.ids)
            run = np.concatenate([[0], np.cumsum(table[codes])]) if len(codes) else np.zeros(1, np.int64)
            ends = np.cumsum(counts)
            total = run[ends] - run[ends - counts]
            whole = b.column(3)
            for i in np.flatnonzero(pc.is_valid(whole).to_numpy(zero_copy_only=False)).tolist():
                total[i] = len(t.encode(whole[i].as_py(), add_special_tokens=False).ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    cut = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), pieces(F.col("text"), special).alias("pieces"), F.when(F.contains(text, F.lit(special)), text).alias("whole"))
    out = cut.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


class PieceIds:
    """Token ids of the pre-tokens that a worker has met, end to end in one array; emptied when it holds CACHE_LIMIT of them."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint16)

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each pre-token, after encoding those not met before."""
        if len(self.at) > CACHE_LIMIT:
            self.clear()
        missed = [w for w in names if w not in self.at]
        if missed:
            for w, e in zip(missed, tokenizer(self.path).encode_batch_fast(missed, add_special_tokens=False)):
                k, ids = len(self.at), e.ids
                start = self.first[k]
                while k + 2 > len(self.first):
                    self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                while start + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[start : start + len(ids)] = ids
                self.first[k + 1] = start + len(ids)
                self.at[w] = k
        return np.fromiter(map(self.at.__getitem__, names), np.int64, count=len(names))


def batch_ids(lists: pa.Array, whole: pa.Array, path: str) -> list[np.ndarray]:
    """Token ids of each row of a batch: by pre-tokens, or of the whole text where that is given."""
    counts, codes, names = _encoded(lists)
    if path not in _IDS:
        _IDS[path] = PieceIds(path)
    known = _IDS[path]
    number = known.numbers(names)
    size, first = known.first[number + 1] - known.first[number], known.first[number]
    n = size[codes] if len(codes) else np.zeros(0, np.int64)
    run = np.concatenate([[0], np.cumsum(n)])
    # position of every token of every occurrence among the known ids
    at = np.repeat(first[codes] - run[:-1], n) + np.arange(run[-1]) if len(codes) else np.zeros(0, np.int64)
    tokens = known.flat[at]
    ends = np.cumsum(counts)
    given = pc.is_valid(whole).to_numpy(zero_copy_only=False)
    out = []
    for i, (a, b) in enumerate(zip(run[ends - counts].tolist(), run[ends].tolist())):
        out.append(np.array(tokenizer(path).encode(whole[i].as_py(), add_special_tokens=False).ids, np.uint16) if given[i] else tokens[a:b])
    return out
