"""Shared text pieces: native word columns and vectorised five-word shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words.
WHITE = "\t\n\x0b\f\r"
SHINGLE = 5
#: Bytes of text handled at a time in a Python worker.
CHUNK_BYTES = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_SOLID = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BYTE = np.array([(b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=np.uint64)
_PLACE = np.random.default_rng(20).integers(0, 1 << 64, 1024, dtype=np.uint64) | np.uint64(1)


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null or empty text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def count_in(text: Column, chars: str) -> Column:
    """Number of a text's characters in a class, such as a-z or \\p{Lu}."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def solid_length(text: Column) -> Column:
    """Number of a text's characters that belong to words."""
    for c in " " + WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def _final(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, so that one batch of long texts stays small in memory."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of every word of every text, A-Z lower-cased, in order.

    A word's hash is the sum of its bytes times random multipliers by position, mixed; two words share one with a
    probability below 2**-56. Works on the bytes of all texts at once.
    """
    arr = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = _SOLID[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]  # a text's first byte starts a word, whatever ends the text before
    start[rows] = solid[rows]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = data[solid]
    first = np.cumsum(solid)[at] - 1
    size = np.diff(np.append(first, len(own)))
    place = np.arange(len(own)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        h = _final(np.add.reduceat(_BYTE[own] * _PLACE[place % len(_PLACE)], first) + size.astype(np.uint64))
    for i in np.flatnonzero(size > len(_PLACE)).tolist():
        h[i] = xxhash.xxh3_64_intdigest(own[first[i] : first[i] + size[i]].tobytes().lower())
    return np.searchsorted(offsets, at, side="right") - 1, h


def window_hashes(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of all windows of n words."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = word[:m] * _MIX[0]
        for j in range(1, n):
            h += word[j : j + m] * _MIX[j]
        h = _final(h + np.uint64(n))
    inside = doc[:m] == doc[n - 1 :]
    return doc[:m][inside], h[inside]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the sorted distinct shingle hashes of each text.

    A shingle is five words; a text of one to four words is one shingle; a text without words has none.
    """
    n = len(texts)
    doc, word = word_hashes(texts)
    per = np.bincount(doc, minlength=n)
    d, h = window_hashes(doc, word, SHINGLE)
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(per)])
        extra = np.empty(len(short), np.uint64)
        for i, s in enumerate(short):
            k = int(per[s])
            extra[i] = window_hashes(doc[starts[s] : starts[s] + k], word[starts[s] : starts[s] + k], k)[1][0]
        d, h = np.concatenate([d, short]), np.concatenate([h, extra])
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
    bounds = np.searchsorted(d, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    d, h = d[keep], h[keep]
    return np.searchsorted(d, np.arange(n + 1)), h


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def long_lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values.astype(np.uint64).view(np.int64), pa.int64()))
