"""Token-id output: best-fit-decreasing packing with a segment tree over free space.

Texts are cut into pre-tokens by Spark and encoded per distinct pre-token. A document longer than a row is
split losslessly into row-sized pieces and one rest. Each task packs what it reads, in groups of bounded
token count: pieces in decreasing length each go to the fullest open row that still has room, which a
segment tree over remaining capacities finds in logarithmic time. Nothing is shuffled; a task's memory is
one group. Output rows are the matrix (unsigned 16-bit ids, padded), cumulative segment lengths, and
positions that restart with every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquant.llm.bpe import SPECIAL, batch_ids, pieces, tokenizer

ROW_TOKENS = 2048
#: Padding id of the matrix (the vocabulary's end-of-text id).
PAD = 50256
#: Tokens that are packed together, at most one document more.
GROUP_TOKENS = 2_000_000


class CapacityTree:
    """Segment tree over capacities 1..size: counts open rows by free space, finds the least capacity >= need."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, by: int = 1) -> None:
        i = capacity + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, need: int) -> int:
        """Least occupied capacity >= need, or -1."""
        i = need + self.base
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of item numbers. Items of equal length keep their order; of rows with equal room the last opened is used."""
    tree = CapacityTree(size)
    rows: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        if not 0 < n <= size:
            raise ValueError("lengths must be between 1 and the row size")
        room = tree.at_least(n)
        if room < 0:
            r, room = len(rows), size
            rows.append([])
        else:
            r = free[room].pop()
            tree.add(room, -1)
        rows[r].append(i)
        if room > n:
            free[room - n].append(r)
            tree.add(room - n)
    return rows


def pack_documents(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS, pad: int = PAD, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows of all documents (doc_id, text).

    pack_id long, doc_ids array<long>, piece_numbers array<int> (0, 1, ... within a document), n_tokens int,
    cu_seqlens array<int> (from 0 to n_tokens), input_ids binary and position_ids binary (row_tokens little-endian
    uint16 each; padding has id pad and position 0). Texts without tokens (null, empty) make no segment. Repeated
    rows are packed each; a null id stays null in doc_ids. No document, no row. Vocabularies beyond 16 bits raise.
    """
    if not 0 < row_tokens <= 65_536:
        raise ValueError("row_tokens must fit positions of 16 bits")
    if tokenizer(path).get_vocab_size() > 65_536:
        raise ValueError("the vocabulary's ids must fit 16 bits")
    schema = "pack_id long, doc_ids array<long>, piece_numbers array<int>, n_tokens int, cu_seqlens array<int>, input_ids binary, position_ids binary"

    def flush(group: list[tuple[int | None, np.ndarray]], number: int) -> pa.RecordBatch:
        items = [(d, k, ids[a : a + row_tokens]) for d, ids in group for k, a in enumerate(range(0, len(ids), row_tokens))]
        cols: list[list] = [[] for _ in range(7)]
        for row in best_fit_decreasing([len(x[2]) for x in items], row_tokens):
            own = [items[i] for i in row]
            size = [len(x[2]) for x in own]
            matrix, position = np.full(row_tokens, pad, "<u2"), np.zeros(row_tokens, "<u2")
            used = sum(size)
            matrix[:used] = np.concatenate([x[2] for x in own])
            position[:used] = np.concatenate([np.arange(n) for n in size])
            values = (number, [x[0] for x in own], [x[1] for x in own], used, [0, *np.cumsum(size).tolist()], matrix.tobytes(), position.tobytes())
            for c, v in zip(cols, values):
                c.append(v)
            number += 1
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["pack_id", "doc_ids", "piece_numbers", "n_tokens", "cu_seqlens", "input_ids", "position_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        group: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), batch_ids(b.column(1), b.column(2), path)):
                if len(ids):
                    group.append((d, ids))
                    held += len(ids)
                if held >= group_tokens:
                    out = flush(group, number)
                    number, group, held = number + out.num_rows, [], 0
                    yield out
        if group:
            yield flush(group, number)

    text = F.coalesce("text", F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces(F.col("text")).alias("pieces"), F.when(F.contains(text, F.lit(SPECIAL)), text).alias("whole"))
    return cut.mapInArrow(run, schema)


def write_binary(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet below path: one binary cell per matrix row, ready for np.frombuffer(cell, '<u2')."""
    packed.write.parquet(f"{path}/packed")
