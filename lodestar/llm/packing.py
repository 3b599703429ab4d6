"""Packing token streams into windows of bounded length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import open_vocabulary, vocabulary_path

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: items dealt into windows of near-equal sums.

    Every item starts as a partial partition with one filled window. The two partial partitions with the largest
    imbalance (largest minus smallest sum) are merged, the fullest windows of one with the emptiest of the other,
    until one is left. O(n (log n + w log w)) for n items and w windows. Ties go to the earlier item.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # of each node: an item, or the union of two nodes
    heap, parts = [], {}
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        parts[i] = sums, nodes
        heap.append((-s if windows > 1 else 0, i))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        (sa, na), (sb, nb) = parts.pop(heapq.heappop(heap)[1]), parts.pop(heapq.heappop(heap)[1])
        sums, nb = sa + sb[::-1], nb[::-1]
        nodes = np.where(na < 0, nb, na)
        for w in np.flatnonzero((na >= 0) & (nb >= 0)).tolist():
            left.append(int(na[w]))
            right.append(int(nb[w]))
            nodes[w] = len(left) - 1
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[made] = sums, nodes
        heapq.heappush(heap, (int(sums[0] - sums[-1]), made))
        made += 1
    out = []
    for node in parts[heap[0][1]][1].tolist():
        items, todo = [], [node]
        while todo:
            if (n := todo.pop()) < 0:
                continue
            if left[n] < 0:
                items.append(n)
            else:
                todo += [right[n], left[n]]
        out.append(items)
    return out


def pack_batch(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity: as few as the sum allows, one more whenever differencing exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        windows += 1


def pack(docs: DataFrame, capacity: int = 1024, grain: int = 128, batch: int = 128, end_id: int | None = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> pieces of token sequences of at most `capacity` tokens.

    Each document's ids, closed by end_id (None: not closed), are cut into full sequences and a tail; tails are cut
    into pieces of at most `grain` tokens, gathered until they fill `batch` windows, and dealt into near-equal windows
    by Karmarkar-Karp differencing. All of it happens inside the input partition: no shuffle, no key, memory bounded by
    a batch and one document. sequence_id holds the partition number and a counter; a retried task gives it again.

    Returns id_col (as doc_id), start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    Null text is an empty one; an empty document is the end_id alone, or without one no row. Repeated rows are packed
    each for itself; further columns are ignored. A document longer than capacity spans several sequences.
    """
    path = vocabulary or vocabulary_path()
    batch_tokens = batch * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = open_vocabulary(path)
        base, made = TaskContext.get().partitionId() << 40, 0
        tails: list[tuple] = []  # (doc, start, ids, doc_tokens)
        held = 0

        def settle() -> list[tuple]:
            nonlocal tails, held, made
            rows = []
            for window in pack_batch([len(t[2]) for t in tails], capacity):
                at = 0
                for i in sorted(window):
                    doc, start, ids, total = tails[i]
                    rows.append((doc, start, len(ids), ids.tobytes(), total, base + made, at))
                    at += len(ids)
                made += 1
            tails, held = [], 0
            return rows

        for rb in batches:
            rows = []
            for doc, text in zip(rb.column(0).to_pylist(), rb.column(1)):
                ids = words.encode(text.as_py() or "")
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], "<u4"))
                total = len(ids)
                full = total - total % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, base + made, 0))
                    made += 1
                for start in range(full, total, grain):
                    tails.append((doc, start, ids[start : start + grain], total))
                held += total - full
                if held >= batch_tokens:
                    rows += settle()
            if rows:
                yield _pieces(rows)
        if tails:
            yield _pieces(settle())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
