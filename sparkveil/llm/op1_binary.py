"""Token-id output: best-fit-decreasing packing into id matrices, with a segment tree over free room.

Every input task fills sequences on its own, a window of about WINDOW ids at a time, so nothing is
shuffled and no key can be hot. A window holds about a thousand sequences, so its last few partly
filled ones cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, table
from .tokens import END_ID, encoder, vocabulary_path

CAPACITY = 2048
WINDOW = 2_000_000


class RoomTree:
    """Open sequences by free room: a segment tree over 0..capacity whose nodes count the sequences below."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least `need`, removed from the tree; None where there is none."""
        count, i = self.count, self.leaves + need
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):  # up, until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the lengths in each sequence: longest first, each to the sequence it fills best; ties by index."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            out.append([i])
            room, s = capacity - lengths[i], len(out) - 1
        else:
            out[found[1]].append(i)
            room, s = found[0] - lengths[i], found[1]
        if room:
            tree.add(room, s)
    return out


SCHEMA = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"


def _pack(path: str, capacity: int, end_id: int, pad_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).ids, np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, int, np.ndarray]] = []
        counts = np.arange(capacity, dtype="<u2")

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for seq in best_fit([len(p[3]) for p in held], capacity):
                parts = [held[i] for i in seq]
                ends = np.cumsum([len(p[3]) for p in parts])
                ids = np.full(capacity, pad_id, dtype="<u2")
                ids[: ends[-1]] = np.concatenate([p[3] for p in parts])
                positions = np.concatenate([counts[: len(p[3])] for p in parts] + [counts[: capacity - ends[-1]]])
                rows.append((number, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
                number += 1
                if len(rows) == 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
            held.clear()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        total = 0
        for doc_ids, texts in arrow_rows(batches, "doc_id", "text"):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.frombuffer(encode(text) + end, dtype="<u4").astype("<u2")
                held += [(doc_id, at, len(ids), ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
                total += len(ids)
                if total >= window:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def write_ids(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Packed sequences: input_ids (capacity little-endian 16-bit ids, padded with pad_id), cu_seqlens (cumulative
    segment lengths from 0), position_ids (16-bit, back to 0 at each segment and where padding begins), and for
    each segment its doc_id, its first id's place in the document and the document's ids in all.

    A document is its whole text's ids and end_id; one of more than `capacity` ids is cut every `capacity`
    ids and loses none. A null or empty text is the end id alone. Each row is a document of its own, also where
    doc_ids repeat or are null. Other columns are ignored; an empty table gives no rows. The vocabulary
    must have at most 65,536 ids, the capacity must not exceed 65,536. sequence_id is unique, and a retried
    task gives the same ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(path or vocabulary_path(), capacity, end_id, pad_id, window), SCHEMA)


def op1_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_ids(table(spark, sf_dir, "documents"))
