"""Packing token sequences as a cutting-stock problem, by column generation.

Documents are cut into pieces of the sequence length and a rest. The histogram of rest lengths, in
units of a few tokens, is the demand of a cutting-stock problem: a linear program over patterns
(multisets of lengths that fit one sequence). Its dual prices go to a knapsack dynamic program,
which finds the pattern that improves it most. The rounded patterns are slots; documents are ranked in
their length class, and each takes the slot of its rank. Only the histogram reaches the driver: its size is
the number of classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, durable, table
from .tokens import END_ID, encoder, vocabulary_path

CAPACITY = 2048
UNIT = 8


def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best multiset of sizes 1..len(values) within capacity, as counts, and its value."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        got = best[c - 1 :: -1][: len(values)] + values[: min(c, len(values))]
        i = int(np.argmax(got))
        if got[i] > best[c - 1] + 1e-12:
            best[c], last[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), dtype=np.int64), capacity
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def relax(demand: np.ndarray, capacity: int, gap: float = 3e-3, max_rounds: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers whose slots can hold the demand of sizes 1..len(demand).

    Revised simplex method. Besides patterns there are columns without cost that let a size take a
    slot of the next larger size; they keep the dual prices in order and save most of the knapsacks.
    It ends when the value is within `gap` of the lower bound (Farley's, or the demand's total size).
    """
    sizes = np.arange(1, len(demand) + 1)
    m = len(sizes)
    columns, cost = np.diag(capacity // sizes).astype(np.float64), np.ones(m)
    inverse, x = np.diag(1.0 / np.diag(columns)), demand / np.diag(columns)
    bound = float((demand * sizes).sum()) / capacity
    for _ in range(max_rounds):
        prices = cost @ inverse
        order = prices[:-1] - prices[1:]
        j = int(np.argmax(order)) if m > 1 else 0
        if m > 1 and order[j] > 1e-7:
            column, c = np.zeros(m), 0.0
            column[j], column[j + 1] = 1, -1
        else:
            value, counts = price(np.maximum(prices, 0), capacity)
            total = float(cost @ x)
            bound = max(bound, total / max(value, 1.0))
            if value <= 1 + 1e-9 or total - bound <= gap * bound:
                break
            column, c = counts.astype(np.float64), 1.0
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        r = max(float(ratio[out]), 0.0)
        x = np.maximum(x - r * step, 0)
        x[out], columns[:, out], cost[out] = r, column, c
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    used = cost > 0
    return columns.T[used].astype(np.int64), x[used]


def best_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold the sizes left over from rounding, longest first, each where it leaves least room."""
    bins: list[tuple[int, np.ndarray]] = []  # room and counts
    for size in range(len(left), 0, -1):
        for _ in range(int(left[size - 1])):
            fit = min((i for i, (room, _) in enumerate(bins) if room >= size), key=lambda i: bins[i][0], default=None)
            if fit is None:
                bins.append((capacity, np.zeros(len(left), dtype=np.int64)))
                fit = len(bins) - 1
            bins[fit][1][size - 1] += 1
            bins[fit] = (bins[fit][0] - size, bins[fit][1])
    return [counts for _, counts in bins]


def slots(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, first sequence, slots per sequence, first slot): where the ranks of a size go."""
    sequence, rows, left = 0, [], demand.astype(np.int64).copy()
    rank = np.zeros(len(demand), dtype=np.int64)

    def take(free: list[list[int]], i: int) -> None:
        while left[i] and free:
            base, per, at, end = free[-1]
            n = min(end - at, int(left[i]))
            rows.append((int(i) + 1, int(rank[i]), int(rank[i]) + n, base, per, at))
            rank[i] += n
            left[i] -= n
            free[-1][2] += n
            if at + n == end:
                free.pop()

    if demand.any():
        by_size: list[list[list[int]]] = [[] for _ in demand]
        for p, v in zip(*relax(demand, capacity), strict=True):
            if (times := int(v + 1e-6)) > 0:
                for i in np.flatnonzero(p):
                    by_size[i].append([sequence, int(p[i]), 0, int(p[i]) * times])
                sequence += times
        free: list[list[int]] = []
        for i in range(len(demand) - 1, -1, -1):  # the own size's slots first, then larger ones that are free
            free += by_size[i]
            take(free, i)
        for counts in best_fit(left, capacity):
            for i in np.flatnonzero(counts):
                take([[sequence, int(counts[i]), 0, int(counts[i])]], i)
            sequence += 1
    return rows


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).ids, np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for doc_ids, texts in arrow_rows(batches, "doc_id", "text"):
            rows, held = [], 0
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    rows.append((doc_id, at, min(capacity, n - at), n, ids[4 * at : 4 * (at + capacity)]))
                held += n
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): whole texts as ids and the end id, cut every `capacity` ids.

    ids holds little-endian unsigned 32-bit numbers. A null text is empty and gives the end id alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(path or vocabulary_path(), capacity, end_id), "doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, carry: dict[str, Column] | None = None, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, *carry, sequence_id, offset) of each piece of each row of docs.

    carry names columns computed from the pieces (by default `ids` themselves) before anything is
    stored, so a caller who needs a digest alone moves no ids. Each row is a document of its own,
    also where doc_ids repeat or are null; other columns are ignored; an empty table gives no rows.
    Pieces of a class are ranked by input partition and place, without one task per class: a count
    of each class and partition gives where its ranks begin.
    """
    spark, k = docs.sparkSession, -(-capacity // unit)
    cut = pieces(docs, path, capacity, end_id)
    kept = {"ids": F.col("ids")} if carry is None else carry
    cut = cut.select("doc_id", "start", "length", "doc_tokens", *[c.alias(n) for n, c in kept.items()], F.monotonically_increasing_id().alias("piece_id"))
    cut = durable(cut, "pieces").withColumns({"size": F.ceil(F.col("length") / unit).cast("int"), "part": F.shiftright("piece_id", 33)})
    counts = cut.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    demand = np.zeros(k, dtype=np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most k rows
        demand[r["size"] - 1] = r["n"]
    plan = spark.createDataFrame(slots(demand, k), "size int, first long, end long, base long, per long, at long")
    begin = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "part", F.coalesce(F.sum("n").over(begin), F.lit(0)).alias("before"))
    ranked = cut.withColumn("place", F.row_number().over(Window.partitionBy("size", "part").orderBy("piece_id")) - 1).join(counts, ["size", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    # At most 2k patterns, each with at most k sizes whose units fit the sequence: a few thousand rows.
    put = ranked.join(F.broadcast(plan), "size").where("rank >= first and rank < end").withColumn("sequence_id", F.expr("base + (rank - first + at) div per"))
    fill = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    return put.select("doc_id", "start", "length", "doc_tokens", *kept, "sequence_id", F.coalesce(F.sum("length").over(fill), F.lit(0)).alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), {"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
