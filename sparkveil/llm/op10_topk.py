"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every vector block keeps, for each dimension, its rows sorted by value. A query reads these lists
from the end that favours it, a stretch at a time. A row's lower bound counts the entries seen and
the worst value for the others; its upper bound counts the entries seen and, for the others, the
value where their lists stand. When the k-th lower bound reaches the upper bound of every row
outside the k (and of rows not seen), no outsider can qualify; final scores are then resolved
for the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

SCALE = 1024
QUERY_BLOCK = 32_768  # queries that are sent to the executors at once
VECTOR_BLOCK = 8192  # rows that have sorted lists of their own
DEPTHS = (64, 32, 16, 8, 4, 2, 1)  # lists are read to these parts of their length, as far as needed
RESOLVE = 64  # rows of a block that may still qualify when reading stops; their scores are resolved
_SAFE = 1 << 22  # beyond this size of a component, products are taken with Python's integers


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows with an id and a vector whose components are all finite; others take no part."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)


def integers(rows: list[list[float]], dims: int) -> np.ndarray:
    """floor(SCALE * x) of each row; shorter rows are filled with 0, longer ones give wider results elsewhere."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out = np.floor(SCALE * out)
    return out.astype(np.int64) if not out.size or np.abs(out).max() < _SAFE else np.array([[int(v) for v in r] for r in out], dtype=object)


class Lists:
    """The sorted lists of a block of rows: down[d, i] is the row with the i-th highest value in dimension d, up[d, i] with the i-th lowest."""

    def __init__(self, x: np.ndarray):
        self.x = x
        if x.dtype != object and len(x):
            self.up = np.argsort(x.T, axis=1, kind="stable")
            self.rising = np.take_along_axis(x.T, self.up, axis=1).astype(np.float64)
            self.down, self.falling = self.up[:, ::-1].copy(), self.rising[:, ::-1].copy()

    def read(self, q: np.ndarray, mark: float, k: int, open_: np.ndarray) -> np.ndarray:
        """Rows among open_ that may be among the k best or reach mark, after sequential reads of the lists."""
        n = len(self.x)
        # Each list is read from its best end: the highest value for a positive weight, the lowest for a negative.
        pos, neg = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        weight = q[np.concatenate((pos, neg))].astype(np.float64)[:, None]
        worst = np.concatenate((self.rising[pos, 0], self.falling[neg, 0]))[:, None] * weight
        gain, read, at = np.zeros(n), [], 0  # gain: what the entries seen add to the worst values
        for depth in DEPTHS:
            to = max(1, min(n, -(-n // depth)))
            if to == at:
                continue
            read.append(np.concatenate((self.down[pos, at:to], self.up[neg, at:to])))
            values = np.concatenate((self.falling[pos, at:to], self.rising[neg, at:to])) * weight - worst
            gain += np.bincount(read[-1].ravel(), weights=values.ravel(), minlength=n)
            at, stop = to, values[:, -1:]
            low = high = worst.sum() + gain
            if to < n:
                high = low + stop.sum()
                for rows in read:
                    high -= np.bincount(rows.ravel(), weights=np.broadcast_to(stop, rows.shape).ravel(), minlength=n)
            if len(open_) > k:
                mark = max(mark, np.partition(low[open_], len(open_) - k)[len(open_) - k])
            open_ = open_[high[open_] >= mark - 1 - 1e-9 * abs(mark)]
            if len(open_) <= max(k, RESOLVE) or to == n:  # no other row can qualify
                break
        return open_

    def top(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, mark: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows, best first, without the row of id own; rows below mark may lack."""
        open_ = np.flatnonzero(ids != own)
        if self.x.dtype != object and q.dtype != object and len(open_) > k and q.any():
            open_ = self.read(q, mark, k, open_)
        score = self.x[open_].dot(q)
        if len(open_) > k and score.dtype != object:
            keep = score >= np.partition(score, len(open_) - k)[len(open_) - k]
            open_, score = open_[keep], score[keep]
        order = np.lexsort((ids[open_], -score))[:k]
        return ids[open_][order], score[order]


def _search(queries: tuple[np.ndarray, np.ndarray], k: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = queries
        held_ids: list[int] = []
        marks = [-np.inf] * len(q_ids)  # the k-th best score so far in this task
        held: list[list[float]] = []

        def flush() -> pa.RecordBatch:
            dims = max(q.shape[1], max((len(r) for r in held), default=0))
            ids, lists = np.array(held_ids, dtype=np.int64), Lists(integers(held, dims))
            wide = np.zeros((len(q), dims), dtype=q.dtype)
            wide[:, : q.shape[1]] = q
            out = [(qi, lists.top(row, ids, qi, k, m)) for qi, row, m in zip(q_ids.tolist(), wide, marks, strict=True)]
            marks[:] = [max(m, float(ss[-1])) if len(ss) == k else m for m, (_, (_, ss)) in zip(marks, out, strict=True)]
            top = (1 << 63) - 1
            score = [max(-top - 1, min(top, int(s))) for _, (_, ss) in out for s in ss]
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([qi for qi, (ii, _) in out for _ in ii], pa.int64()), pa.array([int(i) for _, (ii, _) in out for i in ii], pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            held_ids += b.column(0).to_pylist()
            held += b.column(1).to_pylist()
            while len(held) >= block:
                rest_ids, rest = held_ids[block:], held[block:]
                del held_ids[block:], held[block:]
                yield flush()
                held_ids += rest_ids
                held += rest
        if held:
            yield flush()

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query row.

    queries: a condition on vec_id that says which rows are queries. Queries go out in blocks of at
    most query_block rows, so what is sent at once has a fixed size; each block is held against all
    rows, each row block giving at most k rows for a query. Ties go to the smaller vec_id. A query's
    own row (its vec_id) is no candidate. Other columns are ignored; an empty table gives no rows. Vectors with null or non-finite parts, and rows without id,
    take no part; vectors of unequal length are filled with 0. Of rows with one vec_id, queries take
    the first by value; each is a candidate of its own. Scores beyond 64 bits are set to the limit.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vec_col)
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    found, last = None, None
    while True:
        part = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(query_block).collect()
        if not part:
            break
        last = part[-1]["vec_id"]
        ids = np.array([r["vec_id"] for r in part], dtype=np.int64)
        xs = [r["x"] for r in part]
        q = integers(xs, max(len(x) for x in xs))
        one = rows.mapInArrow(_search((ids, q), k, vector_block), "query_id long, vec_id long, score long")
        if found is not None or len(part) == query_block:
            one = durable(one, "found")  # the plan does not grow with the queries
        found = one if found is None else found.union(one)
        if len(part) < query_block:
            break
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    # k rows for each block of rows and query: first within a share of the blocks, then over all.
    order = [F.col("score").desc(), F.col("vec_id")]
    share = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
