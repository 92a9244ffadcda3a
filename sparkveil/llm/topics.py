"""Topics of texts: spherical k-means over signed sums of hashed words, fitted on every document.

A text becomes DIM whole numbers; the centres come from sums of whole numbers over all texts, so they are the same
however rows are dealt to tasks. Only sums of TOPICS x DIM numbers reach the driver, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, mix64

DIM = 64
TOPICS = 8
ROUNDS = 6
STEM = 8  # bytes of a word by which it is told from others
PIECE = 1 << 21  # bytes of text that are looked at together
SCALE = 1 << 16


def sketch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and its vector (n x DIM, of length 127 about): hashed words with signs, summed up.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Null and empty texts have no words and a vector of zeros.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.empty(0, np.uint8)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    tokens, sums = np.zeros(n, np.int64), np.zeros(n * DIM)
    for a in range(int(ends[0]), int(ends[-1]), PIECE):
        b = min(a + PIECE, int(ends[-1]))
        blank = space[data[a:b]]
        first = ~blank
        first[1:] &= blank[:-1]
        if a > ends[0] and not space[data[a - 1]]:
            first[0] = False
        begins = ends[:-1][(ends[:-1] >= a) & (ends[:-1] < b)] - a  # a text's first letter begins a word, whatever stands before
        first[begins] = ~blank[begins]
        at = np.flatnonzero(first) + a
        owner = np.searchsorted(ends, at, side="right") - 1
        left = ends[owner + 1] - at
        key, inside = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
        for k in range(STEM):
            letter = data[np.minimum(at + k, len(data) - 1)]
            inside &= (left > k) & ~space[letter]
            key = (key << np.uint64(8)) | np.where(inside, lower[letter], np.uint64(0))
        h = mix64(key)
        cell = owner * DIM + (h & np.uint64(DIM - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
        low, high = (int(owner[0]), int(owner[-1]) + 1) if len(at) else (0, 0)
        sums[low * DIM : high * DIM] += np.bincount(cell - low * DIM, weights=sign, minlength=(high - low) * DIM)
        tokens[low:high] += np.bincount(owner - low, minlength=high - low)
    v = sums.reshape(n, DIM)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return tokens, np.rint(np.divide(127 * v, length, out=np.zeros_like(v), where=length > 0)).astype(np.int8)


class Topics:
    """Directions of the topics from the mean of all texts, in whole numbers."""

    def __init__(self, mean: np.ndarray, centres: list[np.ndarray | None]):
        units = [np.zeros(DIM) if c is None or not np.linalg.norm(c - mean) else (c - mean) / np.linalg.norm(c - mean) for c in centres]
        self.units = np.rint(SCALE * np.array(units)).astype(np.int64).reshape(len(centres), DIM)
        self.least = np.array([1 << 60 if c is None else int(np.rint(SCALE * (mean @ u))) for c, u in zip(centres, units, strict=True)])

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the topic that each vector lies in most; the smaller one at a tie."""
        return np.argmax(vectors.astype(np.int64) @ self.units.T - self.least, axis=1)


def named(tokens: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """topic0, topic1, ...; none for texts without words."""
    return pa.array([f"topic{k}" if t else "none" for t, k in zip(tokens.tolist(), numbers.tolist(), strict=True)], pa.string())


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), DIM)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, vectors = sketch(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["source", "lang", "tokens", "vector"])


def sketches(docs: DataFrame) -> DataFrame:
    """(source, lang, tokens, vector) of every row; written to the shared folder, as it is read in each round."""
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return durable(rows.mapInArrow(_sketches, "source string, lang string, tokens long, vector binary"), "sketches")


def _sums(number):
    """Sums of the vectors with words, of their squares and their count, by number(vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _vectors(batch.column(0)).astype(np.int64)
            numbers = number(x)
            for k in np.unique(numbers).tolist():
                mine = x[numbers == k]
                total[k] = total.get(k, 0) + np.stack([mine.sum(axis=0), (mine * mine).sum(axis=0), np.full(DIM, len(mine))])
        k = np.repeat(list(total), DIM).astype(np.int64)
        s = np.concatenate([t.T for t in total.values()]) if total else np.empty((0, 3), np.int64)
        dims = np.tile(np.arange(DIM), len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k, dims, *np.ascontiguousarray(s.T).astype(np.int64))], names=["k", "d", "x", "xx", "n"])

    return run


def _gather(vectors: DataFrame, number) -> dict[int, np.ndarray]:
    """number -> sums, squares and count (3 x DIM) over all rows."""
    sums = vectors.mapInArrow(_sums(number), "k long, d long, x long, xx long, n long").groupBy("k", "d").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # as many rows as topics times DIM
        out.setdefault(r["k"], np.zeros((3, DIM), np.int64))[:, r["d"]] = r["x"], r["xx"], r["n"]
    return out


def _scatter(sums: np.ndarray) -> np.ndarray:
    """Squared distances from the mean, by number of the vector."""
    x, xx, n = sums
    return xx - x * x / n


def _lloyd(vectors: DataFrame, mean: np.ndarray, found: dict[int, np.ndarray], rounds: int) -> tuple[Topics, list[np.ndarray]]:
    """The topics after some rounds, the one of most texts first, and their sums in the last one."""
    for r in range(rounds + 1):
        sums = [found[k] for k in sorted(found, key=lambda k: (-int(found[k][2, 0]), k))]
        model = Topics(mean, [s[0] / s[2, 0] for s in sums])
        if r < rounds:
            found = _gather(vectors, model.of)
    return model, sums


def fit(rows: DataFrame, topics: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics of all rows (tokens, vector) with words; without such rows one topic.

    Starts from one topic and cuts those of most scatter in two, where they vary most, with rounds of k-means after each
    step. A topic that loses all its texts is not used any more. The topics are numbered by their count of texts, the largest first.
    """
    vectors = rows.where("tokens > 0").select("vector")
    found = _gather(vectors, lambda x: np.zeros(len(x), np.int64))
    if not found:
        return Topics(np.zeros(DIM), [np.zeros(DIM)])
    mean = found[0][0] / found[0][2, 0]
    model, sums = _lloyd(vectors, mean, found, 0)
    for _ in range(2 * topics.bit_length()):
        scatter = [float(_scatter(s).sum()) for s in sums]
        cut = [k for k in sorted(range(len(sums)), key=lambda k: (-scatter[k], k)) if scatter[k] > 0][: topics - len(sums)]
        if not cut:
            break

        def halves(x: np.ndarray, model: Topics = model, sums: list[np.ndarray] = sums, cut: list[int] = cut) -> np.ndarray:
            number = model.of(x)
            out = number.copy()
            for i, k in enumerate(cut):
                d = int(np.argmax(_scatter(sums[k])))
                out[(number == k) & (x[:, d] * sums[k][2, d] > sums[k][0, d])] = len(sums) + i
            return out

        model, sums = _lloyd(vectors, mean, _gather(vectors, halves), rounds // 2)
    return _lloyd(vectors, mean, dict(enumerate(sums)), rounds)[0]


def topic_of_vector(model: Topics, tokens: str, vector: str) -> Column:
    @F.arrow_udf("string")
    def tag(tokens: pa.Array, vectors: pa.Array) -> pa.Array:
        return named(tokens.to_numpy(zero_copy_only=False), model.of(_vectors(vectors)))

    return tag(tokens, vector)


def tokens_and_topic(model: Topics, text: Column) -> Column:
    """struct (tokens, topic) of a text."""

    @F.arrow_udf("struct<tokens: long, topic: string>")
    def tag(texts: pa.Array) -> pa.Array:
        tokens, vectors = sketch(texts)
        return pa.StructArray.from_arrays([pa.array(tokens), named(tokens, model.of(vectors))], names=["tokens", "topic"])

    return tag(text.cast("string"))
