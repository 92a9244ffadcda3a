"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Each class has its own counts of the highest order; all lower orders are continuation counts that both
classes share, so an expression that one class rarely shows is smoothed by what both know of
its parts, and what neither knows says nothing. A word's log-likelihood ratio divided by its length
is compared over the document and over its worst stretches. A logistic curve turns that into a
score; it is fitted on labelled rows as models see them that learnt from the other folds only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import arrow_rows, durable, fold, table, worker_cache

ORDER = 6
DISCOUNT = 0.75
DOCS_PER_CLASS = 5000  # labelled rows of a class that are learnt from at most
FOLDS = 3
THRESHOLD = 0.3
WINDOW = 8  # words of a stretch
GRAM_WORDS = 20_000  # words whose grams are counted at once
_EDGES = b" .,;:!?\"'()[]{}<>|*#$%&-_+=/\\~`^@"
_MASK = [(1 << (8 * k)) - 1 for k in range(9)]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().encode("utf-8", "replace").split()) if w] if text else []


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams that end at each byte of each word and at its end, and the word of each."""
    flat = np.frombuffer(b"".join(b"\x01" * (ORDER - 1) + w + b"\x02" for w in words), dtype=np.uint8)
    sizes = np.fromiter((len(w) + ORDER for w in words), dtype=np.int64, count=len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros(len(flat), dtype=np.uint64)
    for k in range(ORDER):
        keys[ORDER - 1 :] |= flat[ORDER - 1 - k : len(flat) - k].astype(np.uint64) << np.uint64(8 * k)
    real = place >= ORDER - 1
    return keys[real], owner[real]


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    """The values of wanted keys in a sorted table, `other` where there are none."""
    if not len(keys):
        return np.broadcast_to(np.asarray(other, dtype=np.float64), wanted.shape).copy()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def lower(types: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated Kneser-Ney probabilities from continuation counts: (keys, P) of the `order`-grams.

    types: distinct (order + 1)-grams. The lowest order is uniform over bytes.
    """
    keys, n = np.unique(types & np.uint64(_MASK[order]), return_counts=True)
    if order == 1:
        below = np.full(len(keys), 1 / 256)
    else:
        sub_keys, sub = lower(keys, order - 1)
        below = find(sub_keys, sub, keys & np.uint64(_MASK[order - 1]), 1 / 256)
    heads = keys >> np.uint64(8)
    _, head, kinds = np.unique(heads, return_inverse=True, return_counts=True)
    total = np.bincount(head, weights=n)
    return keys, (n - DISCOUNT) / total[head] + DISCOUNT * kinds[head] / total[head] * below


def gram_counts(words: list[bytes], *counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ORDER-grams of words and, for each of the words' counts, how often each gram occurs; counted some words at a time."""
    keys, sums = np.zeros(0, np.uint64), [np.zeros(0) for _ in counts]
    for i in range(0, len(words), GRAM_WORDS):
        part, owner = grams(words[i : i + GRAM_WORDS])
        new, which = np.unique(part, return_inverse=True)
        more = [np.bincount(which, weights=c[i : i + GRAM_WORDS][owner], minlength=len(new)) for c in counts]
        keys, which = np.unique(np.concatenate([keys, new]), return_inverse=True)
        sums = [np.bincount(which, weights=np.concatenate([a, b]), minlength=len(keys)) for a, b in zip(sums, more, strict=True)]
    return keys, sums


def train(words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood ratios of ORDER-grams, and of contexts whose next byte neither class has shown, from word counts."""
    if not words:
        none = np.zeros(0)
        return {"keys": none.astype(np.uint64), "ratio": none, "heads": none.astype(np.uint64), "back": none}
    keys, sums = gram_counts(words, toxic, ordinary)
    low_keys, low = lower(keys, ORDER - 1)
    shared = find(low_keys, low, keys & np.uint64(_MASK[ORDER - 1]), 1 / 256)
    heads, head = np.unique(keys >> np.uint64(8), return_inverse=True)
    log_p, back = [], []
    for c in sums:
        total = np.bincount(head, weights=c, minlength=len(heads))
        kinds = np.bincount(head, weights=c > 0, minlength=len(heads))
        held = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
        own = np.where(total[head] > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total[head], 1e-9), 0.0)
        log_p.append(np.log(own + held[head] * shared))
        back.append(np.log(held))
    return {"keys": keys, "ratio": (log_p[0] - log_p[1]).astype(np.float32), "heads": heads, "back": (back[0] - back[1]).astype(np.float32)}


def ratios(model: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    if not words:
        return np.zeros(0)
    keys, owner = grams(words)
    back = find(model["heads"], model["back"], keys >> np.uint64(8), 0.0)
    return np.bincount(owner, weights=find(model["keys"], model["ratio"], keys, back), minlength=len(words))


class Ratios(dict):
    """Word -> (ratio, length), filled a batch of documents at a time."""

    LIMIT = 250_000

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model

    def learn(self, docs: list[list[bytes]]) -> None:
        if len(self) > self.LIMIT:
            self.clear()
        new = list({w for d in docs for w in d if w not in self})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.update(zip(part, ratios(self.model, part).tolist(), strict=True))


FEATURES = 5


def features(words: list[bytes], known: Ratios) -> np.ndarray:
    """Length-normalised ratios: of the document, of its worst stretch, of its worst words; and its length."""
    n = len(words)
    if not n:
        return np.zeros(FEATURES)
    r = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=n)
    size = np.fromiter(map(len, words), dtype=np.float64, count=n) + 1
    sums, sizes = np.concatenate(([0], np.cumsum(r))), np.concatenate(([0], np.cumsum(size)))
    w = min(WINDOW, n)
    worst = ((sums[w:] - sums[:-w]) / (sizes[w:] - sizes[:-w])).max()
    each = r / size
    top = np.sort(np.partition(each, n - min(3, n))[n - min(3, n) :])
    return np.array([sums[-1] / sizes[-1], worst, top[-1], top.mean(), np.log1p(n)])


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        counts: dict[tuple[int, int], Counter] = {}
        for texts, toxics, folds in arrow_rows(batches, "text", "toxic", "fold"):
            for text, toxic, part in zip(texts, toxics, folds, strict=True):
                counts.setdefault((part, toxic), Counter()).update(tokens(text))
        for (part, y), c in counts.items():
            words = list(c)
            for i in range(0, len(words), 100_000):
                some = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([part] * len(some), pa.int32()), pa.array([y] * len(some), pa.int32()), pa.array([c[w] for w in some], pa.int64())], names=["word", "fold", "toxic", "n"])

    return run


def _measure(models, batch_docs: int = 1000):
    """Features by models.value: one model, or one for each value of a column `fold`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        known = [Ratios(m) for m in models.value]
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            which = batch.column(names.index("fold")).to_pylist() if "fold" in names else [0] * len(texts)
            rows = []
            for i in range(0, len(texts), batch_docs):
                docs, parts = [tokens(t) for t in texts[i : i + batch_docs].to_pylist()], which[i : i + batch_docs]
                for k, own in enumerate(known):
                    own.learn([d for d, part in zip(docs, parts, strict=True) if part == k])
                rows += [features(d, known[part]).tolist() for d, part in zip(docs, parts, strict=True)]
            keep = [f for f in names if f not in ("text", "fold")]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(f)) for f in keep], pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bounded(labelled: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of each label, first by a hash of doc_id."""
    parts = [labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for y in (0, 1)]
    return parts[0].union(parts[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = DOCS_PER_CLASS) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(model, curve, scale) from rows of labels whose doc_id meets `learn`, at most `limit` of each label.

    Rows of labels with another label than 0 and 1 are not used; where a doc_id has several labels,
    1 holds.
    """
    spark = docs.sparkSession
    ids = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    chosen = _bounded(ids, limit).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    # The chosen ids are at most 2 * limit, so they may go to every task.
    some = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold"), "labelled")
    each = [F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(FOLDS)]
    got = some.mapInArrow(_count(), "word binary, fold int, toxic int, n long").groupBy("word").agg(*each).toArrow().combine_chunks()  # words of at most 2 * limit documents
    words = got["word"].to_pylist()
    counts = {(y, k): got[f"n{y}_{k}"].to_numpy().astype(np.float64) for y in (0, 1) for k in range(FOLDS)}
    sums = [sum(counts[y, k] for k in range(FOLDS)) for y in (0, 1)]

    def model(toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
        used = np.flatnonzero(toxic + ordinary)
        return train([words[i] for i in used], toxic[used], ordinary[used])

    shared = spark.sparkContext.broadcast([model(sums[1] - counts[1, k], sums[0] - counts[0, k]) for k in range(FOLDS)])
    rows = some.mapInArrow(_measure(shared), "toxic int, features array<double>").collect()
    shared.destroy()
    x = np.array([r["features"] for r in rows]).reshape(len(rows), FEATURES)
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    scale = np.stack([x.mean(axis=0), x.std(axis=0) + 1e-6]) if len(x) else np.stack([np.zeros(FEATURES), np.ones(FEATURES)])
    if len(np.unique(y)) < 2:
        return model(sums[1], sums[0]), -4 * np.eye(FEATURES + 1)[0], scale
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (1 - y).sum())
    return model(sums[1], sums[0]), logistic((x - scale[0]) / scale[1], y, weight * len(y) / weight.sum()), scale


def _score(model, curve: np.ndarray, scale: np.ndarray):
    measure = _measure(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in measure(batches):
            x = np.array(batch.column(batch.num_columns - 1).to_pylist()).reshape(batch.num_rows, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(curve[0] + ((x - scale[0]) / scale[1]) @ curve[1:], -30, 30)))
            keep = list(range(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(p, pa.float64()), pa.array(x[:, 0], pa.float64()), pa.array(x[:, 1], pa.float64())], names=[*[batch.schema.names[i] for i in keep], "score", "ratio", "worst"])

    return run


def _opened(run):
    """run over batches of whole rows: their text is laid beside them."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), "text")], names=["row", "text"]) for b in batches)

    return opened


def score_rows(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = DOCS_PER_CLASS) -> DataFrame:
    """row, a struct of all columns of docs, with score, ratio and worst of that very row; see score()."""
    model, curve, scale = fit(docs, labels, learn, limit)
    shared = docs.sparkSession.sparkContext.broadcast([model])
    rows = docs.select(F.struct("*").alias("row"))
    schema = StructType([rows.schema["row"], *[StructField(n, DoubleType()) for n in ("score", "ratio", "worst")]])
    return rows.mapInArrow(_opened(_score(shared, curve, scale)), schema)


def score(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = DOCS_PER_CLASS) -> DataFrame:
    """doc_id, score, ratio, worst of each row of docs.

    score: 0 to 1, how likely label 1 is, from the whole text alone; ratio and worst: the length-normalised
    log-likelihood ratio of the document and of its worst stretch. A null text counts as empty; a
    row without words is scored by the curve at ratio 0. Equal texts have equal scores. Without labels of
    both kinds every score is low. Other columns are ignored; an empty table gives no rows.
    """
    model, curve, scale = fit(docs, labels, learn, limit)
    shared = docs.sparkSession.sparkContext.broadcast([model])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, curve, scale), "doc_id long, score double, ratio double, worst double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "ratio", "worst")
