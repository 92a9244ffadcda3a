"""Sketches against a plain loop over words; clusters that tell vocabularies apart; one model however rows are dealt."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import op8_mixing
from sparkveil.llm import topics as T
from sparkveil.llm.common import mix64, words_of


def plain(text):
    v = np.zeros(T.DIM)
    words = words_of(text)
    for w in words:
        h = int(mix64(np.array([int.from_bytes(w[: T.STEM].ljust(T.STEM, b"\0"), "big")], np.uint64))[0])
        v[h % T.DIM] += -1 if h >> 32 & 1 else 1
    length = np.sqrt((v * v).sum())
    return len(words), np.rint(127 * v / length if length else v).astype(int).tolist()


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 21])
def test_sketch_equals_loop(monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    texts = [None, "", " \n\t ", "One two  Three", "end", "start again", "é à la carte\x0bunter", " lead", "trail ", "extraordinarily extraordinary", "x" * 40, None, "a b"]
    for column in (pa.array(texts), pa.array(["cut", *texts])[1:], pa.array([], pa.string())):
        tokens, vectors = T.sketch(column)
        assert [(t, v.tolist()) for t, v in zip(tokens.tolist(), vectors, strict=True)] == [plain(x) for x in column.to_pylist()]


def test_topics(spark):
    r = random.Random(3)
    vocabulary = [[f"{chr(97 + k)}{i}w" for i in range(60)] for k in range(4)]
    rows = [(i, " ".join(r.choice(vocabulary[i % 4]) for _ in range(r.randint(30, 80))), "en", f"s{i % 3}") for i in range(400)] + [(900, None, None, None), (901, "", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = [T.fit(T.sketches(docs.repartition(n))) for n in (1, 5)]
    assert (models[0].units == models[1].units).all() and (models[0].least == models[1].least).all()
    mixed = op8_mixing.mix(docs.withColumn("mix_topic", F.lit(1))).collect()
    by_topic = {}
    for m in mixed:
        by_topic.setdefault(m.mix_topic, []).append(m.doc_id % 4)
        assert m.mix_tokens == len(words_of(m.text))
    assert len(by_topic.pop("none")) == 2
    assert sum(max(map(v.count, range(4))) for v in by_topic.values()) >= 0.95 * 400  # purity


def test_topics_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert T.fit(T.sketches(empty)).of(np.ones((2, T.DIM), np.int8)).tolist() == [0, 0]
    assert T.sketch(pa.array([None], pa.string()))[0].tolist() == [0]
