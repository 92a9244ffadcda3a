"""Operators that work on whole pages: results as by the plain rules, also for keys of several rows, and only texts are dealt out."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.operators import layout as L
from sparkveil.operators import pages as P
from sparkveil.operators import remap as M
from sparkveil.plans import more, registry as R  # noqa: F401


def shuffled(df) -> list[str]:
    """Columns that the plan deals out, by exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange " in line]


@pytest.fixture(scope="module")
def some_docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    rng = random.Random(7)
    bits = ["the", "house", "The", "hous", "la", "casa", "x", "", "\thouse", "the\n", "é" * 9, "word", "y" * 120, "Jane", "Doe", "12345", "a@b.cd", "ABCDE-1", "the house"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(100, None), (101, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_adjacent_merge_equals_the_plain_rule(spark, some_docs):
    df = R.QUERIES["adjacent_merge"](spark, some_docs)
    assert len(shuffled(df)) == 1 and "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    joined = 0
    words = {}
    for w in R.QUERIES["word_boxes"](spark, some_docs).collect():
        words.setdefault(w.doc_id, []).append((w.word, w.x1, w.y1, w.x2, w.y2, round((w.doc_id + w.word_id) % 100 / 100, 2)))
    for k, rows in words.items():
        want = M.merge_adjacent(rows, ["the house", "la casa"])
        assert [(*r[:5], round(r[5], 9), r[6]) for r in want] == [(*r[:5], round(r[5], 9), r[6]) for r in got[k]]
        joined += sum(r[6] == 2 for r in want)
    assert joined > 20 and set(words) == set(got)


@pytest.mark.parametrize("threshold", [0.5, 1e-9, 0.0])
def test_links_of_boxes(threshold):
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 90):
        page = np.sort(rng.integers(0, 3, n))
        x, y, w, h = (rng.integers(0, m, n) for m in (60, 200, 40, 60))
        box = (x, y, x + w, y + h)
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                inter = max(0, min(box[2][i], box[2][j]) - max(x[i], x[j])) * max(0, min(box[3][i], box[3][j]) - max(y[i], y[j]))
                least = min(w[i] * h[i], w[j] * h[j])
                if page[i] == page[j] and least > 0 and inter / least >= threshold:
                    a, b = sorted((label[i], label[j]))
                    label = [a if v == b else v for v in label]
        assert P.linked(page, box, threshold).tolist() == label


def test_merged_regions_of_rows_and_of_texts(spark, some_docs):
    df = R.QUERIES["merged_regions"](spark, some_docs)
    plan = df._jdf.queryExecution().toString()
    assert len(shuffled(df)) == 1 and "FlatMapGroupsInPandas" not in plan  # texts are dealt out once, regions never
    rows = R.regions(spark, some_docs).selectExpr("*", "confidence < 0.5 AS low_confidence")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, L.merge_regions(rows, "doc_id", 0.5).collect()))


def test_whole_pages_across_batches():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, None, None, 5]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([str(i) for i in range(len(keys))])], names=["key", "text"])
    for step in (1, 2, 3, 11):
        for most in (1, 4, 100):
            parts = list(P.whole(iter([rows.slice(i, step) for i in range(0, len(keys), step)]), lambda b: np.ones(b.num_rows, int), most))
            assert [v for p in parts for v in p.column(1).to_pylist()] == rows.column(1).to_pylist()
            ends = [p.column(0).to_pylist() for p in parts]
            assert all(a[-1] != b[0] for a, b in zip(ends, ends[1:])) and all(len(e) <= most or len(set(e)) == 1 for e in ends)


def test_copies_of_a_row_are_one_page(spark):
    docs = spark.createDataFrame([(7, "aa b"), (7, "aa b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.word_id, r.word, r.start_char) for r in L.words(docs).collect()) == [(0, 0, "c", 0), (7, 0, "aa", 0), (7, 0, "aa", 3), (7, 1, "b", 6), (7, 1, "b", 8)]
    assert sorted((r.doc_id or 0, r.text, r.confidence) for r in L.regions(docs).collect()) == [(0, "c", None), (7, "aa aa b b", 0.17)]
