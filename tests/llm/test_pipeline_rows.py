"""Stages of the pipeline decide on rows, whatever their doc_ids."""

import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, more=""):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + more


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def kept(df):
    return sorted(((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_near_duplicates_by_row(spark):
    a, b, c, d = (prose(k) for k in "abcd")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (5, c), (5, d), (None, a), (None, None), (None, ""), (7, " "), (7, " ")]
    out = P.drop_near_duplicates(spark, frame(spark, rows), "")
    assert out.columns == P.COLUMNS
    assert [(i, t) for i, t in kept(out) if (t or "").strip()] == sorted([("1", a), ("None", b), ("2", c), ("5", d)], key=str)
    assert sum(not (r.text or "").strip() for r in out.collect()) == 4
    assert P.drop_near_duplicates(spark, frame(spark, rows).limit(0), "").count() == 0


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_toxic_by_row(spark, labelled):
    bad = " zlorpid zlorpan "
    rows = [(i, prose(i, bad if i % 3 == 0 else " fine ")) for i in range(300)]
    extra = [(None, prose("x", bad)), (None, prose("y", " fine ")), (900, prose("z", bad)), (900, prose("w", " fine ")), (901, None)]
    out = kept(P.drop_toxic(spark, frame(spark, rows + extra), labelled))
    texts = {t for _, t in out}
    assert [t in texts for _, t in extra] == [False, True, False, True, True]
    assert 195 <= len(out) - 3 <= 205
