"""Offsets, rectangles, phrases, readers and sinks, records and images on small cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkveil.functions import boxes as B
from sparkveil.functions import records as R
from sparkveil.functions import text as X
from sparkveil.functions.rules import PATTERNS
from sparkveil.operators import detect as D
from sparkveil.operators import images as I
from sparkveil.operators import layout as L
from sparkveil.operators import remap as M
from sparkveil.sources import readers, sinks


def test_identity_and_shorter_names():
    assert M.index_map("hello world", "hello world") == list(range(12)) == M.token_map("hello world", "hello world")
    old, new = "Dr. John Smith MD, phone 555-1234", "Dr. [REDACTED] MD, phone [REDACTED]"
    for places in (M.token_map(old, new), M.index_map(old, new)):
        assert len(places) == len(old) + 1
        s, e = M.map_span(places, old.index("MD"), old.index("MD") + 2)
        assert new[s:e] == "MD"
    assert M.map_span(M.token_map("", "abc"), None, None) == (3, 3) and M.map_span(M.index_map(None, None), 0, 5) == (0, 0)


def test_token_map_equals_a_scan():
    r = random.Random(2)
    for _ in range(50):
        old = " ".join(r.choice(["a", "B", "cc", "Dd"]) for _ in range(r.randint(0, 12)))
        new = " ".join(r.choice(["A", "b", "CC", "x"]) for _ in range(r.randint(0, 12)))
        places, following, at = M.token_map(old, new), 0, 0
        starts = [i for i in range(len(new)) if new[i] != " " and (i == 0 or new[i - 1] == " ")]
        words = new.split()
        for w in old.split():
            hit = next((j for j in range(following, len(words)) if words[j].lower() == w.lower()), None)
            at = old.index(w, at)
            if hit is not None:
                assert places[at] == starts[hit]
                following = hit + 1
            at += len(w)


def test_remap_of_replacements(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.org or c@d.org now"), (2, None)], "doc_id long, text string")
    rules = [r for r in PATTERNS if r[0] == "email_addresses"]
    new = {r.doc_id: r.anonymized_text for r in D.anonymise_documents(docs, patterns=rules).collect()}
    spans = D.merge_documents(docs, patterns=rules, clear=True).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.value", X.apply_policy(D.entity(F.col("s.phi_type")), F.col("s.value")).alias("new"))
    got = M.remap_replaced(spans, "doc_id").collect()
    assert len(got) == 2 and all(new[r.doc_id][r.new_start : r.new_end] == r.new == "[REDACTED_EMAIL]" for r in got) and new[2] is None
    pairs = spark.createDataFrame([("a bc d", "A  bc x", 2, 4, 9), (None, None, 0, None, 9)], "old string, new string, start int, end int, more int")
    assert [(r.new_start, r.new_end, r.more) for r in M.remap(pairs, "words").collect()] == [(3, 5, 9), (0, 0, 9)]


def test_fused_paths_equal_the_steps(spark):
    text = "Call 555-123-4567 or mail a.b@x.org, MRN: ABC12345 voice AB12345 " * 3
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é555 SN 12AB34 Fax: +123456789 UID Z-9999 12/05/2020 10.0.0.1")], "doc_id long, text string")
    old = {tuple(r) for r in D.merge(D.detect(docs)).select("doc_id", "start", "end", "phi_type", "text", "merged").collect()}
    new = {tuple(r) for r in D.merge_documents(docs).select("doc_id", F.explode("spans").alias("k")).select("doc_id", "k.start", "k.end", "k.phi_type", "k.text", "k.merged").collect()}
    assert old == new and len(new) > 10
    assert {tuple(r) for r in D.anonymise(docs, D.detect(docs)).collect()} == {tuple(r) for r in D.anonymise_documents(docs).collect()}
    assert D.merge_documents(docs.limit(0)).count() == 0


def test_phrases():
    w = lambda t, x1, x2: (t, x1, 10, x2, 30, 0.9)
    merged = M.merge_adjacent([w("John", 10, 60), w("Doe", 62, 110), w("Age", 200, 240)], ["John Doe"])
    assert [(m[0], m[1], m[3], m[6]) for m in merged] == [("John Doe", 10, 110, 2), ("Age", 200, 240, 1)]
    assert [m[0] for m in M.merge_adjacent([w("John", 10, 60), w("Random", 300, 380), w("Doe", 400, 460)], ["John Doe"])] == ["John", "Random", "Doe"]
    assert [m[0] for m in M.merge_adjacent([w("Emily", 10, 70), w("D0e", 72, 120)], ["Emily Doe"], 70)] == ["Emily D0e"]
    assert M.ratio("", "") == 100 and M.merge_adjacent([], ["x"]) == [] and len(M.merge_adjacent([w(None, 0, 5)], [])) == 1


def test_boxes_by_text():
    words = [("Name", 0, 0, 10, 10), ("Jane", 12, 0, 30, 10), (" ", 31, 0, 32, 10), ("Roe", 40, 0, 60, 10)]
    assert M.text_boxes("jane", words) == (12, 0, 30, 10) and M.text_boxes("jane roe", words) == (0, 0, 60, 10) and M.text_boxes("xyz", words) is None and M.text_boxes(None, words) is None


def test_rectangles(spark):
    d = spark.sql("SELECT array(named_struct('x1', 10, 'y1', 10, 'x2', 20, 'y2', 20), named_struct('x1', 30, 'y1', 10, 'x2', 40, 'y2', 20)) AS w, named_struct('x1', 0, 'y1', 0, 'x2', 100, 'y2', 50) AS r")
    none = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    areas = lambda m: F.transform(m, B.area)
    got = d.select(
        areas(B.surgical_rectangles(F.col("w"), F.col("r"), F.lit("x"), 0, 200, 200)).alias("entity"), areas(B.surgical_rectangles(F.col("w"), F.col("r"), F.lit("x"), 0, 200, 200, False)).alias("words"),
        areas(B.surgical_rectangles(F.slice("w", 1, 1), F.col("r"), F.lit("x"), 2, 200, 200)).alias("pad"), B.surgical_rectangles(none, F.col("r"), F.lit("a: b"), 0, 200, 200)[0]["x1"].alias("split"),
        B.iou(F.col("w")[0], F.col("r")).alias("iou"), B.covered_area(F.array(F.col("w")[0], F.col("w")[1], F.col("r"))).alias("covered"), B.covered_area(F.col("w")).alias("apart"),
        areas(B.mask_rectangles(none, F.col("r"), 3, 50, 50)).alias("mask"), B.font_expansion(F.col("r")).alias("font"),
    ).first()
    assert (got.entity, got.words, got.pad, got.split, got.covered, got.apart, got.font) == ([300], [100, 100], [196], 40, 5000, 200, 15)
    assert abs(got.iou - 0.02) < 1e-12 and got.mask == [2500]


def test_span_boxes_of_long_documents(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "a", 0, len(text)), (1, "b", 510, 515), (1, "c", 2, 3)], "doc_id long, phi_type string, start int, end int")
    n = {r.phi_type: r.n_words for r in L.span_boxes(spans, L.words(docs)).collect()}
    at = 0
    want = {"a": 3000, "b": 0, "c": 0}
    for w in text.split(" "):
        want["b"] += 510 < at + len(w) and at < 515
        want["c"] += 2 < at + len(w) and at < 3
        at += len(w) + 1
    assert n == want


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.csv").write_text('document_id,pii_text,feedback_type,correct_label\n1,"Doe, J",FALSE_POSITIVE,name\n\n2,x\n')
    assert [tuple(r) for r in readers.read_feedback(spark, str(tmp_path / "f.csv")).collect()] == [("1", "Doe, J", "false_positive", "name"), ("2", "x", "", "")]
    (tmp_path / "g.jsonl").write_text('{"text": "a", "n": 1}\n\n  \nbroken\n')
    assert [tuple(r) for r in readers.read_lines(spark, str(tmp_path / "g.jsonl"), "text string, n int").collect()] == [("a", 1), (None, None)]
    (tmp_path / "p.json").write_text('{"good": "[0-9]+", "bad": "(", "none": null}')
    assert [r.name for r in readers.read_patterns(spark, str(tmp_path / "p.json")).collect()] == ["good"]
    (tmp_path / "v.txt").write_text("Dose\n\n rate \ndose\n")
    assert sorted(r.word for r in readers.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()) == ["dose", "rate"]
    assert readers.read_pages(spark, str(tmp_path / "v.txt")).first().text == "Dose\n\n rate \ndose\n"
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "NAME", "Jane", "X"), ("2024-01-02 10:00:00", "NAME", None, "Y")], "time string, entity_type string, original string, masked string")
    for _ in range(2):
        sinks.append_audit(rows, str(tmp_path / "audit"))
    back = spark.read.json(str(tmp_path / "audit"))
    assert back.count() == 4 and set(back.columns) == {"time", "entity_type", "original_len", "masked_len", "day"} and back.where("original_len = 4").count() == 2
    sinks.append_detections(rows, str(tmp_path / "a"), str(tmp_path / "b"), "original")
    assert spark.read.json(str(tmp_path / "a")).where("original = '[REDACTED]'").count() == 2 and spark.read.json(str(tmp_path / "b")).where("original = 'Jane'").count() == 1
    sinks.append_mapping(rows.select("original", F.lit("NAME").alias("entity"), F.col("masked").alias("replacement")), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).columns == ["original_hash", "entity", "replacement"]
    sinks.write_html(rows, str(tmp_path / "h"), "t")
    assert "<td>Jane</td>" in "".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())


def test_records(spark):
    one = spark.range(1)
    assert one.select(R.parse_keys(F.lit("a:admin, b ,a:user:x,,"))).first()[0] == {"b": "service_account", "a": "user:x"}
    m = F.create_map(F.lit("Text"), F.lit("x"), F.lit("my_SECRET"), F.lit("y"), F.lit("k"), F.lit("z"))
    assert one.select(R.redact_keys(m, ["text"]), R.redact_secrets(m)).first() == ({"Text": "<REDACTED>", "my_SECRET": "y", "k": "z"}, {"Text": "x", "my_SECRET": "[REDACTED]", "k": "z"})
    got = one.select(R.flatten_entities([F.lit("a, b,,a")], [F.array(F.lit("c"), F.lit("b"))])).first()[0]
    assert got == ["a", "b", "c"]
    assert one.select(X.clinical_text(F.lit("BP l0w 1 \u2019x  hr"))).first()[0] == "blood pressure lOw I 'x heart rate"


def test_images(spark):
    d = spark.range(2).select(F.col("id").alias("doc_id"), F.lit(4).alias("h"), F.lit(6).alias("w"), I.made(F.col("id"), 4, 6).alias("pixels")).union(spark.sql("SELECT 9L, 4, 6, CAST(NULL AS BINARY)"))
    rows = {r.doc_id: r for r in I.moments(d).collect()}
    p = np.array([[(7 + y * 5 + x * 3) % 256 for x in range(6)] for y in range(4)], np.uint8)
    assert rows[1].top == p.max() and abs(rows[1].mean - p.mean()) < 1e-6 and rows[9].mean is None
    out = {r.doc_id: r for r in I.painted(d.withColumn("boxes", F.array(B.box(-2, 0, 3, 2)))).collect()}
    q = p.copy()
    q[0:2, 0:3] = 0
    assert out[1].masked == q.tobytes() and I.psnr(p, p) == float("inf") and I.psnr(p, q) < 60
    assert (I.median_filter(np.full((3, 3), 7, np.uint8)) == 7).all() and I.text_density(np.zeros((1, 5), np.uint8)) == 0
    assert {r.doc_id: (r.h, r.w, r.pad) for r in I.standardised(d, 3).collect()}[0] == (2, 3, 0)
