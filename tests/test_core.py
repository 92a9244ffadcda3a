import re

from pyspark.sql import functions as F

from sparkveil.functions import text as X
from sparkveil.functions.rules import PATTERNS
from sparkveil.operators import detect as D
from sparkveil.operators import layout as L
from sparkveil.streaming import stateful as S

TEXTS = [(1, "Call 555-123-4567 or mail a.b@x.org, MRN: ABC12345 voice"), (2, None), (3, ""), (4, "é555 SN 12AB34 Fax: +123456789 UID Z-9999 12/05/2020 10.0.0.1"), (5, "AB12345 AB12345")]


def frame(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def plain(text):
    out = []
    for k, (name, p, i) in enumerate(PATTERNS):
        out += [(k, name, m.start(), m.end(), m.group()) for m in re.finditer(p, text or "", re.I if i else 0)]
    return out


def test_detect_equals_python(spark):
    got = {tuple(r) for r in D.detect(frame(spark)).select("doc_id", "ord", "phi_type", "start", "end", "text").collect()}
    assert got == {(i, *m) for i, t in TEXTS for m in plain(t)}


def test_merge_equals_python(spark):
    want = set()
    for i, t in TEXTS:
        kept = []
        for _, name, s, e, x in sorted(plain(t), key=lambda m: (m[0], m[2])):
            for k in kept:
                if k[0] < e and s < k[1]:
                    k[0], k[1], k[4] = min(k[0], s), max(k[1], e), k[4] + 1
                    break
            else:
                kept.append([s, e, name, x, 0])
        want |= {(i, *k) for k in kept}
    got = {tuple(r) for r in D.merge(D.detect(frame(spark))).select("doc_id", "start", "end", "phi_type", "text", "merged").collect()}
    assert got == want


def test_anonymise(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.org now"), (2, None), (3, "nothing")], "doc_id long, text string")
    rules = [r for r in PATTERNS if r[0] == "email_addresses"]
    got = {r.doc_id: (r.n_spans, r.anonymized_text) for r in D.anonymise(docs, D.detect(docs, patterns=rules)).collect()}
    assert got == {1: (1, "mail [REDACTED_EMAIL] now"), 2: (0, None), 3: (0, "nothing")}


def test_masks(spark):
    row = spark.range(1).select(
        X.mask_digits(F.lit("12-34 5678"), "*", 6, True).alias("a"), X.mask_digits(F.lit("12-34 5678"), "X", 3, False).alias("b"), X.mask_digits(F.lit("abcdef"), "X", 4, True).alias("c"),
        X.email_partial(F.lit("joe@x.org")).alias("d"), X.truncated(F.lit("abcdef"), 3).alias("e"),
    ).first()
    assert tuple(row) == ("12-** ****", "XX-X4 5678", "XXXXef", "j***@x.org", "abc...")


def test_regions(spark):
    rows = [(1, 0, 0, 0, 100, 100, 0.5, False), (1, 1, 10, 10, 20, 20, 0.9, True), (1, 2, 200, 0, 210, 10, 0.1, True), (2, 0, 0, 0, 10, 10, 0.3, False)]
    r = spark.createDataFrame(rows, "page int, region_id long, x1 int, y1 int, x2 int, y2 int, confidence double, low_confidence boolean")
    got = {(x.page, x.region_id, x.x1, x.x2, x.merged, x.low_confidence) for x in L.merge_regions(r, "page").collect()}
    assert got == {(1, 1, 0, 100, 2, False), (1, 2, 200, 210, 1, True), (2, 0, 0, 10, 1, False)}


def test_confidence_split_keeps_best(spark):
    rows = spark.createDataFrame([(1, 0, "abcdefgh", 0.2), (1, 1, "abcdefgh", 0.3), (2, 0, "ab", 0.6), (2, 1, "abcdefgh", 0.6)], "g int, idx int, text string, confidence double")
    assert {(r.g, r.idx) for r in L.confidence_split(rows, "g").where("accepted").collect()} == {(1, 1), (2, 1)}


def test_state_machines():
    assert S.admit([0, 1, 2, 61, 61.5], [], 2, 60) == ([True, True, False, True, True], [61, 61.5])
    assert S.break_calls([(0, True), (1, True), (2, True), (3, False), (40, True), (41, False)], 0, float("-inf"), 3, 30)[0] == [True, True, True, False, True, False]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 3}", "error" if i % 4 == 0 else "view", float(i), f"2024-01-01 0{i % 5}:00:0{i % 7}") for i in range(40)], "event_id long, key string, event_type string, value double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.limit_stream(source.select("event_id", "key", "ts"), 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {tuple(r) for r in S.limit_requests(rows.select("event_id", "key", "ts"), 2, 60).collect()}
    assert {tuple(r) for r in spark.table("limited").collect()} == batch
    q = S.windowed_stream(source).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("windows").collect()) == 40


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
