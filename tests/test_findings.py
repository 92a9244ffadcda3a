"""One test for each finding of round 3: equal to the plain rule, with no step that grows faster than the input."""

import random
import re
from difflib import SequenceMatcher

import duckdb
import pytest

from sparkveil.functions.finders import RULES, finder
from sparkveil.operators import images as I
from sparkveil.operators import remap as M
from sparkveil.plans import more  # noqa: F401
from sparkveil.plans import registry as R
from sparkveil.streaming import stateful as S


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("docs"))
    rng = random.Random(5)
    bits = ["the", "house", "", "x", "word" * 9, "y" * 120, "Jane", "Doe", "123456789", "a@b.cd", "ABCDE-1", "12 May 2020", "Main Street", "MRN: AB12345", "é", "ABCDE-1"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 90)))) for i in range(50)] + [(100, None), (101, ""), (None, "Jane Doe ABCDE-1 and 123456789")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["confidence_split", "detection_regions", "span_boxes", "words_in_blocks", "surgical_boxes", "word_rescue", "merged_regions", "remapped_spans", "type_coverage"])
def test_pages_equal_the_sql(spark, docs_dir, name):
    df = R.QUERIES[name](spark, docs_dir)
    if name not in ("remapped_spans", "type_coverage"):
        assert "Window" not in plan(df) and "Join" not in plan(df) and "posexplode" not in plan(df) and plan(df).count("\n+- Exchange") <= 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs_dir}/documents.parquet/*.parquet')")
    want = con.execute(R.SQL[name])
    columns = [c[0] for c in want.description]
    key = lambda rows: sorted(tuple((v is not None, round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    got = key(map(tuple, df.select(*columns).collect()))
    assert got == key(want.fetchall()) and len(got) > 10


def test_finders_equal_the_rules():
    bits = ["+", "(", ")", "1", "12", "123", "555", "4567", "12345", "123456789", "-", "-", ".", "/", " ", "\n", "_", "a", "Z", "é", "١", "ı", "ſ", "İ", "K", "@", "x@y.z", "b.c", "MRN", "mrn:", "Medical", "Record", "No.", "Acct", "Account", "Lic", "LICENSE", "lt", "RN", "Md", "Sn", "sn", "Serial", "FAX", "UID", "uıd", "iris", "İris", "Retina", "photo", "FULL-FACE", "Street", "St", "Ave", "Rd", "Main", "Jane", "Doe", "voice", "www.", "https://", "ABCDE", "AB-12", "--", "A1B2C3", ":", "#"]
    rng = random.Random(1)
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(6000))]
    for name, regex, ignore in RULES.values():
        p = re.compile(regex, re.I if ignore else 0)
        find = finder((name, regex, ignore))
        assert [t for t in texts if find(t) != [m.span() for m in p.finditer(t)]] == [], name
    words = "a b c " * 3000  # by \b alone each place is tried, and an address from each of its characters
    assert finder(RULES["email_addresses"])(words) == [] and finder(("mine", "b c", False))("b c b c") == [(0, 3), (4, 7)]


def test_limiter_holds_one_key_at_a_time(spark):
    rng = random.Random(2)
    rows = [(i if i % 50 else None, f"k{i % 7}" if i % 11 else None, rng.randint(0, 300), rng.random() < 0.5) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, key string, s long, failed boolean").selectExpr("event_id", "key", "timestamp_seconds(s) AS ts", "failed")
    limited, broken = S.limit_requests(df, 3, 20), S.break_circuits(df, 3, 5)
    assert "FlatMapGroupsInPandas" not in plan(limited) + plan(broken)
    want, passed = [], []
    for k in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0] is None, r[0] or 0))
        want += [(r[0], k, ok) for r, ok in zip(mine, S.admit([float(r[2]) for r in mine], [], 3, 20)[0], strict=True)]
        passed += [(r[0], k, ok) for r, ok in zip(mine, S.break_calls([(float(r[2]), r[3]) for r in mine], 0, float("-inf"), 3, 5)[0], strict=True)]
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, limited.collect())) == key(want) and key(map(tuple, broken.collect())) == key(passed)


def test_images_and_their_moments(spark):
    d = spark.range(-3, 300).selectExpr("id AS doc_id", "7 AS h", "90 AS w")
    d = d.withColumn("pixels", I.made(d.doc_id, 7, 90))
    assert "transform" not in plan(d) and "sequence" not in plan(d)
    rows = {r.doc_id: bytes(r.pixels) for r in d.collect()}
    assert all(v == bytes((k * 7 + y * 5 + x * 3) % 256 for y in range(7) for x in range(90)) for k, v in rows.items())
    for r in I.moments(d).collect():
        v = rows[r.doc_id]
        mean = sum(v) / len(v)
        assert (r.mean, r.top, r.bottom) == (round(mean, 6), max(v), min(v)) and abs(r.variance - sum((x - mean) ** 2 for x in v) / len(v)) < 1e-5


def test_words_do_not_carry_their_texts(spark, tmp_path):
    rng = random.Random(4)
    turn = lambda n: " ".join(rng.choice(["The", "the", "", "house\n", "Über", "x" * 30, "no."]) for _ in range(n))
    rows = [(i, j, turn(rng.randint(0, 90))) for i in range(6) for j in range(4)] + [(9, 0, None), (9, 1, "")]
    spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, build in (("character_alignment", M.index_map), ("token_alignment", M.token_map)):
        df = R.QUERIES[name](spark, str(tmp_path))
        assert "Window" not in plan(df) and "explode" not in plan(df)
        want = []
        for c, k, old in [*rows, rows[0]]:
            places, start = build(old, " ".join((old or "").split()).lower()), 0
            for w in (old or "").split(" "):
                want += [(c, k, w, start, start + len(w), *M.map_span(places, start, start + len(w)))] if w else []
                start += len(w) + 1
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_matcher_equals_difflib():
    rng = random.Random(2)
    for k in range(900):
        letters = "ab" if k % 3 else "abcdefghijklmnop  "
        n = rng.choice([3, 10, 40, 230])
        old = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            if new:
                new[rng.randrange(len(new))] = rng.choice(letters + "Z")
        assert M.Matcher(None, old, "".join(new)).get_opcodes() == SequenceMatcher(None, old, "".join(new)).get_opcodes()
