"""Each operator on a small table with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import op1_binary, op2_toxicity, op3_jaccard, op4_secrets, op5_chat, op6_fingerprint, op7_packing, op8_mixing, op9_mixing_lm, op10_topk
from sparkveil.llm.common import WordHashes, shingle_set, words_of
from sparkveil.llm.tokens import Encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, node string, sig string, row int, k int, h long"


def texts(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeèé") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(25)]
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    long_ = " ".join(word() for _ in range(9000))
    return [*base, *near, base[0], base[1], None, "", " \n\t ", "One.\nTwo!\n\nThree", 'x token = "' + "0123456789abcdef" * 2 + 'a1b2c3d4" y', long_, long_ + " end", "two  spaces \n here ", "a b", "A B"]


def rows():
    t = texts()
    out = [(i, x, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], 1, 7, "n", "s", 3, 4, 5) for i, x in enumerate(t)]
    return [*out, (3, t[3], "en", "s0", 1, 7, "n", "s", 3, 4, 5), (3, "other text of id three", "en", "s0", 1, 7, "n", "s", 3, 4, 5), (None, t[5], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary_path())
    whole.encode_special_tokens = True
    e = Encoder(vocabulary_path())
    for t in [*texts(), " lead", "trail ", "a\n b", "it's 12 o'clock<|endoftext|> x", "tab\tx  y"]:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def ids_of():
    e = Encoder(vocabulary_path())
    return sorted((str(r[0]), np.frombuffer(e.ids(r[1]), "<u4").tolist() + [1]) for r in rows())


def test_op1_round_trip(docs, empty):
    got = {}
    for s in op1_binary.write_ids(docs, window=20_000).collect():
        ids, pos = np.frombuffer(s.input_ids, "<u2"), np.frombuffer(s.position_ids, "<u2")
        assert len(ids) == 2048 and s.cu_seqlens[-1] == s.n_tokens <= 2048
        for i, d in enumerate(s.doc_ids):
            a, b = s.cu_seqlens[i : i + 2]
            assert pos[a:b].tolist() == list(range(b - a))
            got.setdefault((str(d), s.doc_tokens[i]), []).append((s.doc_starts[i], ids[a:b].tolist()))
    flat = sorted((d, x) for (d, _), parts in got.items() for x in [sum((p for _, p in sorted(parts)), [])] if len({s for s, _ in parts}) == len(parts))
    assert sum(len(x) for parts in got.values() for _, x in parts) == sum(len(x) for _, x in ids_of())
    assert all(x in ids_of() for x in flat) and len(flat) > 30
    assert op1_binary.write_ids(empty).count() == 0


def test_best_fit_equals_scan():
    lengths = [random.Random(4).randint(1, 100) for _ in range(1)] + [random.Random(i).randint(1, 100) for i in range(300)]
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(100 - n)
        else:
            rooms[fit] -= n
    packed = op1_binary.best_fit(lengths, 100)
    assert sorted(i for s in packed for i in s) == list(range(len(lengths))) and len(packed) == len(rooms)
    assert all(sum(lengths[i] for i in s) <= 100 for s in packed)


def test_op7_pieces(docs, empty):
    packed = op7_packing.pack(docs, {"ids": F.col("ids"), "crc": F.crc32("ids")}).collect()
    assert sorted(sum((np.frombuffer(p.ids, "<u4").tolist() for p in packed), [])) == sorted(i for _, x in ids_of() for i in x)
    by = {}
    for p in packed:
        assert zlib.crc32(p.ids) == p.crc and len(p.ids) == 4 * p.length
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert op7_packing.pack(empty).count() == 0


def test_slots_hold_the_demand():
    r = np.random.default_rng(2)
    for demand in (r.integers(0, 50, 32), np.zeros(32, np.int64), np.eye(32, dtype=np.int64)[5] * 77, r.integers(0, 3, 32)):
        used, seen = {}, np.zeros(32, np.int64)
        for size, first, end, base, per, at in op7_packing.slots(demand, 32):
            assert first == seen[size - 1]
            seen[size - 1] = end
            for rank in range(first, end):
                s = base + (rank - first + at) // per
                used[s] = used.get(s, 0) + size
        assert (seen == demand).all() and all(v <= 32 for v in used.values())
        assert len(used) <= 1.1 * (demand * np.arange(1, 33)).sum() / 32 + 35 * 0.5 + (demand[16:].sum())


def test_op2_learns_and_survives(spark, docs, empty):
    r = random.Random(3)
    clean = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    data = [(i, clean() + (" zlorpid zlorpan " if i % 3 == 0 else " fine "), i % 3 == 0) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data] + [(0, 1), (900, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in op2_toxicity.score(d, labels, F.col("doc_id") % 4 != 2).collect()}
    held = [(got[i] >= 0.3) == y for i, _, y in data if i % 4 == 2]
    assert sum(held) / len(held) > 0.95
    none = op2_toxicity.score(docs, labels.limit(0), F.lit(True)).collect()
    assert len(none) == len(rows()) and all(0 <= r.score < 0.3 for r in none)
    assert op2_toxicity.score(empty, labels.limit(0), F.lit(True)).count() == 0


def brute(n, percent):
    data, cache = rows(), WordHashes()
    sets = [set(shingle_set(words_of(r[1]), n, cache).tolist()) for r in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            groups[root(i)] = min(groups.get(root(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(groups.get(root(i), r[0]) if sets[i] else r[0])) for i, r in enumerate(data))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2048), (5, 80, 2048), (3, 80, 2)])
def test_op3_equals_brute_force(docs, empty, n, percent, block):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op3_jaccard.jaccard_components(docs, n, percent, block).collect())
    assert got == brute(n, percent)
    assert op3_jaccard.jaccard_components(empty, n, percent).count() == 0


def test_search_equals_scan():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 60, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < 0.95], r.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(60)]
    index = op3_jaccard.Index(sets)
    for s in sets[:20]:
        want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t))]
        assert index.search(s, 90).tolist() == want


def test_op4(docs, empty):
    forest = op4_secrets.train(op4_secrets.example_findings())
    held = op4_secrets.example_findings(600, 77)
    x = np.array([op4_secrets.describe(v, b[-40:], a[:40], p) for b, v, a, p, _ in held])
    assert ((forest.predict(x) >= 0.5) == np.array([h[4] for h in held])).mean() > 0.97
    found = op4_secrets.find_secrets(docs).where("is_secret").collect()
    assert len(found) == 1
    redacted = op4_secrets.redact_secrets(docs)
    assert redacted.columns == docs.columns and redacted.count() == len(rows()) and redacted.where("text like '%[SECRET:hex]%'").count() == 1
    assert op4_secrets.find_secrets(empty).count() == 0


def test_op5(spark):
    turns = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", None)]
    data = [(c, i, *turns[i]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for i in range(n)] + [(5, i, "user", f"t{i}") for i in range(600)] + [(6, i, "user", f"t{i}") for i in range(300)] + [(7, 0, "user", "hi"), (7, 1, "user", "yes"), (2, 0, "user", "hi"), (None, 0, "user", "x"), (8, None, None, None)]
    t = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {}
    for r in op5_chat.format_chats(t).orderBy("conv_id", "part").collect():
        got.setdefault((r.conv_id, r.n_turns, r.copies), []).append(r.rendered)
    assert set(got) == {(2, 4, 2), (5, 600, 1), (7, 2, 1), (8, 1, 1)}
    assert "".join(got[5, 600, 1]) == "".join(f"<|user|>\nt{i}\n<|end|>\n" for i in range(600))
    assert got[8, 1, 1] == ["<|unknown|>\n\n<|end|>\n"]
    assert op5_chat.format_chats(t.limit(0)).count() == 0
    same = spark.range(600).select(F.lit(1).alias("conv_id"), F.lit(7).alias("turn"), F.lit("user").alias("role"), F.format_string("t%03d", "id").alias("text"), F.lit(0).alias("pos"), F.lit(0).alias("part"))
    parts = op5_chat.format_chats(same.union(same)).orderBy("part").collect()
    assert [(p.part, p.part_turns, p.n_turns) for p in parts] == [(0, 256, 600), (1, 256, 600), (2, 88, 600)]


def test_op6(spark, docs, empty):
    out = op6_fingerprint.fingerprint_documents(docs).collect()
    assert len(out) == len(rows())
    order = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "", r[0]) for r in rows()), key=lambda r: (-r[0], r[1].encode()))
    want = []
    for i, (_, t, d) in enumerate(order):
        half = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    two = spark.createDataFrame([(1, "a.\nb c.\nd"), (2, "d\na.\nb c."), (3, "a.\nb c."), (4, "d")], "i long, t string")
    v = {r.i: r.lanes for r in op6_fingerprint.vectors(two, ["i"], "t").collect()}
    assert v[1] == v[2] != v[3]
    sums = spark.createDataFrame([(v[1], v[3], v[4])], "a array<int>, b array<int>, c array<int>").select(op6_fingerprint.combine(F.col("b"), F.col("c")).alias("plus"), op6_fingerprint.combine(F.col("a"), F.col("c"), -1).alias("minus")).first()
    assert sums.plus == v[1] and sums.minus == v[3]
    assert op6_fingerprint.fingerprint_documents(empty).count() == 0


def test_op7_each_piece_against_its_ids(docs):
    """Every piece holds the ids of its document from its start on."""
    ids = {}
    for doc, x in ids_of():
        ids.setdefault((doc, len(x)), []).append(np.array(x, dtype="<u4"))
    for p in op7_packing.pack(docs, {"crc": F.crc32("ids")}).collect():
        assert p.crc in [zlib.crc32(x[p.start : p.start + p.length].tobytes()) for x in ids[str(p.doc_id), p.doc_tokens]]


def test_op8(docs, empty):
    r = np.random.default_rng(1)
    index = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    mass = r.random(24) + 0.1
    targets = [np.full(4, 0.25), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    fitted = op8_mixing.rake(mass, index, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(index[:, d], weights=fitted), t)
    p = op8_mixing.probabilities(mass, fitted, 0.7)
    assert abs((p * mass).sum() - 0.7 * mass.sum()) < 1e-9 and p.max() <= 1
    clash = docs.select("*", F.lit("a").alias("_source"), F.lit(1).alias("_topic"), F.lit(2).alias("mix_kept"))
    assert op8_mixing.mix(clash).count() == len(rows())
    mixed = op8_mixing.mix(docs).collect()
    assert len(mixed) == len(rows()) and all(0 <= m.mix_probability <= 1 for m in mixed)
    assert op8_mixing.mix(empty).count() == 0


def test_op9(docs, empty):
    learn = F.col("doc_id") % 5 != 1
    got = op9_mixing_lm.score(docs, learn, ~learn).collect()
    assert len(got) == len(rows())
    tokens = {i: words_of(r[1]) for i, r in enumerate(rows())}
    counts = {}
    for i, r in enumerate(rows()):
        if r[0] is not None and r[0] % 5 != 1:
            for w in [*tokens[i], None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(tokens[i]) + 1, sum(w in counts for w in [*tokens[i], None]), round(sum(float(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1)))) for w in [*tokens[i], None]), 6)) for i, r in enumerate(rows()))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert op9_mixing_lm.score(empty, learn).count() == 0


def test_op9_code_is_complete():
    """The byte code is a full prefix code, so the chances of all tokens add up to 1 at most."""
    s = op9_mixing_lm.Speller()
    start, length, node, bit = op9_mixing_lm.prefix_code()
    assert abs(sum(2.0 ** -int(n) for n in length) - 1) < 1e-12 and len(s.path_salt) == length.sum() == len(bit)


def test_op10(spark):
    r = np.random.default_rng(3)
    v = [(i, (r.integers(-3, 4, 8) / 4).tolist()) for i in range(700)]
    extra = [(700, None), (701, [1.0, None] * 4), (702, [float("nan")] * 8), (None, [1.0] * 8), (5, [0.5] * 8), (800, [2.0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in v + extra], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {}
    for row in op10_topk.top_k(df, F.col("vec_id") % 100 == 0, 10, query_block=3, vector_block=64).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    pool = [(i, np.floor(1024 * np.pad(np.array(x, dtype=np.float32).astype(float), (0, 8 - len(x)))).astype(int)) for i, x in [*v, (5, [0.5] * 8), (800, [2.0])]]
    assert set(got) == {i for i, _ in pool if i % 100 == 0}
    for q, found in got.items():
        mine = next(x for i, x in pool if i == q)
        want = sorted(((-int(x @ mine), i) for i, x in pool if i != q))[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert op10_topk.top_k(df.limit(0), F.lit(True)).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in op10_topk.top_k(huge, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [1, 2]
