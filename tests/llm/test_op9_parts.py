"""Parts of the language model: tables that grow, packing of counts and pairs, weights learnt from all pairs, scores by a plain loop."""

import math

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.llm import op9_mixing_lm as M

TEXTS = [b"the cat sat on the mat and international cats", b"", b"the dog internationally sat", " ".join(f"w{i}x{i * 7}" for i in range(300)).encode()]


def bodies(texts=TEXTS):
    v = type("V", (), {"value": np.zeros(0, np.uint64)})()
    rows = pa.RecordBatch.from_arrays([pa.array([True] * len(texts)), pa.array([t.decode() for t in texts])], names=["learn", "text"])
    table = pa.Table.from_batches(list(M._pairs(v)(iter([rows])))).sort_by("p")
    return list(M._pack(iter(table.to_batches(max_chunksize=50))))


def shared(b):
    chunks = list(M._add(iter(M._tables(iter(b)))))
    return type("V", (), {"value": {"name": str(id(b)), "chunks": [(c["chunk"][0].as_py(), c["body"][0].as_py()) for c in chunks], "model": (M.start_weights(), (M.start_refine()[0] / M.start_refine()[1]).astype(np.float32))}})()


def test_counts_survive_their_packing():
    r = np.random.default_rng(4)
    counts = np.where(r.random((1 << M.CHUNK_BITS, 2)) < 0.1, r.integers(1, 1 << 20, (1 << M.CHUNK_BITS, 2)), 0)
    assert (M.unplanes(M.planes(counts)).reshape(-1, 2) == counts).all()


def test_pairs_survive_their_packing():
    got = {}
    for b in bodies():
        x = M.Batch(b["body"][0].as_py())
        for s, n, t in zip(x.start, x.size, x.times, strict=True):
            w = x.flat[s : s + n].tobytes()
            got[w] = got.get(w, 0) + int(t)
    want = {b"": len(TEXTS)}
    for t in TEXTS:
        for w in t.split():
            want[w] = want.get(w, 0) + 1
    assert got == want


def test_tables_grow_with_the_words():
    small, large = (M.Batch(bodies([" ".join(f"{i}long" for i in range(n)).encode()])[0]["body"][0].as_py()) for n in (10, 5000))
    assert large.bits >= small.bits + 6


def test_weights_learn_from_all_pairs():
    b = bodies()
    got = [x for r in M._weights(shared(b))(iter(b)) for x in r["v"].to_pylist()]
    decisions = sum(float(x.times[p].astype(float)[w[0]].sum()) for r in b for x in [M.Batch(r["body"][0].as_py())] for p, w in x.parts(True))
    assert sum(g[0] for g in got) == pytest.approx(decisions)
    assert sum(sum(g[1 + M.GATES * (M.CONTEXTS + 1) + M.GATES * M.BUCKETS :]) for g in got) == pytest.approx(decisions)


def test_chances_equal_a_plain_loop():
    """Start weights, one word after the other: counts by dictionary, the logistic of the mean of the stretched predictions."""
    texts = [b"aab aab", b"aac"]
    b = bodies(texts)
    got = {}
    for r in M._chances(shared(b))(iter(b)):
        got |= dict(zip(r["pair"].to_pylist(), r["chance"].to_pylist(), strict=True))
    start, length, node, bit = M.prefix_code()
    words = [w + b" " for t in texts for w in t.split()] + [b"\n"] * 2
    steps = lambda w: [(i, int(node[start[c] + k]), int(bit[start[c] + k])) for i, c in enumerate(w) for k in range(length[c])]
    counts = {}
    for w in words:
        for i, n, t in steps(w):
            counts.setdefault((w[:i], n), [0, 0])[t] += 1
    refine = (M.start_refine()[0] / M.start_refine()[1]).reshape(M.GATES, M.BUCKETS)[0]
    for w in set(words):
        want = 0.0
        for i, n, t in steps(w):
            c = counts[w[:i], n]
            x = max(-12.0, min(12.0, math.log((c[1] + 0.05) / (c[0] + 0.05))))
            p = 0.5 / (1 + math.exp(-x)) + 0.5 * float(refine[round((max(-8, min(8, x)) + 8) * (M.BUCKETS - 1) / 16)])
            want += math.log10(p if t else 1 - p)
        flat = np.frombuffer(w, np.uint8)
        key = M.pair_keys(M.speller().hashes(flat, np.zeros(1, np.int64), np.array([0 if w == b"\n" else len(w) - 1])), np.zeros(1, np.int64))
        assert got[int(key.view(np.int64)[0])] == pytest.approx(want, abs=1e-3)


def chances(b):
    """The chance, count and times of each pair, from all bodies."""
    got = {}
    for r in M._chances(shared(b))(iter(b)):
        for pair, *values in zip(*(r[c].to_pylist() for c in ("pair", "chance", "c", "times")), strict=True):
            assert pair not in got
            got[pair] = values
    return got


def test_pieces_of_a_large_beginning_equal_the_whole(monkeypatch):
    """What the pieces count of each other makes up for the cut, so each pair has the chance that it has uncut."""
    texts = [" ".join(f"tion{x}{y}{'abcdefg'[i % 7] * (i % 5)}" for i, (x, y) in enumerate((x, y) for x in "aeiou" for y in "nrst") for _ in range(1 + i % 3)).encode() + b" tion tiona the"] * 2 + [b"tionan dog"]
    init = M.Batch.__init__

    def wide(self, body):
        init(self, body)
        self.bits, self.late = 20, np.zeros((1 << 20, 2), dtype=np.float32)

    monkeypatch.setattr(M.Batch, "__init__", wide)
    whole = bodies(texts)
    monkeypatch.setattr(M, "BATCH", 4)
    pieces = bodies(texts)
    assert len(pieces) > len(whole) + 2 and any(M.unpacked(r["body"][0].as_py())[4] for r in pieces)
    want, got = chances(whole), chances(pieces)
    assert set(got) == set(want)
    for pair, values in want.items():
        assert got[pair][1:] == values[1:] and got[pair][0] == pytest.approx(values[0], abs=1e-4)


def test_a_body_holds_no_more_than_its_batch_of_one_beginning():
    """Very many words of one beginning: the tables of a body stay small."""
    words = [b"tion" + bytes(97 + i // 26**k % 26 for k in range(4)) for i in range(120_000)]
    b = bodies([b" ".join(words)])
    assert sum(len(M.unpacked(r["body"][0].as_py())[1]) for r in b) == len(words) + 1
    assert max(M.Batch(r["body"][0].as_py()).bits for r in b) <= 21


def test_pairs_of_many_stretches_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(M, "HELD", 5)
    texts = [b"the cat sat", b"a cat and the dog", b"the the cat internationally"] * 4
    v = type("V", (), {"value": np.zeros(0, np.uint64)})()
    rows = [pa.RecordBatch.from_arrays([pa.array([i % 2 == 0]), pa.array([t.decode()])], names=["learn", "text"]) for i, t in enumerate(texts)]
    table = pa.Table.from_batches([r for x in rows for r in M._pairs(v, 3)(iter([x]))]).sort_by("p")
    got = {}
    for r in M._pack(iter(table.to_batches())):
        x = M.Batch(r["body"][0].as_py())
        for s, n, t in zip(x.start, x.size, x.times, strict=True):
            w = x.flat[s : s + n].tobytes()
            assert w not in got
            got[w] = int(t)
    want = {w: 0 for t in texts for w in [*t.split(), b""]}
    for t in texts[::2]:
        for w in [*t.split(), b""]:
            want[w] += 1
    assert got == want
