"""Sketches of sets never part linked ones, and texts are dealt out by family: once, but for leaders and blocks."""

import random

import numpy as np
import pytest

from sparkveil.llm import op3_jaccard as J
from sparkveil.llm.common import scratch_dir


def near_sets(r, n, size, spread):
    base = r.integers(0, 1 << 62, size).astype(np.uint64)
    return [np.unique(np.concatenate([base[r.random(size) < 1 - spread * r.random()], r.integers(0, 1 << 62, int(size * spread / 3)).astype(np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize("percent", [50, 80, 90])
@pytest.mark.parametrize("few", [0, 10_000])
def test_sketches_lose_no_link(monkeypatch, percent, few):
    monkeypatch.setattr(J, "_FEW", few)
    monkeypatch.setattr(J, "_WORDS", 200)
    r = np.random.default_rng(percent)
    sets = [s for size in (5, 60, 130, 250, 1000) for s in near_sets(r, 12, size, 0.12)] + [s for size in (62, 130, 500) for s in near_sets(r, 6, size, 0.5)]
    sets = [s for s in sets if len(s)]
    parts = list(range(len(sets) - 4)) + [0, 0, 1, 1]
    pairs = J.alike([len(s) for s in sets], [J.sketch(s) for s in sets], parts, percent)
    label = list(range(len(sets)))
    for a, b in pairs:
        assert parts[a] != parts[b]
        label = [label[a] if x == label[b] else x for x in label]
    for i, a in enumerate(sets):
        for j in range(i):
            if parts[i] != parts[j] and 100 * len(np.intersect1d(a, sets[j])) >= percent * len(np.union1d(a, sets[j])):
                assert label[i] == label[j]


def families(seed, n, copies, words, changed):
    """Texts of n families; copies of a family differ in `changed` of their words, some of a hundred."""
    r = random.Random(seed)
    out = []
    for f in range(n):
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(copies):
            out.append(" ".join(f"x{r.randrange(10**6)}" if r.random() < changed else w for w in base))
    return out


def test_alike_but_not_linked_is_not_dealt_out(spark):
    """Families whose copies share passages without being linked: no text of them is searched for."""
    texts = families(1, 6, 12, 300, 0.09)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = {p.getPath().toString() for p in listed(spark)}
    rows = J.jaccard_components(docs, 3, 90).collect()
    assert all(x.component_id == x.doc_id for x in rows) and len(rows) == len(texts)
    groups = [p for p in listed(spark) if "/groups-" in p.getPath().toString() and p.getPath().toString() not in before]
    assert len(groups) == 1
    assert spark.read.parquet(groups[0].getPath().toString()).count() <= len(texts) // 10


def listed(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sparkveil")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(path)) if fs.exists(path) else []


@pytest.mark.parametrize("block", [3, 2048])
def test_large_families_in_blocks(spark, block):
    texts = families(2, 3, 40, 120, 0.012) + families(3, 4, 20, 60, 0.02)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    for _ in texts:
        new = [min(least[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 90 * len(a | b)) for a in sets]
        if new == least:
            break
        least = new
    assert len(set(least)) < len(texts) - 20
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs, 3, 90, block).collect()} == dict(enumerate(least))
