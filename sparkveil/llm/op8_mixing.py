"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells source x language x topic are raked until their marginals meet the targets.
Topics are clusters that are learnt from all texts (topics.py).
A cell's fitted share over its own share is its weight; one factor turns weights into
probabilities that keep the wanted part of all tokens, and each document is drawn by its own
hash. Only cell sums reach the driver, and their number is checked.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .topics import fit, sketches, tokens_and_topic, topic_of_vector

DIMS = ("source", "lang", "topic")
MAX_CELLS = 200_000  # cells are sources x languages x topics, whatever the number of documents
KEEP = 0.8


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(sums: dict, power: float) -> dict:
    """Target shares of a dimension: its present shares to a power, which lifts the rare and lowers the frequent."""
    total = sum(sums.values())
    raised = {k: (v / total) ** power if v else 0.0 for k, v in sums.items()}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()} if whole else raised


def rake(mass: np.ndarray, index: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Cell masses (summing to 1) whose marginals meet the targets; index[i, d] is cell i's value in dimension d.

    Where no such masses exist the last round's are returned. Targets of values without mass are ignored.
    """
    fitted = mass / mass.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, want in enumerate(targets):
            have = np.bincount(index[:, d], weights=fitted, minlength=len(want))
            aim = np.where(have > 0, want, 0)
            aim = aim / aim.sum() if aim.sum() else have
            worst = max(worst, float(np.abs(aim - have).max()))
            fitted = fitted * np.where(have > 0, aim / np.where(have > 0, have, 1), 0)[index[:, d]]
        if worst < tolerance:
            break
    return fitted


def probabilities(mass: np.ndarray, fitted: np.ndarray, keep: float) -> np.ndarray:
    """min(1, c * weight) for the c that keeps the part `keep` of all mass in expectation."""
    weight = np.divide(fitted, mass, out=np.zeros_like(fitted), where=mass > 0)
    want = keep * mass.sum()
    if want >= mass[weight > 0].sum():
        return (weight > 0).astype(np.float64)
    breaks = np.concatenate(([0.0], np.sort(1 / weight[weight > 0])))
    kept = [float((np.minimum(1, c * weight) * mass).sum()) for c in breaks] if len(breaks) < 2000 else None
    if kept is None:
        low, high = 0.0, float(breaks[-1])
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (np.minimum(1, mid * weight) * mass).sum() < want else (low, mid)
        return np.minimum(1, high * weight)
    for (a, ka), (b, kb) in pairwise(zip(breaks, kept, strict=True)):
        if kb >= want:
            c = a + (b - a) * (want - ka) / (kb - ka) if kb > ka else b
            return np.minimum(1, c * weight)
    return np.minimum(1, breaks[-1] * weight)


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, powers: dict[str, float] | None = None, keep: float = KEEP, topics: Column | None = None, seed: int = 11) -> DataFrame:
    """Every row of docs with mix_tokens, mix_topic, mix_probability and mix_kept.

    targets: wanted token shares by dimension (source, lang, topic) and value; a dimension without
    targets takes its present shares to its power (0.5 for sources, 0.7 otherwise). A null source or
    language is a value of its own. Documents without words have no weight to give: they are kept with
    the probability `keep`. The draw is a hash of seed and doc_id, so rows that share a doc_id stay or
    go together, and any run draws alike. topics: a column that names the topic of a row, in place of the learnt ones. Columns of docs named mix_* as these four are replaced, all others stay. An empty
    table gives no rows. More than MAX_CELLS cells are an error.
    """
    spark = docs.sparkSession
    rows = docs.drop("mix_tokens", "mix_topic", "mix_probability", "mix_kept")
    if topics is None:
        seen = sketches(docs)
        model = fit(seen)
        cells = seen.groupBy("source", "lang", topic_of_vector(model, "tokens", "vector").alias("topic")).agg(F.sum("tokens").alias("mass"))
        tag = "_mix" + "_" * max(map(len, docs.columns))
        rows = rows.withColumn(tag, tokens_and_topic(model, F.col("text")))
        rows = rows.withColumns({"mix_tokens": F.col(tag)["tokens"], "mix_topic": F.col(tag)["topic"]}).drop(tag)
    else:
        rows = rows.withColumns({"mix_tokens": token_count(F.col("text")), "mix_topic": topics})
        cells = rows.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("mass"))
    got = cells.limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    got = sorted(got, key=lambda r: tuple((r[d] is not None, r[d] or "") for d in DIMS))
    mass = np.array([r["mass"] for r in got], dtype=np.float64)
    p = np.full(len(got), keep)
    if mass.sum() > 0:
        values = [sorted({r[d] for r in got}, key=lambda v: (v is not None, v or "")) for d in DIMS]
        place = [{v: i for i, v in enumerate(vs)} for vs in values]
        index = np.array([[place[d][r[n]] for d, n in enumerate(DIMS)] for r in got])
        wanted = []
        for d, name in enumerate(DIMS):
            sums = np.bincount(index[:, d], weights=mass, minlength=len(values[d]))
            shares = (targets or {}).get(name) or tempered(dict(zip(values[d], sums, strict=True)), (powers or {}).get(name, 0.5 if name == "source" else 0.7))
            wanted.append(np.array([shares.get(v, 0.0) for v in values[d]]))
        p = np.where(mass > 0, probabilities(mass, rake(mass, index, wanted), keep), keep)
    own = [f"_mix_{d}" + "_" * max(map(len, docs.columns)) for d in DIMS]  # longer than any column of docs
    plan = spark.createDataFrame([(*[r[d] for d in DIMS], float(q)) for r, q in zip(got, p, strict=True)], ", ".join([*[f"{n} string" for n in own], "mix_probability double"]))
    on = F.col("source").eqNullSafe(F.col(own[0])) & F.col("lang").eqNullSafe(F.col(own[1])) & F.col("mix_topic").eqNullSafe(F.col(own[2]))
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    return rows.join(F.broadcast(plan), on).drop(*own).withColumn("mix_kept", (draw < F.col("mix_probability")) | (F.col("mix_tokens") == 0) & (draw < keep))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))
