"""Likeness of texts with more than 65,536 sentences."""

from pyspark.sql import functions as F

from sparkveil.llm import op6_fingerprint


def test_likeness_of_very_long_texts(spark):
    says = lambda name, a, b: "\n".join(f"{name}{i}" for i in range(a, b))
    rows = [(1, says("a", 0, 70_000)), (2, says("b", 0, 90_000)), (3, says("a", 35_000, 70_000) + "\n" + says("c", 0, 25_000))]
    v = op6_fingerprint.vectors(spark.createDataFrame(rows, "i long, t string"), ["i"], "t")
    one, two, three = (v.where(f"i = {k}").select(F.col("lanes").alias(f"l{k}")) for k in (1, 2, 3))
    all_ = one.crossJoin(two).crossJoin(three)
    got = all_.select(op6_fingerprint.likeness(F.col("l1"), F.col("l2")).alias("apart"), op6_fingerprint.likeness(F.col("l1"), F.col("l3")).alias("half"), F.length(op6_fingerprint.fingerprint(F.col("l1"))).alias("n")).first()
    assert got.apart < 0.3 and 0.35 < got.half < 0.75 and got.n == 8 * (6 + op6_fingerprint.LANES)
