"""Document fingerprints: a homomorphic multiset hash over paragraphs. DataFrame functions only.

Each paragraph is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo powers of two. So the order of paragraphs does not
matter, and one paragraph is added or taken away by adding or subtracting its vector.

A vector has a count lane and four dense lanes from two 64-bit hashes of the whole paragraph,
and 128 bit lanes that sum the hash bits of the paragraph's sentences, blank ones left out; all
are taken mod 2^31, more than the sentences of any text.
The dense lanes carry equality; the bit lanes keep likeness, since the cosine of two such sums
estimates how much of their sentences two documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

BIT_WORDS = 32  # each of two hashes gives this many sums of two lanes
LANES = 4 * BIT_WORDS
LANE_MOD = 1 << 31
_LOW = 0x0000000100000001


def _sums() -> list[Column]:
    out = [F.sum(F.when(F.col("said"), 1).otherwise(0)).alias("n"), F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("paragraphs")]
    for i, h in enumerate(("p1", "p2")):
        head = F.when(F.col("first"), F.col(h)).otherwise(F.lit(0))
        out += [F.sum(head.bitwiseAND(0xFFFFFFFF)).alias(f"d{2 * i}"), F.sum(F.shiftrightunsigned(head, 32)).alias(f"d{2 * i + 1}")]
    for h in ("h1", "h2"):
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LOW))).alias(f"{h}_{i}") for i in range(BIT_WORDS)]
    return out


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys plus `lanes`, an array of integers: sentence count, 5 dense lanes and LANES bit lanes, all mod 2^31.

    A null text counts as empty; an empty text has one empty paragraph. Rows with equal keys are
    one document: their vectors add up.
    """
    par = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("par"))
    par = par.select(*keys, F.xxhash64("par").alias("p1"), F.xxhash64(F.lit("second"), "par").alias("p2"), F.posexplode(F.split("par", "[.!?]")).alias("pos", "sent"))
    said = F.trim("sent") != ""
    hashes = [F.when(said, h).otherwise(F.lit(0)).alias(n) for n, h in (("h1", F.xxhash64("sent")), ("h2", F.xxhash64(F.lit("second"), "sent")))]
    sent = par.select(*keys, "p1", "p2", (F.col("pos") == 0).alias("first"), said.alias("said"), *hashes)
    sums = sent.groupBy(*keys).agg(*_sums())
    lanes = [F.pmod(F.col(c), F.lit(LANE_MOD)) for c in ("n", "paragraphs", "d0", "d1", "d2", "d3")]
    for h in ("h1", "h2"):
        lanes += [F.pmod(F.col(f"{h}_{i}").bitwiseAND(0xFFFFFFFF), F.lit(LANE_MOD)) for i in range(BIT_WORDS)]
        lanes += [F.pmod(F.shiftrightunsigned(f"{h}_{i}", 32), F.lit(LANE_MOD)) for i in range(BIT_WORDS)]
    return sums.select(*keys, F.array(*lanes).cast("array<int>").alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a with the paragraphs of b inserted (sign 1) or deleted (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x.cast("long") + sign * y.cast("long"), F.lit(LANE_MOD)).cast("int"))


def fingerprint(lanes: Column) -> Column:
    """The lanes as hexadecimal text, 8 digits for each."""
    return F.concat_ws("", F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints' lanes: 1 where they are equal, else the cosine of the signed bit lanes, 0 at least."""

    def signed(v: Column) -> Column:
        return F.transform(F.slice(v, 7, LANES), lambda x: 2.0 * x - v[0])

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = signed(a), signed(b)
    cos = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cos, F.lit(0.0)))))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct key and the next lower one; the lowest is followed by the highest.

    Keys are dealt out by ranges; inside a range a window looks ahead, between ranges one row for each
    range tells where the next begins.
    """
    n = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(ids.select(key).distinct().repartitionByRange(n, F.col(key).desc()).withColumn("range", F.spark_partition_id()), "ranged")
    heads = ranged.groupBy("range").agg(F.max(key).alias("head"))
    one = Window.orderBy("range")  # a row for each range
    heads = heads.select("range", F.coalesce(F.lead("head").over(one), F.first("head").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("range").orderBy(F.col(key).desc())
    led = ranged.withColumn("next", F.lead(key).over(inside))
    return led.join(heads, "range").select(key, F.coalesce("next", "after").alias("next"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """(k, dup, next_k, next_dup, doc_id, text, edited): each row with its text and its edited text.

    Documents follow each other by descending doc_id; rows with one doc_id follow each other by text,
    and a null doc_id comes last. The text is dealt out once, by doc_id (all three uses read the same exchange); the next document sends only
    the characters that are needed. A null text counts as empty.
    """
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    order = successors(docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k")), "k").join(
        docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("times")), "k"
    )
    order = durable(order, "order")
    placed = rows.withColumn("dup", F.row_number().over(Window.partitionBy("k").orderBy("text")))
    asks = placed.join(order, "k").select(
        F.when(F.col("dup") < F.col("times"), F.col("k")).otherwise(F.col("next")).alias("t_k"),
        F.when(F.col("dup") < F.col("times"), F.col("dup") + 1).otherwise(1).alias("t_dup"),
        F.col("k").alias("a_k"),
        F.col("dup").alias("a_dup"),
        F.floor(F.length("text") / 2).cast("int").alias("want"),
    )
    # The difference keeps dup out of the join's keys, so both sides stay dealt out by k alone.
    parts = placed.join(asks, (F.col("k") == F.col("t_k")) & (F.col("dup") - F.col("t_dup") == 0)).select(
        "a_k", "a_dup", F.col("k").alias("next_k"), F.col("dup").alias("next_dup"), F.expr("substring(text, 1, want)").alias("part")
    )
    kept = F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))")
    return placed.join(parts, (F.col("k") == F.col("a_k")) & (F.col("dup") - F.col("a_dup") == 0)).select(
        "k", "dup", "next_k", "next_dup", F.when(F.col("k") != lowest, F.col("k")).alias("doc_id"), "text", F.concat(kept, "part").alias("edited")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    Every row has a result; repeated rows have equal fingerprints. Other columns of docs are ignored.
    An empty table gives an empty result; a single document is its own next one.
    """
    rows = edited_documents(docs).select(
        "k", "dup", "next_k", "next_dup", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("one"),
    )
    keys = ["k", "dup", "next_k", "next_dup", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(*keys, "one.which", "one.body")
    both = vectors(rows, [*keys, "which"], "body").groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("lanes"))).alias("lanes"), F.max(F.when(F.col("which") == 1, F.col("lanes"))).alias("edited_lanes"))
    both = durable(both, "lanes")
    nexts = both.select(F.col("k").alias("next_k"), F.col("dup").alias("next_dup"), F.col("lanes").alias("next_lanes"))
    return both.join(nexts, ["next_k", "next_dup"]).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("lanes")).alias("fingerprint"), fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
