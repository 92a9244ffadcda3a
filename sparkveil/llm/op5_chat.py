"""Chat formatting: cumulative snapshots collapse to their longest version before rendering. DataFrame functions only.

Logs often hold one conversation many times, each time a turn longer. Every turn gets a rolling
hash of all turns up to it. A conversation whose last hash is an inner hash of another one is a
prefix of it and goes (an anti-join); of equal conversations the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

BLOCK = 256  # turn numbers that are put in order together, and turns that are rendered together
_HALF = (1 << 31) - 1


def _hashes(pos: Column) -> list[Column]:
    """Two 31-bit hashes of a turn at its place; their running sums never leave 63 bits."""
    return [F.xxhash64(F.lit(seed), pos, F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()).bitwiseAND(F.lit(_HALF)) for seed in (1, 2)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, pos, role, text, h1, h2): turns in order with the rolling hash of all up to each.

    Order: turn (null first), then role, then text. Rows that repeat wholly count once; rows without
    conv_id take no part. Blocks of turns are ordered one by one and joined by running totals of a
    row for each block, so a conversation with very many turns is spread over tasks. The rolling
    hash adds the hash of each turn and its place; the sums h1 and h2 with pos identify a prefix.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("offset") + F.col("rank"))
    a, b = _hashes(F.col("pos"))
    rows = rows.select("conv_id", "block", "pos", "role", "text", a.alias("a"), b.alias("b"))
    rows = durable(rows, "turns")
    sums = rows.groupBy("conv_id", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bases = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in "ab"])
    run = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.select("conv_id", "block", "pos", "role", "text", F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
        .join(bases, ["conv_id", "block"])
        .select("conv_id", "block", "pos", "role", "text", (F.col("a") + F.col("base_a")).alias("h1"), (F.col("b") + F.col("base_b")).alias("h2"))
    )


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no prefix of a longer one, one for each text."""
    ends = hashed.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    last = hashed.select("conv_id", "pos", "h1", "h2").join(ends, ["conv_id", "pos"])
    whole = last.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = hashed.select("conv_id", "pos", "h1", "h2").join(ends.withColumnRenamed("pos", "end"), "conv_id").where("pos < end").select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def render_turn(role: Column, text: Column) -> Column:
    """<|role|>, the text and <|end|>, each on lines of its own; a null role is `unknown`, a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, part_turns, rendered) of the maximal conversations.

    A conversation is rendered in parts of BLOCK turns by their place, whatever their numbers; parts are numbered
    from 0 and, joined in order, are the whole chat. Other columns of turns are ignored; rows that repeat wholly count once,
    rows of one turn that differ are turns of their own. An empty table gives an empty result.
    """
    hashed = durable(prefix_hashes(turns), "prefixes")
    return (
        hashed.join(maximal(hashed), "conv_id")
        .groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("part"), "n_turns", "copies")
        .agg(F.count(F.lit(1)).alias("part_turns"), F.array_sort(F.collect_list(F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("turn")))).alias("turns"))
        .select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), "part_turns", F.concat_ws("", "turns.turn").alias("rendered"))
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t
), p AS (
  SELECT conv_id, pos, string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), '') OVER (
           PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sofar
  FROM o
), e AS (SELECT conv_id, max(pos) AS pos FROM o GROUP BY conv_id
), w AS (
  SELECT p.sofar, min(conv_id) AS conv_id, count(*) AS copies, any_value(pos) AS pos FROM p JOIN e USING (conv_id, pos) GROUP BY p.sofar
), m AS (
  SELECT conv_id, pos AS n_turns, copies FROM w
  WHERE sofar NOT IN (SELECT p.sofar FROM p JOIN e USING (conv_id) WHERE p.pos < e.pos)
)
SELECT conv_id, CAST((o.pos - 1) // 256 AS INTEGER) AS part,
       CAST(n_turns AS BIGINT) AS n_turns, CAST(copies AS BIGINT) AS copies, CAST(count(*) AS BIGINT) AS part_turns,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY o.pos) AS rendered
FROM m JOIN (SELECT conv_id, pos, role, text FROM o) o USING (conv_id) GROUP BY conv_id, n_turns, copies, part
"""
