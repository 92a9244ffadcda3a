"""Readers of the small text formats: feedback files, labelled lines, pattern lists, vocabularies, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FEEDBACK = ["document_id", "pii_text", "feedback_type", "correct_label"]
HEADS = ("document_id", "doc_id", "id")


def feedback(lines: DataFrame) -> DataFrame:
    """(document_id, pii_text, feedback_type, correct_label) of lines (value): columns that lack are empty, empty lines and header
    lines are passed over, the type is in lower case. Quoted values may hold commas."""
    cells = F.from_csv(F.col("value"), ", ".join(f"{c} string" for c in FEEDBACK), {"mode": "PERMISSIVE", "nullValue": "\u0000"})
    rows = lines.where(F.coalesce("value", F.lit("")) != "").select(cells.alias("c")).where(~F.lower(F.coalesce("c.document_id", F.lit(""))).isin(*HEADS))
    return rows.select(*[F.coalesce(F.lower(f"c.{n}") if n == "feedback_type" else F.col(f"c.{n}"), F.lit("")).alias(n) for n in FEEDBACK])


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return feedback(spark.read.text(path))


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row for each JSON line; blank lines are passed over, lines that are no JSON give nulls."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(name, pattern) of a JSON object of patterns; those that do not compile are left out."""
    import re

    def compiles(p: str | None) -> bool:
        try:
            return bool(p) and re.compile(p) is not None
        except re.error:
            return False

    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "pattern")).collect()  # a list of settings
    return spark.createDataFrame([(r["name"], r["pattern"]) for r in rows if compiles(r["pattern"])], "name string, pattern string")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word): a lower-cased word for each line that is not blank, once."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file is one page."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
