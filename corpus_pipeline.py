"""A training-data pipeline of five operators: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparkveil.llm import op2_toxicity, op3_jaccard, op4_secrets, op7_packing, op8_mixing
from sparkveil.llm.common import durable, fold, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP = 0.9  # of all tokens in expectation, when sources are mixed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own score stays below the threshold, whatever their doc_id."""
    scored = op2_toxicity.score_rows(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return scored.where(F.col("score") < op2_toxicity.THRESHOLD).select("row.*")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a column `row` that names each row and stays with it: by its place in its file, else by a written number."""
    try:
        return docs.select(*COLUMNS, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row"))
    except AnalysisException:  # no table of files
        return durable(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, a null one last; and all without words."""
    rows = numbered(docs)
    gone = op3_jaccard.jaccard_components(rows, row="row").where("not least").select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id"))
    # The number is a hash in 64 bits, so the doc_id is compared as well.
    return rows.join(gone, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars of the new text."""
    return op4_secrets.redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities draw."""
    return op8_mixing.mix(docs.select(*COLUMNS), keep=KEEP).where("mix_kept").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with a digest of their ids."""
    return op7_packing.pack(docs, {"ids_crc32": F.crc32("ids")})


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained score, a forest and a linear program are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
