"""Corpus pipeline: toxicity, near-dedup, benchmark decontamination, personal data, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. The whole result
has no SQL form: the first stage is a fitted model, the second a similarity join on hashed signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import common, decontam, neardup, pieces, pii, toxicity


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones among them, does not call toxic."""
    return toxicity.clean_rows(spark, docs, toxicity.fit(spark, docs, common.table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id, null ids last. Rows that share an id are told apart by text."""
    return neardup.one_of_each(spark, docs, null_ids=True)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, decided row by row: ids may be null or shared."""
    leaks = decontam.row_leaks(spark, docs, common.table(spark, sf_dir, "benchmark"))
    leaked = common.written(spark, leaks.select("doc_id", "row").distinct(), "leaked")
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), decontam.text_key().alias("key"))
    own = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row"))
    return keyed.join(neardup.few(leaked), own, "left_anti").select("doc.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; the length is that of the new text."""
    out = pii.redact(spark, docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    return pieces.encode_decode(spark, docs, common.tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("personal_data", redact),
    ("piece_encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents below sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
