"""The corpus pipeline: a short list of stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import mixing, near, pieces, quality, secrets
from panelkit.llm.shared import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes, whatever their language or source.

    Null and empty texts are judged as empty ones, a very long text as a whole; a score of just the
    mark passes. Repeated rows pass or go together. Without any label all pass (each scores 1/2); an
    empty table stays one. All columns stay.
    """
    machine = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, machine, "_quality").filter(F.col("_quality") >= quality.PASS_MARK).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id.

    Null and empty texts are one class; of repeated rows one stays, and of rows with the class's least
    id any one; a null id gives way to others. An empty table stays one. All columns stay.
    """
    return near.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced, whatever their number and the text's length.

    Null and empty texts stay as they are, repeated rows are treated alike; an empty table stays one.
    All columns stay; n_chars follows the text.
    """
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass over its source.

    Documents without words (null, empty) aren't drawn; a null source is one of its own; repeated
    rows are drawn by themselves and keep their columns; a very long text may be drawn in part. An
    empty table stays one.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens of every row: its whole text as pieces.

    Null and empty texts have no pieces, a very long text is cut where no piece can reach across;
    repeated rows give equal rows; an empty table gives none.
    """
    ids = pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces.vocabulary())
    return ids.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("secrets", without_secrets), ("mixing", mixed), ("sentencepiece", encoded)]

#: Learned scores, sketches and a merge-based tokenizer take part: SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, one after another; what each keeps is stored for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
