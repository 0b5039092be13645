"""Documents through five of the operators of effortlens.llm, each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's documents. Stages decide about rows, not
ids: rows without a doc_id, and different texts under one, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortlens.llm import bpe, queries, secrets, simhash, tiling, toxicity
from effortlens.session import materialise

# Names a row inside a stage.
ROW = "_row"
# Rows that Python gets at once: whole texts, in the memory of the executor and of its workers.
BATCH_ROWS = 512


def _small_batches(spark: SparkSession) -> None:
    """Limits the batches of the session, as what a stage returns is run after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each, written so that the numbers stay, and (number as doc_id, text) for an operator."""
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), f"pipeline-rows-{name}")
    return rows, rows.select(F.col(ROW).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5, as fitted on the labels of these documents."""
    _small_batches(spark)
    machine = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(machine, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row: that with the smallest doc_id, rows without one last; of rows alike in that, any."""
    _small_batches(spark)
    rows, texts = _numbered(docs, "near-duplicates")
    found = simhash.near_duplicates(texts).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    first = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("group").agg(F.min(order)[ROW].alias(ROW))
    return rows.join(first.select(ROW), ROW, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text covers no benchmark item."""
    _small_batches(spark)
    rows, texts = _numbered(docs, "decontamination")
    found = tiling.contaminated(texts, queries.table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all columns, their token ids, and whether decoding these gives the text again."""
    _small_batches(spark)
    encoded = bpe.encode(docs, *queries.tokenizer(), keep=docs.columns)
    whole = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

# Fitted models and token ranks have no SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
