"""A corpus pipeline over `documents`: each stage's rows are written as Parquet and reread by the next one.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents; the last one adds each text's sampled pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, linededup, neardup, pieces, queries
from tidemark.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _small_batches(spark: SparkSession) -> None:
    """The stages follow one another on the same executors, whose Python workers and Arrow buffers keep what they once
    took, so a batch of long texts is kept to 1,000 rows unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10000:
        spark.conf.set(name, "1000")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters; the others are in no language (`und`). That alone decides: the fitted model's labels and
    scores reject nothing, as a document is kept in whatever language it is."""
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.filter(queries.remainder("doc_id", 3) != 1))
    return language.identify(docs, model).filter(F.col("lang_pred") != "und").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rid of lines that stand, or nearly stand, in an earlier one; n_chars follows the text. A document goes
    where none of its lines is left."""
    _small_batches(spark)
    out = linededup.dedup(docs.select(*COLUMNS))
    return out.filter("n_lines = 0 or n_kept > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Rows that share it are one document."""
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    gone = neardup.link(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a reproducible sampled segmentation (piece_ids)."""
    _small_batches(spark)
    return pieces.encode_sampled(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages are models, sketches and samplers, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = written(docs, name)
    return docs
