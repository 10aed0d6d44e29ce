"""The queries of this subpackage: each applies its operator, with production parameters, to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, licenses, linededup, lmscore, media, neardup, pieces, scratch, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learned from those whose remainder by 10 is not 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    out = lmscore.score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), *[c for c in out.columns if c != "doc_id"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled."""
    path = scratch.new_path(spark, "warc")
    warc.write_archives(warc.plan_captures(_table(spark, sf_dir, "pages")), path)
    return warc.digest(warc.assemble(warc.read_archives(spark, path, payloads=False)))


OP2_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece count and best score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.token_counts(docs).drop("text")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as lossless WebP, read back from the stored table."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    stored, _ = scratch.written(media.to_webp(docs), "webp")
    return media.read_webp(stored)


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sampled segmentation of every document, and whether it decodes to the same bytes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_sampled(docs, digest=True).drop("text")


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, wherever in the text it stands."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, _table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, Jaccard similarity 0.75."""
    return neardup.link(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rid of lines that repeat, or nearly repeat, a line elsewhere."""
    return linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder by 3 is not 1."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    out = language.identify(docs.drop("lang"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_licenses": op8_licenses,
    "op9_webp": op9_webp,
    "op10_sampled_pieces": op10_sampled_pieces,
}

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL}
