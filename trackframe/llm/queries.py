"""The queries of the training-data operators, by name: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm import alignment, decontamination, licenses, media, packing, periodicity, pii, quality, reputation, secrets, simhash, warc, wordpieces
from trackframe.llm.common import spread
from trackframe.llm.common import table as given
from trackframe.llm.oracles import ORACLES, WARC_DATE
from trackframe.llm.tokens import added_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a small one over all cores, because what is done with each row takes long."""
    return spread(given(spark, sf_dir, name))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)
    return packed.withColumnRenamed("id", "doc_id")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: a document is a file under its source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", path).withColumnRenamed("id", "doc_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digests(pii.scan(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages"), WARC_DATE))
    return records.withColumnRenamed("id", "page_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = wordpieces.piece_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return counts.withColumnRenamed("id", "doc_id")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are those of the labelled documents that a page's path names."""
    pages = given(spark, sf_dir, "pages")
    outcomes = reputation.numbered_outcomes(pages, given(spark, sf_dir, "labels"))
    found = reputation.judge(pages, outcomes).withColumnRenamed("id", "page_id")
    return found.withColumns({c: F.round(c, 6) for c in ("bad_rate", "above_limit")})


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodicity.plant)
    return found.withColumnRenamed("id", "doc_id")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    found = alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_media_columns": op2_media_columns,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scans": op5_license_scans,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_url_filters": op11_url_filters,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

__all__ = ["ORACLES", "QUERIES"]
