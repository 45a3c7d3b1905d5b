"""The driver's queries over this package's operators, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulspark.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.license import license_scan

    return license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, window=2048)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.topk import top_products

    return top_products(read(spark, sf_dir, "embeddings"), k=20, query_every=20, scale=64.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.toxicity import toxic_scores

    return toxic_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from haulspark.llm.bpe import round_trip_digest

    return round_trip_digest(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.records import tokens_round_trip

    return tokens_round_trip(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.ngram_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.html_extract import extract

    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"), "source", "text", max_ratio=0.1, min_pages=5).select("doc_id", "n_lines", "n_dropped", "text")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.word_runs import digests

    return digests(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.spelling import spelling_forms

    return spelling_forms(read(spark, sf_dir, "documents"))


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from haulspark.llm.repeats import digests

    return digests(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from haulspark.llm import license, line_dedup, topk

    return {"op1_license_scan": license.sql(), "op4_exact_topk": topk.SQL, "op10_line_dedup": line_dedup.SQL}
