"""The registered queries of the text operators, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoexposure.llm import exact_dedup, html_text, mixing, pii, quality, ranked, sentencepiece_codec, simhash, token_counts, token_files, topk, toxicity, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same place on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encoded(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "ids_crc32", "round_trip", "same_ids")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_documents(spark, sf_dir))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, "vec_id % 50 = 0", 5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.selectExpr("doc_id", "_severity AS severity", "_grade AS grade", "_p_toxic AS p_toxic", "_toxic AS toxic")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), words=3, bits=3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_report(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, _documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_topk": op4_topk,
        "op5_toxicity": op5_toxicity,
        "op6_simhash": op6_simhash,
        "op7_mixing": op7_mixing,
        "op8_token_counts": op8_token_counts,
        "op9_token_files": op9_token_files,
        "op10_quality": op10_quality,
        "op11_html_text": op11_html_text,
        "op12_vector_codes": op12_vector_codes,
        "op13_ranked": op13_ranked,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.DUPLICATES_SQL,
        "op4_topk": topk.TOP5_SQL,
        "op7_mixing": mixing.REPORT_SQL,
        "op12_vector_codes": vector_codes.COMPRESSED_SQL,
        "op13_ranked": ranked.RANKED_SQL,
    }
