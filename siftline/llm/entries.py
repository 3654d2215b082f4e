"""The queries op1 ... op13 over whole tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_stream, decontaminate, fill_in_middle, fingerprints, html_extract, jaccard_join, mixing, quality, substring_dedup, suffix_dedup, token_output, toxicity
from ._store import work_path


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_word_windows(_table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(_table(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_byte_strings(_table(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark)
    token_output.write_tokens(_table(spark, sf_dir), path, tokenizer_path())
    return token_output.with_checksums(token_output.read_tokens(spark, path))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe_stream.encode_and_decode(_table(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_and_count(_table(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_ngram_jaccard, op3_quality, op4_decontaminate, op5_mixing, op6_suffix_dedup, op7_fingerprints, op8_token_output, op9_toxicity, op10_html_extraction,
        op11_fill_in_middle, op12_bpe_stream, op13_alignment,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_mixing": mixing.ORACLE_SQL, "op11_fill_in_middle": fill_in_middle.ORACLE_SQL}
