"""From raw documents to token files: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, jaccard_join, mixing, token_output, toxicity
from siftline.llm._store import lasting_path, work_table
from siftline.llm.entries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document of least doc_id (one of its rows, if several have its text). Documents without words are all kept."""
    found = jaccard_join.near_duplicate_components(docs)
    keepers = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keepers, docs["doc_id"].eqNullSafe(keepers["_kept"]), "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    pairs = decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = pairs.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit_copies(mixing.mix_sources(docs), docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, in a folder token_files-... that stays (see lasting_path), read back: doc_id, start, n_tokens, ids_crc32 of every copy."""
    path = lasting_path(spark, "token_files")
    token_output.write_tokens(docs, path, tokenizer_path())
    return token_output.with_checksums(token_output.read_tokens(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_token_files),
]
#: The trained, iterative and tokenizing stages have no SQL form; tests/llm/test_pipeline.py holds the stages and run() against expected rows of a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else work_table(docs), sf_dir)
    return docs
