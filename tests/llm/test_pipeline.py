"""The pipeline's stages against brute force on a small table."""

import random
import struct
import zlib

import pytest

import corpus_pipeline
from siftline.llm import mixing
from siftline.llm.entries import tokenizer_path

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
CLEAN = {i: " ".join(RNG.choice(WORDS) for _ in range(60)) for i in range(60)}
ITEM = " ".join(RNG.choice(WORDS) for _ in range(30))
TOXIC = {i: "you utter blockhead nitwit " + CLEAN[i - 100] for i in range(100, 130)}
TEXTS = CLEAN | TOXIC | {200: CLEAN[3], 201: CLEAN[4] + " more", 202: " ".join(WORDS[:20]) + " " + ITEM}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i in TOXIC)) for i in (*CLEAN, *TOXIC)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def expected_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t in texts:
        found = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(found), zlib.crc32(struct.pack(f"<{len(found)}I", *found))))
        start += len(found)
    return want


def test_stages(spark, tables):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tables}/documents.parquet")
    kept = stages["toxicity"](spark, docs, tables)
    assert ids(kept) == sorted(set(TEXTS) - set(TOXIC))
    kept = stages["ngram_jaccard"](spark, kept, tables)
    assert ids(kept) == [*CLEAN, 202]
    kept = stages["decontaminate"](spark, kept, tables)
    assert ids(kept) == [*CLEAN]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(kept).collect()}
    mixed = stages["mixing"](spark, kept, tables)
    assert len(ids(mixed)) >= 1 and set(ids(mixed)) <= set(CLEAN)
    order = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert sorted(tuple(r[:4]) for r in stages["token_output"](spark, mixed, tables).collect()) == sorted(expected_tokens(order))
    assert all(ids(mixed).count(i) == n for i, n in taken.items())


def test_run(spark, tables):
    rows = [tuple(r[:4]) for r in corpus_pipeline.run(spark, tables).collect()]
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 100")
    order = sorted((r["doc_id"], r["text"]) for r in mixing.emit_copies(mixing.mix_sources(docs), docs.columns).collect())
    assert sorted(rows) == sorted(expected_tokens(order))


HARD = "doc_id long, text string, lang string, source string, n_chars long, key long, component_id long, target double, shard int, taken long, held_out string, predicted int, score string, ids int, data string, size int, class_id int"


@pytest.fixture(scope="module")
def hard_tables(spark, tables, tmp_path_factory):
    """Nulls in every column, empty and blank texts, repeated rows, one doc_id with two texts, columns named as the stages' own."""
    d = str(tmp_path_factory.mktemp("hard"))
    rest = (1, 2, 3.0, 4, 5, "x", 1, "y", 6, "z", 7, 8)
    rows = [(i, t, "en", f"s{i % 2}", len(t), *rest) for i, t in TEXTS.items()]
    rows += [(None, None, *[None] * 15), (None, CLEAN[7], None, None, None, *rest), (300, None, "en", "s1", 0, *rest), (301, "", "en", None, 0, *rest), (302, " \n", "en", "s0", 2, *rest)]
    rows += [rows[5], rows[5], (5, "another text of five words", "en", "s1", 9, *rest), (303, "x" * 200_000, "en", "s0", 1, *rest), (304, CLEAN[8], "de", "s2", 1, *[None] * 12)]
    spark.createDataFrame(rows, HARD).repartition(3).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d, rows


def test_hard_rows(spark, hard_tables):
    d, rows = hard_tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if name != "token_output":
            assert docs.columns == before.columns
        kept = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert docs.count() == len(rows) - len(TOXIC) and {None, 300, 301, 302, 303} <= kept
        if name == "ngram_jaccard":
            # a null doc_id is the least, so of its text's copies it stays; copies under one doc_id are one row; texts without words all stay
            assert 7 not in kept and 304 not in kept and {None, 5, 300, 301, 302, 303} <= kept
            assert docs.where("doc_id = 5").count() == 2 and docs.where("doc_id is null").count() == 2
        if name == "decontaminate":
            assert 202 not in kept and {None, 300, 301, 302, 303} <= kept
    assert docs.select("doc_id", "start", "n_tokens", "ids_crc32").count() > 0


def test_empty_documents(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0 if t == "documents" else 1000).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
