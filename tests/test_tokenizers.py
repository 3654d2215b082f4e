"""Tokenizers by name: offsets cut the text into what the ids stand for, windows and rows of each."""

import pytest
from siftline.operators import chunks, tokens

TEXTS = ["one two  three\nfour", "", None, "ab\U0001f600 é ab", "   ", "aXbc" * 50]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    folder = tmp_path_factory.mktemp("vocabularies")
    (folder / "plain.txt").write_text("a\nab\naXb\none\n \nfour\n\n", encoding="utf-8")
    made = Tokenizer(models.WordLevel({"one": 0, "two": 1, "three": 2, "?": 3}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(str(folder / "words.json"))
    return {"char": None, "word": None, "vocabulary": str(folder / "plain.txt"), "tokenizers": str(folder / "words.json")}


@pytest.mark.parametrize("name", ["char", "word", "vocabulary", "tokenizers"])
def test_offsets(spark, files, name):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r["id"]: [tuple(t) for t in r["t"]] for r in rows.select("id", tokens.tokens("text", name, files[name]).alias("t")).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        cut = [text[s:e] for _, s, e in got[i]]
        if name in ("char", "vocabulary"):
            assert "".join(cut) == text
        if name == "char":
            assert [k for k, *_ in got[i]] == [ord(c) for c in text]
        if name == "word":
            assert cut == text.split()
            assert len({k for k, *_ in got[i]}) == len(set(cut))
    if name == "vocabulary":
        assert [k for k, *_ in got[0]] == [3, 4, -1, -1, -1, 4, 4, -1, -1, -1, -1, -1, -1, 5] and got[5][:2] == [(2, 0, 3), (-1, 3, 4)]
    if name == "tokenizers":
        assert got[0] == [(0, 0, 3), (1, 4, 7), (2, 9, 14), (3, 15, 19)]
    spark.udtf.register("tokenize", tokens.TokenRows)
    path = "NULL" if files[name] is None else f"'{files[name]}'"
    listed = spark.sql(f"SELECT r.id AS row, t.* FROM {{rows}} r, LATERAL tokenize(r.text, '{name}', {path}, true) t", rows=rows).collect()
    assert {i: [(r["id"], r["start"], r["end"]) for r in sorted((r for r in listed if r["row"] == i), key=lambda r: r["n"])] for i in got} == got
    assert all(r["token"] == TEXTS[r["row"]][r["start"] : r["end"]] for r in listed)
    assert "token" not in spark.sql(f"SELECT t.* FROM {{rows}} r, LATERAL tokenize(r.text, '{name}', {path}) t", rows=rows).columns


def test_windows_of_ids(spark):
    row = spark.createDataFrame([("abcdefghij",)], "text string")
    cut = chunks.explode_windows(row.select(tokens.tokens("text", "char").alias("t")), "t", 4, 1).collect()
    assert [("".join(chr(t["id"]) for t in r["tokens"]), r["tokens"][0]["start"], r["tokens"][-1]["end"]) for r in cut] == [("abcd", 0, 4), ("defg", 3, 7), ("ghij", 6, 10)]


def test_own_tokenizers(spark):
    with pytest.raises(ValueError, match="no tokenizer none"):
        tokens.get("none")
    tokens.register("whole", lambda _: lambda texts: [([7], [0], [len(t)]) for t in texts])
    assert tokens.get("whole")(["abc"]) == [([7], [0], [3])]


def test_merge_of_nested_spans(spark):
    spans = [("d", 0, 1, 0.5), ("d", 0, 4, 1.0), ("d", 0, 4, 0.0), ("d", 2, 4, 0.25), ("d", 3, 3, 1.0), ("d", -1, 2, 1.0), ("e", 0, 1, 0.75)]
    got = chunks.merge_scores(spark.createDataFrame(spans, "k string, start int, end int, score double"), "k").collect()
    assert {tuple(r) for r in got} == {("d", 0, 1, 0.5), ("d", 0, 4, 0.5), ("d", 2, 4, 0.25), ("e", 0, 1, 0.75)}
