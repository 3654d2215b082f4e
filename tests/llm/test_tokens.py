"""Fill-in-middle, streamed BPE and alignment against the libraries and brute force: nulls, empty and very long texts, marks, odd characters, repeated rows, clashing columns."""

import collections
import hashlib
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import alignment, bpe_stream, entries, fill_in_middle

SCHEMA = "doc_id long, text string, n int, form string, links int, _row string, ids int, pair int"


def make_rows():
    rng = random.Random(5)
    char = lambda: chr(rng.choice([32, 32, 10, 0xA0, 0x3C3, 0x3A3, rng.randrange(1, 0x250), rng.randrange(97, 123), rng.randrange(0x300, 0x3000), rng.randrange(0x1F000, 0x1FAFF), rng.randrange(0x10000, 0x20000)]))
    texts = [None, "", " ", "  ", "a ", " a\n\n b \n", "one", "<P>x", "x<S>", "<|endoftext|> x </s><s><|startoftext|>", "▁a", "a▁b", "\x00b\x00 c\x1c", "日本語 テキスト", "ΣΑΣ İstanbul don't DON'T", "x <S <P M> <<", "é é 가"]
    texts += ["".join(char() for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += ["qx" * 40_000, "a b. " * 30_000, "".join(rng.choice("abcdefgh") for _ in range(70_000)), "<" * 500, "word " * 9]
    rows = list(enumerate(texts)) + [(None, "no id at all"), (None, None), (5, " a\n\n b \n"), (5, "another text"), (5, "another text")]
    return [(i, t, 1, "plain", 2, "r", 3, 4) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(docs):
    got = fill_in_middle.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert counted(got) == counted(cut_by_hand(r[0], r[1]) for r in make_rows())
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_reads_the_texts_once(docs):
    from pyspark.sql import functions as F

    out = fill_in_middle.fill_in_middle(docs)
    out.select(F.sum(F.length("output"))).collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in plan  # no exchange but the one by row


def test_word_bpe_as_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entries.tokenizer_path("word_bpe_49k.json"))

    def by_library(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)

    got = bpe_stream.encode_and_decode(docs, entries.tokenizer_path("word_bpe_49k.json")).collect()
    assert counted((r[0], r[1], bytes(r[2]), r[3]) for r in got) == counted(by_library(r[0], r[1]) for r in make_rows())


def test_byte_level_decoding_as_the_library():
    from tokenizers import Tokenizer

    path, rng = entries.tokenizer_path(), random.Random(6)
    library, own = Tokenizer.from_file(path), bpe_stream.TextTransducer.of(path)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(30))]  # mostly no UTF-8
        assert own.decode(np.array(ids, dtype="<u4")) == library.decode(ids, skip_special_tokens=False)


def test_bytes_become_text_as_soon_as_whole():
    state = bpe_stream.ByteToText()
    assert [state.feed(bytes([b])) for b in "é€".encode() + b"\xe2a"] == ["", "é", "", "", "€", "", "�a"]
    assert state.feed(b"\xf0", True) == "�"


def plain_merge(ids, rules):
    ids = list(ids)
    while True:
        found = [(rules[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]
        if not found:
            return ids
        (_, whole), i = min(found)
        ids[i : i + 2] = [whole]


@st.composite
def merge_lists(draw):
    """Proper lists: each rule joins tokens that are there already."""
    tokens, merges = ["a", "b", "c"], []
    for _ in range(draw(st.integers(1, 14))):
        u, v = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if u + v not in tokens and len(u + v) < 14:
            merges.append((u, v))
            tokens.append(u + v)
    return {t: i for i, t in enumerate(tokens)}, merges


@settings(max_examples=400, deadline=None)
@given(merge_lists(), st.lists(st.integers(0, 2), max_size=60), st.integers(1, 5))
def test_stable_tokens_never_change(made, word, block):
    vocabulary, merges = made
    table = bpe_stream.Merges(vocabulary, merges)
    whole = plain_merge(word, table.rules)
    assert table.merge(word) == whole
    stream, out = bpe_stream.WordStream(table, block), []
    for i in range(0, len(word), 3):
        out += stream.feed(word[i : i + 3])
        assert out == whole[: len(out)] and (not table.proper or len(stream.held) < block + table.lookahead + 3)
    assert out + stream.finish() == whole


def test_a_token_longer_than_the_block_is_within_the_bound():
    merges = [("b", "b"), ("bb", "bb"), ("b", "a"), ("bbbb", "a"), ("a", "a")]
    table = bpe_stream.Merges({t: i for i, t in enumerate(["a", "b", "bb", "bbbb", "ba", "bbbba", "aa"])}, merges)
    units = [1, 1, 1, 1, 0, 0, 0, 0]
    for step in range(1, 4):
        stream, out = bpe_stream.WordStream(table, 1), []
        for i in range(0, len(units), step):
            out += stream.feed(units[i : i + step])
            assert len(stream.held) < 1 + table.lookahead + step
        assert out + stream.finish() == plain_merge(units, table.rules) == [5, 6, 0]


def test_long_words_are_emitted_while_they_are_read():
    own = bpe_stream.TextTransducer.of(entries.tokenizer_path("word_bpe_49k.json"))
    assert own.merges.proper and 0 < own.merges.lookahead < 2000
    rng = random.Random(8)
    units = [own.vocabulary[rng.choice("abcdefghij")] for _ in range(20_000)]
    stream, out, most = bpe_stream.WordStream(own.merges), [], 0
    for i in range(0, len(units), 500):
        out += stream.feed(units[i : i + 500])
        most = max(most, len(stream.held))
    assert most <= bpe_stream.BLOCK + own.merges.lookahead + 500 and out + stream.finish() == own.merges.merge(units)


@pytest.fixture(scope="module")
def files():
    return entries.tokenizer_path(), entries.tokenizer_path("piece_bpe_32k.model")


def aligned_by_hand(files):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    first.encode_special_tokens = True
    a_bytes, b_bytes = alignment.byte_vocabulary(files[0]), alignment.piece_vocabulary(files[1])

    def one(text):
        a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text or "")
        spelt = [b"".join(side[i] for i in ids) for side, ids in ((a_bytes, a), (b_bytes, b))]
        if not text or spelt != [f" {text}".encode()] * 2:
            return 0, 0, [], []
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((a_bytes, a), (b_bytes, b))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        links = [(x, y) for x, e in zip(a, ends[0]) for y in [dict(zip(ends[1], b)).get(e)] if y is not None] if len(a) < 400 else [(int(g.split("|")[0].split(",")[-1]), int(g.split(",")[-1].split("|")[-1])) for g in groups]
        return len(a), len(b), groups, links

    rows = [(r[0], *one(r[1])) for r in make_rows()]
    counts = collections.Counter(link for r in rows for link in r[4])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(i, na, nb, len(g), len(li), sum(counts[x] == highest[x[1]] for x in li), sum(counts[x] for x in li), digest(g)) for i, na, nb, g, li in rows]


def test_alignment(docs, files):
    got = alignment.align_and_count(docs, *files).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert counted(got) == counted(aligned_by_hand(files))


def test_linked_pairs_are_bounded_by_the_vocabularies(docs, files):
    a, b = alignment.byte_vocabulary(files[0]), alignment.piece_vocabulary(files[1])
    bound = alignment.most_pairs(a, b)
    assert bound == sum(1 for x in a[:300] for y in b if x.endswith(y) or y.endswith(x)) + alignment.most_pairs(a[300:], b)
    counts = alignment.pair_counts(alignment.align(docs, *files), len(b)).collect()
    assert 0 < len(counts) <= bound and all(a[r["pair"] // len(b)].endswith(b[r["pair"] % len(b)]) or b[r["pair"] % len(b)].endswith(a[r["pair"] // len(b)]) for r in counts)


def test_transducer_against_ends():
    a, b = [b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"bcd", b"d"]
    t = alignment.Transducer(a, b)
    assert t.groups([0, 1, 3], [0, 1, 3]) == [(2, 2), (3, 3)]
    assert t.groups([2, 3], [0, 2]) == [(2, 2)]
    assert t.groups([0], [0]) is None and t.groups([3], [0]) is None and t.groups([], []) == [] and t.groups([], [0]) is None


def test_empty_tables(spark, files):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_in_middle.fill_in_middle(empty).count() == 0
    assert bpe_stream.encode_and_decode(empty, entries.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert alignment.align_and_count(empty, *files).count() == 0


def test_only_empty_texts(spark, files):
    blank = spark.createDataFrame([(1, None, 0, "", 0, "", 0, 0), (2, "", 0, "", 0, "", 0, 0)], SCHEMA)
    assert [tuple(r)[1:] for r in alignment.align_and_count(blank, *files).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert [tuple(r)[1:] for r in fill_in_middle.fill_in_middle(blank).collect()] == [(0, "plain", None, None, "", "")] * 2


def test_queries_of_the_table(spark):
    for name, columns in {
        "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12_bpe_stream": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    }.items():
        got = entries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert got.columns == columns and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
