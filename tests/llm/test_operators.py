"""Operators against brute force on one table of hard cases: nulls, empty and long texts, ties, repeated rows, near copies, clashing columns."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import _anchors, decontaminate, entries, fingerprints, html_extract, jaccard_join, mixing, quality, substring_dedup, suffix_dedup, token_output, toxicity
from siftline.llm._store import work_path
from siftline.llm._text import BYTE_CODES, gram_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, anchor string, size int, score string"


def make_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(300), prose(70)
    near = base.split()
    near[50], near[200] = "changed", "words"
    texts = [None, "", " \n\t", "one", "a b c d e", base, base, " ".join(near), f"{prose(40)} {passage} {prose(30)}", f"{passage}\n{prose(90)}", prose(4000), "x" * 3000, "x y " * 300, " a\x01b  c\n\n d <|endoftext|>", base.upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, prose(60))]
    return [(i, t, "en", None if (i or 0) % 5 == 4 else f"s{(i or 0) % 3}", 1, 7, "z", 2, "q") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in make_rows()}


def order(texts):
    return sorted(texts, key=lambda i: -1 if i is None else i)


def test_word_windows(docs, texts):
    seen, want = set(), {}
    for i in order(texts):
        w = texts[i].encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (g := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, b in zip(w, gone) if not b)).hexdigest())
    assert {r[0]: tuple(r[1:4]) for r in substring_dedup.dedup_word_windows(docs).collect()} == want


def test_byte_strings(docs, texts):
    count = collections.Counter(t.encode()[k : k + 400] for t in texts.values() for k in range(len(t.encode()) - 399))
    want = {}
    for i, t in texts.items():
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = [True] * 400
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    assert {r[0]: tuple(r[1:5]) for r in suffix_dedup.dedup_byte_strings(docs).collect()} == want


@pytest.mark.parametrize("test", [test_word_windows, test_byte_strings])
def test_hot_segments(docs, texts, monkeypatch, test):
    """The ways of hot anchors and hot segments, which small tables don't reach, give the same."""
    monkeypatch.setattr(_anchors, "HOT_SEGMENTS", 1)
    monkeypatch.setattr(_anchors, "HOT_SHARE", 1 << 40)
    test(docs, texts)


def test_segments_are_not_dealt_by_anchor_to_find_hot_ones(spark, docs, monkeypatch):
    plans, made = {}, _anchors.work_table
    monkeypatch.setattr(_anchors, "work_table", lambda df: plans.setdefault(df.columns[-1], df._jdf.queryExecution().sparkPlan().toString()) and made(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert suffix_dedup.dedup_byte_strings(docs).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x.strip(" :+-") for x in plans["bits"].splitlines() if "Join" in x]
    assert sum(x.startswith("BroadcastHashJoin [anchor#") for x in joins) == 1 and not any(x.startswith("SortMergeJoin [anchor#") for x in joins)


def test_repeated_rows_by_value(docs, texts):
    """Every row twice: of a text of one window or more, the copy (op1) or everything (op6) goes; components don't change."""
    twice = docs.union(docs)
    for r in suffix_dedup.dedup_byte_strings(twice).collect():
        n = len(texts[r["doc_id"]].encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, n * (n >= 400), int(n >= 400))
    once = {r["doc_id"]: r for r in substring_dedup.dedup_word_windows(docs).collect()}
    found = collections.defaultdict(list)
    for r in substring_dedup.dedup_word_windows(twice).collect():
        found[r["doc_id"]].append(r["n_removed"])
    assert all(len(x) == 2 and min(x) >= once[i]["n_removed"] and max(x) <= once[i]["n_words"] for i, x in found.items())
    pairs = lambda df: {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_components(df).collect()}
    assert pairs(twice) == pairs(docs)


def test_segments_of_a_very_long_text():
    rng = np.random.default_rng(8)
    passage, window, gram = rng.integers(0, 256, 600).astype(np.uint8), 400, 20
    data = rng.integers(0, 256, (1 << 24) + 5000).astype(np.uint8)
    places = 1000, (1 << 24) - 300, (1 << 24) + 3000
    for k in places:
        data[k : k + 600] = passage
    _, anchor, start, n_win, at = _anchors.segments(BYTE_CODES[data], np.array([0, len(data)]), window, gram)
    assert (at >= start + n_win - 1).all() and (at <= start + window - gram).all() and n_win.sum() == len(data) - window + 1
    found = [{(a, p - k) for a, s, n, p in zip(anchor.tolist(), start.tolist(), n_win.tolist(), at.tolist()) if s < k + 201 and s + n > k} for k in places]
    assert found[0] == found[1] == found[2]


def test_segments_in_stretches(monkeypatch):
    units = BYTE_CODES[np.random.default_rng(9).integers(0, 2, 5000)]
    begins = np.array([0, 700, 720, 4900, 5000])
    for window, gram in ((20, 6), (400, 20), (64, 64)):
        g = gram_hashes(units, gram)
        monkeypatch.setattr(_anchors, "_POSITION", np.uint64(511))
        hashes, span = (g & ~np.uint64(511)).tolist(), window - gram + 1
        assert _anchors._least(g, span).tolist() == [min(range(k, k + span), key=hashes.__getitem__) for k in range(len(g) - span + 1)]
        assert len(_anchors.segments(units, begins, window, gram)[0])


def test_jaccard(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    least = {i: i for i in texts}
    rank = lambda i: -1 if i is None else i
    for _ in texts:
        for i in texts:
            for j in texts:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j], key=rank)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_components(docs).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in texts}


def link_components(sets, percent=80):
    """Least reachable document of each, and the links, by comparing all pairs of sets."""
    count = collections.Counter(x for s in sets.values() for x in s)
    number = {x: k for k, x in enumerate(x for x, n in count.items() if n > 1)}
    ids = list(sets)
    has = np.zeros((len(ids), len(number)), dtype=np.float32)
    for row, i in enumerate(ids):
        has[row, [number[x] for x in sets[i] if x in number]] = 1
    size, both = np.array([len(sets[i]) for i in ids]), np.rint(has @ has.T)
    linked = [(ids[a], ids[b]) for a, b in np.argwhere(100 * both >= percent * (size[:, None] + size - both)) if a < b]
    least, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for i, j in linked:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    return least, linked


@pytest.mark.parametrize("hot_share", [2048, 20_000_000])
def test_jaccard_of_one_boilerplate_and_many_documents(spark, monkeypatch, hot_share):
    """2,000 different documents around one passage: next to the threshold on both sides, in groups of near copies, and across sizes."""
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", hot_share)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(90)]
    texts = {i: [*(word() for _ in range(rng.randint(0, 22))), *passage[: 90 - rng.randint(0, 3)], *(word() for _ in range(rng.randint(0, 8)))] for i in range(1700)}
    for i in range(1700, 2000):
        near = [*texts[i % 40]]
        near[rng.randrange(len(near))] = word()
        texts[i] = near
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    least, linked = link_components(sets)
    assert len({*least.values()}) > 100 and len(linked) > 1000
    got = jaccard_join.near_duplicate_components(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least


def test_signatures_meet():
    """Whatever the frequent class, two sets at the threshold have a signature in common that one of them leads with."""
    rng = np.random.default_rng(6)
    for trial in range(400):
        n = int(rng.integers(2, 300))
        m = int(rng.integers(n, n * 5 // 4 + 1))
        both = -(-80 * (n + m) // 180)
        if both > n:
            continue
        tokens = np.unique(rng.integers(0, 1 << 62, n + m - both).astype(np.uint64))
        rng.shuffle(tokens)
        often = {*tokens[rng.random(len(tokens)) < rng.choice([0, 0.5, 0.9, 1])].tolist()}
        x, y = np.sort(tokens[:n]), np.sort(tokens[n - both :])
        found = [dict(zip(*(a.tolist() for a in jaccard_join.signatures(t, np.array([v in often for v in t.tolist()], dtype=bool), 80)), strict=True)) for t in (x, y)]
        assert any(found[0][s] or found[1][s] for s in found[0].keys() & found[1].keys()) or n < 2, trial


def test_fine_bitmaps():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for n, m, shared in ((2000, 2000, 1800), (2000, 2200, 2000), (3000, 3000, 0), (5000, 4000, 4000), (300, 2000, 300)):
        x, y = tokens[:n], tokens[n - shared : n - shared + m]
        found = jaccard_join.fine_difference(jaccard_join.fine_bitmap(np.sort(x)), jaccard_join.fine_bitmap(np.sort(y)))
        assert found <= n + m - 2 * shared and (n + m - 2 * shared < 4000 or found > 1000)


def test_mixing(docs, texts):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts) and {c for c in docs.columns} - {"size"} <= {*rows[0].asDict()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(t.encode().split()) for i, t in texts.items()}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    targets = {(r["source"], r["target"], r["source_size"]) for r in rows}
    assert sum(t for _, t, _ in targets) == pytest.approx(sum(s for _, _, s in targets)) and all(t <= 3 * s + 1e-9 for _, t, s in targets)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    down = order(texts)[::-1]
    for k, i in enumerate(down):
        changed = fingerprints.edited(texts[i], texts[down[(k + 1) % len(down)]])
        assert got[i]["n_chars"] == len(texts[i]) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == fingerprints.written(fingerprints.chunk_sets(changed.encode()))
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[0]["fingerprint"] == ""
    assert fingerprints.likeness(fingerprints.chunk_sets(texts[10].encode()), fingerprints.chunk_sets(b"inserted " + texts[10].encode())) > 0.9


def slow_chunks(data, scale):
    """Chunks by the definition: the hash of the last 32 bytes at every place, and one place after the other."""
    least, normal, most, hard, easy = scale
    gear, ends, begin = fingerprints._GEAR.tolist(), [], 0
    h = [sum(gear[data[i - j]] << j for j in range(min(32, i + 1))) % 2**32 for i in range(len(data))]
    for i in range(len(data)):
        size = i + 1 - begin
        bits = hard if size <= normal else easy
        if size > least and h[i] >> (32 - bits) == 0 or size == most or i == len(data) - 1:
            ends.append(data[begin : i + 1])
            begin = i + 1
    return {*ends}


def test_fingerprints_against_slow_chunks(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    down = order(texts)[::-1]

    def likeness(a, b):
        a, b = a.encode(), b.encode()
        if not a or not b:
            return float(not a and not b)
        scale = next(s for s in "cft" if min(len(a), len(b)) >= fingerprints.SERVES[s])
        x, y = (slow_chunks(t, fingerprints.SCALES[scale]) for t in (a, b))
        return sum(map(len, x & y)) / min(sum(map(len, x)), sum(map(len, y)))

    for k, i in enumerate(down):
        following = texts[down[(k + 1) % len(down)]]
        if max(len(texts[i]), len(following)) < 5000:
            want = likeness(texts[i], fingerprints.edited(texts[i], following)), likeness(texts[i], following)
            assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx(want), i


@pytest.mark.parametrize("short, long", [(80, 400), (90, 5000), (300, 2048), (1000, 50_000)])
def test_fingerprints_of_short_texts_in_long_ones(spark, short, long):
    rng = random.Random(short)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(long))
    sets = lambda t: fingerprints.chunk_sets(t.encode())
    part, other = text[long // 3 : long // 3 + short], "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ ") for _ in range(short))
    assert fingerprints.likeness(sets(part), sets(text)) == fingerprints.likeness(sets(text), sets(part)) > 0.4 + fingerprints.likeness(sets(other), sets(text))
    rows = spark.createDataFrame([(2, part), (1, text)], "doc_id long, text string")
    assert [r["near_next"] for r in fingerprints.fingerprint_documents(rows).collect()] == [fingerprints.likeness(sets(part), sets(text))] * 2


def test_tokens(spark, docs, texts):
    from tokenizers import Tokenizer

    path, tokenizer = work_path(spark), Tokenizer.from_file(entries.tokenizer_path())
    token_output.write_tokens(docs, path, entries.tokenizer_path())
    start, want = 0, {}
    for i in order(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in token_output.with_checksums(token_output.read_tokens(spark, path)).collect()} == want


def test_token_files(spark, docs, texts):
    """Encodings, page indexes and row groups of the files, and a read of one document's rows alone."""
    import glob

    import pyarrow.parquet as pq

    path = work_path(spark)
    token_output.write_tokens(docs, path, entries.tokenizer_path(), files=2)
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path}/*.parquet")) if pq.ParquetFile(f).metadata.num_rows]
    assert len(files) == 2
    for f in files:
        group = f.metadata.row_group(0)
        columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["shard_start"].encodings
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        assert all(f.metadata.row_group(k).total_byte_size <= 40 << 20 for k in range(f.metadata.num_row_groups))
    one = token_output.read_tokens(spark, path).where("doc_id = 5").select("doc_id", "n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and one.count() == 1
    light = pq.read_table(glob.glob(f"{path}/*.parquet"), columns=["doc_id", "n_tokens"])
    assert light.num_rows == len(texts)


def test_other_tokenizer_files(tmp_path):
    """A file that splits texts in another way is used on whole texts."""
    import json

    from tokenizers import Tokenizer

    told = json.loads(open(entries.tokenizer_path(), encoding="utf-8").read())
    told["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    path = str(tmp_path / "other.json")
    open(path, "w", encoding="utf-8").write(json.dumps(told))
    texts = ["one 12  two", "", "x y"]
    ids, sizes = token_output.PieceEncoder.of(path).encode([t.encode() for t in texts])
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    assert token_output.PieceEncoder.of(entries.tokenizer_path()).cuts


def test_toxicity(spark, docs):
    rng = random.Random(1)
    rows = [(i, ("you utter blockhead nitwit " if i % 4 == 0 else "") + " ".join(rng.choice(["tea", "rain", "wood", "bread", "road"]) for _ in range(30))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (999, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(spark.createDataFrame([*rows, (1000, "you blokhead"), (1001, None)], "doc_id long, text string"), labels).toPandas().set_index("doc_id")
    assert (got.predicted[[i for i, _ in rows]] == [int(i % 4 == 0) for i, _ in rows]).all()
    assert got.score.between(0, 1).all() and got.predicted[1001] == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    lexicon = toxicity.Lexicon({"blockhead": 3.0})
    assert [lexicon.near(w) for w in ("blokhead", "blockhed", "blockheadd", "xlockhead", "block")] == ["blockhead"] * 4 + [None]
    assert lexicon.is_quoted('he "blockhead" again'.split(), 1) and not lexicon.is_quoted("you blockhead again".split(), 1)


def test_toxicity_does_not_depend_on_partitions(spark):
    """The same lexicon and scores, whether a task has all labelled rows or hardly one."""
    rng = random.Random(2)
    words = [f"w{i:03d}" for i in range(900)]
    rows = [(i, " ".join([*(["nitwit"] if i % 7 == 0 else []), *rng.sample(words, 25)])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)], "doc_id long, toxic int")
    learnt, scores = [], []
    for n in (1, 8, 300):
        dealt = docs.repartition(n).cache()
        weights, own, model = toxicity.train(dealt, labels, ~toxicity.held_out("doc_id"), "doc_id", "text")
        learnt.append((weights, own, *(x.tolist() for x in model)))
        if n != 8:
            scores.append(sorted((r["doc_id"], r["score"]) for r in toxicity.score_toxicity(dealt, labels).collect()))
    assert learnt[0] == learnt[1] == learnt[2] and learnt[0][0].keys() == {"nitwit", "nitwi*"}
    assert scores[0] == scores[1]


def test_misspelled_terms_at_the_bounds():
    long = "abcdefghij" * 4
    lexicon = toxicity.Lexicon({"idiot": 3.0, "dolt": 3.0, "moron*": 3.0, long: 2.0})
    words = "idot", "diot", "idio", "idiott", "idixt", f"{long}x", f"x{long}", long[1:]
    assert [lexicon.look(w) for w in words] == [("idiot", 3.0, 2)] * 5 + [(long, 2.0, 2)] * 3
    assert [lexicon.look(w) for w in ("idt", "dol", "dolts", "moro", f"{long}xy", "ido")] == [None] * 6 and toxicity.Lexicon({}).look("word") is None


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, int(i not in (11, 12, 14))) for i in range(15)], "doc_id long, quality int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(docs, labels.limit(0)).count() == len(rows)


def test_quality_by_hand(spark):
    """Posteriors of sites and paths, and scores, in plain arithmetic from the texts' probabilities."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        host, lang = rng.choice([("a", "en"), ("a", "de"), ("b", "en"), ("b", "en"), ("c", "fr"), (None, "en")])
        good = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.5, None: 0.5}[host]
        rows.append((i, " ".join(rng.choice(["tea", "rain", "wood"]) if good else rng.choice(["@#$", "%%", "!!"]) for _ in range(20)) + ".", host, lang, int(good)))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    got = quality.score_quality(docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")).collect()
    p = {r["doc_id"]: r["text_probability"] for r in got}
    site, path = ({r[0]: key(r) for r in rows} for key in (lambda r: r[2], lambda r: (r[2], r[3])))
    total = np.mean([*p.values()])

    def groups(of):
        out = collections.defaultdict(list)
        for i, g in of.items():
            out[g].append(p[i])
        return out

    def strength(members, parent):
        spread = sum(len(x) * (np.mean(x) - parent[g]) ** 2 for g, x in members.items() if len(x) > 1)
        noise = {g: parent[g] * (1 - parent[g]) for g in members}
        rho = max(0, (spread - sum(noise[g] for g, x in members.items() if len(x) > 1)) / sum(len(x) * noise[g] for g, x in members.items() if len(x) > 1))
        return min(10_000, max(2, 1 / rho - 1 if rho > 0 else 10_000))

    sites, paths = groups(site), groups(path)
    k = strength(sites, dict.fromkeys(sites, total))
    of_site = {g: (sum(x) + k * total) / (len(x) + k) for g, x in sites.items()}
    k = strength(paths, {g: of_site[g[0]] for g in paths})
    logit = lambda x: np.log(x / (1 - x))
    for r in got:
        i, g = r["doc_id"], path[r["doc_id"]]
        of_path = (sum(paths[g]) - p[i] + k * of_site[g[0]]) / (len(paths[g]) - 1 + k)
        odds = logit(p[i]) - logit(total) + logit(of_path)
        assert (r["host_mean"], r["path_mean"], r["score"]) == pytest.approx((of_site[g[0]], of_path, 1 / (1 + np.exp(-odds))))
        assert r["keep"] == (r["score"] >= 0.5)
    held = [(r["keep"], bool(rows[r["doc_id"]][4])) for r in got]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_decontamination(spark, docs, texts):
    item = " ".join(texts[10].split()[100:140])
    words = item.split()
    words[5], words[17], words[29] = "other", "terms", "here"
    bench = spark.createDataFrame([(1, item), (2, " ".join(words)), (3, None), (4, ""), (None, "entirely different words that nobody wrote")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {(10, 1), (10, 2)}
    assert decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav>Menu</nav><div class="ad">Buy, now!</div><article><h1>Head &amp; line</h1><p>Some text,\n with <b>bold</b> words.<p>More of it, here.</article><div id="comments"><p>Nice, I liked it.</p></div><footer>(c)</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page), (3, "w", "<script>x<"), (4, "w", "plain, text")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract_main_text(rows).collect())
    main = "Head & line\n\nSome text, with bold words.\n\nMore of it, here."
    assert got == sorted([("1", main, len(main)), ("1", main, len(main)), ("2", "", 0), ("3", "", 0), ("4", "plain, text", 11), ("None", "", 0)])


def test_decontamination_recall_of_paraphrases(spark):
    """Planted items with up to a quarter of their words replaced, against a search of all windows of all texts; more items than the latent space has dimensions."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 7))) for _ in range(1500)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: prose(rng.randint(16, 50)) for i in range(90)}
    texts = {k: prose(rng.randint(30, 500)) for k in range(300)}
    for i, t in items.items():
        changed = [rng.choice(vocab) if rng.random() < (0, 0.1, 0.2, 0.26)[i % 4] else w for w in t]
        at = rng.randrange(len(texts[3 * i]))
        texts[3 * i][at:at] = changed
    want = set()
    for k, b in texts.items():
        for i, a in items.items():
            n, masks = len(a), decontaminate.positions(np.array(a))
            if len({*a} & {*b}) < 0.3 * n:
                continue
            for lo in range(0, max(1, len(b) - n // 2), max(1, n // 4)):
                window = b[lo : lo + n + n // 4 + 4]
                share = decontaminate.lcs_length(masks, n, window) / n
                tail = a[-decontaminate.ANSWER_WORDS :]
                if share >= decontaminate.ALIKE or share >= decontaminate.ALIKE_WITH_ANSWER and decontaminate.lcs_length(decontaminate.positions(np.array(tail)), len(tail), window) >= decontaminate.ANSWER_FOUND * len(tail):
                    want.add((k, i))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r[0], r[1]) for r in decontaminate.contaminated_pairs(docs, bench).select("doc_id", "item_id").collect()}
    assert len(items) > decontaminate.RANK and len(want) > 75 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_blocks_of_items_share_a_scan(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame([(i, " ".join(texts[10].split()[k : k + 40])) for i, k in enumerate((100, 900, 1700, 2500, 3300))], "item_id long, text string")
    scans = []
    scan = decontaminate._scan
    monkeypatch.setattr(decontaminate, "_scan", lambda *a: scans.append(1) or scan(*a))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()} == {(10, i) for i in range(5)}
    assert len(scans) == 1


LONG = "A long sentence of the text, with commas, goes on and on, and says what there is to say about it. " * 6


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<h1>T</h1><div>{LONG}</div><div>short end</div>", ["T", LONG, "short end"]),
        (f"<div><p>The lead, short.</p></div><div><p>{LONG}</p><p>{LONG}</p></div>", ["The lead, short.", LONG, LONG]),
        (f"<h2>Head</h2><div><p>{LONG}</p></div>", ["Head", LONG]),
        (f"<div><p>{LONG}</p><p>{LONG}</p><ul><li>one</li><li>two</li><li>three</li></ul></div>", [LONG, LONG, "one", "two", "three"]),
        (f"<div><ul><li>first</li><li>second</li></ul><p>{LONG}</p></div>", ["first", "second", LONG]),
        (f"<div class=menu>Home</div><div><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul></div><div><div><p>{LONG}</p><p>{LONG}</p></div></div>", [LONG, LONG]),
    ],
)
def test_html_without_article(body, want):
    got = html_extract.main_text(f"<html><body>{body}</body></html>").split("\n\n")
    assert [t for t in got if t not in "xyz"] == [t.strip() for t in want]


def test_html_names_lower_a_path_and_do_not_ban_it():
    text = lambda body: html_extract.main_text(f"<body>{body}</body>").split("\n\n")
    want = [LONG.strip()] * 2
    assert text(f'<article><p>{LONG}</p><div class="post share"><p>{LONG}</p></div><div class="share"><a>Mail</a> <a>Print</a></div></article>') == want
    assert text(f'<div class="with sidebar"><div><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>Short, by the side.</p></div></div>') == want
    assert text(f'<article><p>{LONG}</p><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></article>') == want
    assert text(f"<article><p>{LONG}</p><p>ok</p><ul><li><a>one</a></li></ul></article>") == [LONG.strip(), "ok", "one"]


def test_html_ratios_decide(monkeypatch):
    """Plain divs: an advert of few words stays out by its path's ratio alone, and comes in when ratios are all the same."""
    page = f"<body><ul><li><a>Home</a></li><li><a>Shop</a></li></ul><div>Buy now</div><div><p>{LONG}</p><p>And so on, it says.</p></div><div><span>Terms of use</span></div></body>"
    assert html_extract.main_text(page) == f"{LONG.strip()}\n\nAnd so on, it says."
    monkeypatch.setattr(html_extract, "fused_ratios", lambda page: np.ones(len(page.blocks)))
    assert "Buy now" in html_extract.main_text(page)


def test_html_scores_against_another_form():
    """Path scores of a well-formed page, counted with the library's parser and dictionaries."""
    from html.parser import HTMLParser

    page = f"<html><body><div><h2>A head</h2><p>{LONG}</p><p>Short, this.</p><ul><li><a>x y</a></li><li>plain; text</li></ul></div><div><p>Other. Words!</p></div></body></html>"
    blocks, stack = [], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append(tag)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            blocks.append(("/".join(t for t in stack if t != "a"), " ".join(data.split()), "a" in stack))

    Reader().feed(page)
    by = collections.defaultdict(list)
    for path, text, _ in blocks:
        by[path].append(text)
    mean = {p: (sum(map(len, t)) / len(t), (sum(x.count(c) for x in t for c in ".,;:!?") + 0.5) / len(t)) for p, t in by.items()}
    row = [mean[p] for p, _, _ in blocks]
    near = lambda k, i: (row[max(0, k - 1)][i] + 6 * row[k][i] + row[min(len(row) - 1, k + 1)][i]) / 8
    fused = [(near(k, 0) * near(k, 1)) ** 0.5 for k in range(len(row))]
    score = {p: np.mean([f for f, b in zip(fused, blocks) if b[0] == p]) for p in by}
    links = {p: sum(len(b[1]) for b in blocks if b[0] == p and b[2]) / sum(len(b[1]) for b in blocks if b[0] == p) for p in by}
    got = html_extract.path_scores(html_extract.Page(page))
    assert got[0] == pytest.approx([score[p] for p, _, _ in blocks]) and got[1] == pytest.approx([links[p] for p, _, _ in blocks])
    assert got[2] == pytest.approx(html_extract.THRESHOLD * sum(f * len(b[1]) for f, b in zip(fused, blocks)) / sum(len(b[1]) for b in blocks))


def test_html_deep_and_long_pages():
    assert html_extract.main_text("<body>" + "<div>" * 10_000 + "some text, here." + "</div>" * 10_000) == "some text, here."
    deep = html_extract.main_text("<body>" + "".join(f"<div><b><p>text {i}, here.</li>" for i in range(10_000)))
    assert deep.split("\n\n") == [f"text {i}, here." for i in range(10_000)]
    long = "<p>Some <i>words</i> of it, &amp; more.</p>" * 240_000
    assert len(long) > 10_000_000 and html_extract.main_text(f"<div>{long}</div>") == "\n\n".join(["Some words of it, & more."] * 240_000)


def test_empty_tables(spark, docs):
    none = docs.where(F.lit(False))
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int, quality int"), spark.createDataFrame([(1, "some item text of six words")], "item_id long, text string")
    for df in (substring_dedup.dedup_word_windows(none), suffix_dedup.dedup_byte_strings(none), jaccard_join.near_duplicate_components(none), mixing.mix_sources(none), fingerprints.fingerprint_documents(none), toxicity.score_toxicity(none, labels), quality.score_quality(none, labels), decontaminate.contaminated_pairs(none, bench)):
        assert df.count() == 0


def test_repeated_rows(docs):
    twice = docs.union(docs)
    for f in (substring_dedup.dedup_word_windows, suffix_dedup.dedup_byte_strings, jaccard_join.near_duplicate_components, mixing.mix_sources, fingerprints.fingerprint_documents):
        assert f(twice).count() == 2 * docs.count()


@pytest.mark.parametrize("pairs", [3, 24, 25, 60])
def test_nested_articles_count_once(pairs):
    """However many articles there are: those within others don't count beside these."""
    small = "<article><article><p>" + "x" * (6000 // pairs) + "</p></article></article>"
    page = html_extract.Page("<body><article><p>" + "y" * 10_000 + "</p></article>" + small * pairs + "</body>")
    chars = np.array([len(b[2]) for b in page.blocks], dtype=float)
    nodes, marked = html_extract.content_nodes(page, chars)
    assert marked and [len(b[2]) for b, k in zip(page.blocks, html_extract._down(page, nodes)[[b[1] for b in page.blocks]]) if k] == [10_000]
