"""Golden values of the operators, and queries against their SQL twins."""

import ast
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.functions import numbers as N
from siftline.functions import text as T
from siftline.operators import chunks, evaluate, prune, repair
from siftline.plans import catalog
from siftline.streaming import sessions as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "\n\n", "a\r\nb\x0bc\x0cd\x1ce\x85f g", "a\n\nb"])
def test_lines(spark, text):
    assert value(spark, T.lines(F.col("t")), t=text) == text.splitlines()


def test_envelope(spark):
    for body, env in (("out", "\n\n[Showing lines 1-2 of 9]"), ("[x] mid\nout", "\nCommand exited with code 1"), ("plain", "")):
        assert value(spark, T.envelope(F.col("t")), t=body + env) == env
        assert value(spark, T.payload(F.col("t")), t=body + env) == body


def test_query_tokens(spark):
    got = value(spark, T.query_tokens(F.col("q")), q="Where does the load_config_x fail, and WHAT retries?")
    assert set(got) == {"load_config_x", "load", "config", "fail", "retries"}


def test_render_plain(spark):
    render = lambda text, kept: value(spark, prune.render_plain(T.lines(F.col("t")), F.transform(T.lines(F.col("t")), lambda _, i: F.array_contains(F.lit(kept), i + 1))), t=text)
    assert render("keep\n" + "x" * 12 + "\n" + "y" * 12 + "\nkeep again", [1, 4]) == "keep\n(filtered 2 lines)\nkeep again"
    assert render("keep\nx\ny\nkeep again\n", [1, 4]) == "keep\nx\ny\nkeep again"
    assert render("keep\n\n", [1]) == "keep\n(filtered 1 lines)"


def test_bridge_does_not_cascade(spark):
    mask = F.lit([True, False, True, False, False, True])
    assert spark.range(1).select(prune.bridge_gaps(mask)).first()[0] == [True, True, True, False, False, True]


def test_windows_and_batches(spark):
    t = T.let(chunks.char_tokens(F.col("t")), lambda x: F.transform(chunks.token_windows(x, 4, 1), lambda w: F.concat_ws("-", F.element_at(w["tokens"], 1)["start"].cast("string"), F.element_at(w["tokens"], -1)["end"].cast("string"))))
    assert value(spark, t, t="abcdefghij") == ["0-4", "3-7", "6-10"]
    row = spark.range(1)
    assert row.select(chunks.bucket_lengths(F.lit([100, 120, 2000]), 4, 1.5)).first()[0] == [[100, 120], [2000]]
    assert row.select(chunks.split_by_budget(F.lit([100, 120, 140]), 300)).first()[0] == [[100, 120], [140]]
    assert row.select(chunks.split_by_budget(F.lit([500, 700]), 300)).first()[0] == [[500], [700]]


def test_window_length(spark):
    length = lambda tokens, explicit: value(spark, N.window_length(F.col("n"), F.lit(50), F.lit(explicit).cast("int"), True), n=tokens)
    assert [length(1200, None), length(2600, None), length(2600, 1536)] == [2048, 1024, 1536]


def test_repair_keeps_sources_parsing():
    code = open(streams.__file__).read()  # without "#" in strings, which the search for block openers takes for comments; the parse check reports what that breaks
    lines = code.splitlines()
    rng = random.Random(24)
    for _ in range(60):
        got = repair.repair(code, sorted(rng.sample(range(1, len(lines) + 1), rng.randint(1, 12))))
        assert got["status"] == "ok" and ast.parse(got["code"]) is not None
    assert repair.repair("def f(:", [1])["status"] == "input-parse-failed"


def test_viterbi():
    assert repair.viterbi([[0, 1], [3, 0], [0, 1]], [[1, -1], [-1, 1]], [0, 0], [0, 0]) == [0, 0, 0]
    assert repair.viterbi([[1, 1]], [[0, 0], [0, 0]], [0, 0], [0, 0]) == [0]


def test_retries():
    def score(batch):
        if len(batch) > 1:
            raise MemoryError
        return [len(batch[0])]

    assert list(repair.with_retries([["a", "bb"], ["ccc"]], score, lambda e: isinstance(e, MemoryError))) == [(1, True), (2, True), (3, False)]


def test_focus_hits(spark, tmp_path):
    docs = [(1, "The Alpha_beta works\nnothing\nbetamax again\nalpha alpha"), (2, "gamma\r\nALPHABET soup\x0bKEEP_THIS_LINE"), (3, ""), (4, None), (5, "that with which")]
    items = [(1, "Where is alpha_beta, and what is soup?"), (2, "what is that"), (3, "gamma then GAMMA"), (4, None), (None, "betamax")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["hits"], r["docs"]) for r in catalog.prune_by_benchmark_query(spark, str(tmp_path)).collect()}
    assert got == {1: (5, 2), 2: (1, 1), 3: (2, 1), 4: (1, 1), None: (2, 2)}


def test_focus_hits_by_the_mask(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 1"), spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id % 8 = 3")
    kept = F.size(prune.kept_numbers(prune.lexical_mask(F.col("x"), F.col("tokens"))))
    pairs = docs.select(T.lines(F.col("text")).alias("x")).crossJoin(items.select("item_id", T.query_tokens(F.col("text")).alias("tokens"))).select("item_id", kept.alias("n"))
    want = {tuple(r) for r in pairs.groupBy("item_id").agg(F.sum("n"), F.count_if(F.col("n") > 0)).collect()}
    assert {tuple(r) for r in evaluate.focus_hits(docs, items).collect()} == want and sum(r[1] for r in want) > 0


def test_focus_hits_in_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {tuple(r) for r in evaluate.focus_hits(docs, items).collect()}
    monkeypatch.setattr(evaluate, "MOST_ITEMS", 15)
    assert {tuple(r) for r in evaluate.focus_hits(docs, items).collect()} == whole and len(whole) == items.select("item_id").distinct().count()


def test_identifier_refs(spark, tmp_path):
    spark.createDataFrame([(1, "def f(x): return x + load_config(y1)"), (2, "f ab"), (3, "12 + 3")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "f and load_config"), (2, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in catalog.identifier_refs(spark, str(tmp_path)).collect()} == {(1, 6, 3), (2, 2, 1)}


def test_span_filters(spark, tmp_path):
    texts = {1: "one\n\nthree\nfour\n", 2: "", 3: "\n\n", 4: "x"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalog.span_filters(spark, str(tmp_path)).collect()} == {(i, n, len(x)) for i, t in texts.items() for n, x in enumerate(t.split("\n"), 1) if x}


def test_spans_past_the_ends(spark):
    spans = [(0, 4, 10), (-1, 4, 10), (6, 11, 10), (6, 10, 10), (4, 4, 10), (5, 2, 10), (-3, 0, 10), (10, 12, 10), (-2, 12, 10), (0, 1, 0)]
    df = spark.createDataFrame(spans, "start int, end int, length int")
    assert [tuple(r) for r in chunks.valid_spans(df).collect()] == [s for s in spans if 0 <= s[0] < s[1] <= s[2]]
    assert [tuple(r)[:2] for r in chunks.clamp_spans(df).collect()] == [(0, 4), (0, 4), (6, 10), (6, 10), (0, 10)]


def test_viterbi_decodes_every_line(spark, tmp_path):
    spark.createDataFrame([(1, "\n" * 1_000_003)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.viterbi_decode(spark, str(tmp_path)).first()["tags"] == 1_000_003


def test_line_spans(spark):
    text = "a b\r\n\nlonger line\x0bc\rd\u2028e\n"
    want, at = [], 0
    for line in text.splitlines(keepends=True):
        want.append((at, at + len(line.rstrip("\r\n"))))
        at += len(line)
    assert [tuple(s) for s in value(spark, chunks.line_spans(F.col("t")), t=text)] == want


def test_roll_up_by_characters():
    """Means by overlap, against a count of characters; spans over several lines and nested ones too."""
    rng = random.Random(5)
    for _ in range(50):
        begin, stop, at = [], [], 0
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(0, 6)
            begin.append(at)
            stop.append(at + n)
            at += n + 1
        spans = [(a, a + rng.randint(1, 9), rng.random()) for a in rng.sample(range(max(1, at)), min(at, rng.randint(1, 6)))]
        mean, met = chunks.roll_up(*(np.array(x) for x in (begin, stop)), *(np.array(x) for x in zip(*spans)))
        for k, (lo, hi) in enumerate(zip(begin, stop)):
            hits = [s for a, b, s in spans for c in range(a, b) if lo <= c < hi]
            assert met[k] == bool(hits) and (not hits or mean[k] == pytest.approx(sum(hits) / len(hits)))


def test_kernel_repairs_and_floors(spark):
    code = "import os\n\n\ndef first(a):\n    answer = 1\n    return os.path.join(answer)\n\n\ndef second(b):\n    try:\n        return answer(b)\n    except ValueError:\n        return None\n" + "".join(f"x{i} = {i}\n" for i in range(60))
    rows = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "the answer\n" + "noise\n" * 9)], "id long, text string")
    got = {r["id"]: r for r in prune.prune_kernel(rows, "what is the answer", threshold=0.3, repaired=True).collect()}
    assert got[1]["repair"] == "ok" and got[1]["decision"] == "pruned" and ast.parse(got[1]["pruned"]) and "import os" in got[1]["pruned"] and "except ValueError:" in got[1]["pruned"]
    assert [got[i]["reason"] for i in (2, 3, 4)] == ["no-scored-chunks", "no-scored-chunks", "model"] and got[4]["pruned"] == "the answer\n(filtered 9 lines)"
    bare = prune.prune_kernel(rows.where("id = 1"), "nothing matches zzzz", threshold=0.9, repaired=True).first()
    assert bare["floor"] == "floor-python-skeleton" and (bare["decision"], bare["reason"]) == ("pruned", "model") and "def second(b):" in bare["pruned"]
    everything = prune.prune_kernel(rows.where("id = 4"), "x", scorer="constant").first()
    assert everything["decision"] == "pruned" and everything["pruned"] == rows.where("id = 4").first()["text"].rstrip("\n")


def test_repair_reasons():
    code = "import os\nimport re as r\n\n@wrap\nclass Box:\n    size = 1\n\n    def __init__(self):\n        self.x = 0\n\n    def grow(self):\n        try:\n            go(\n                1,\n                os)\n        except E:\n            pass\n        else:\n            end()\n        finally:\n            done()\n"
    got = repair.repair(code, [14])
    want = {
        1: ["referenced_import"], 4: ["enclosing_class"], 5: ["enclosing_class"], 6: ["enclosing_class:field"], 11: ["enclosing_definition"], 12: ["enclosing_control_flow"],
        13: ["statement_integrity"], 14: ["semantic", "statement_integrity"], 15: ["statement_integrity"], 16: ["enclosing_try:except"], 18: ["enclosing_try:else"], 20: ["enclosing_try:finally"],
    }
    assert all({*want[n]} <= {*got["reasons"][n]} for n in want) and got["parses"] and 2 not in got["reasons"]
    assert "referenced_top_level:Box:method" in got["reasons"][17]  # the class is named among the kept lines, so methods with kept lines are whole
    assert "referenced_top_level:Box:method" in repair.repair(code + "\nBox()\n", [23])["reasons"][8]
    assert ("Try", None) in {n[2:] for n in repair.nodes(code)} and (4, 21, "ClassDef", "Box") in repair.nodes(code) and repair.nodes("def") == []


def test_viterbi_against_all_sequences():
    rng = random.Random(8)
    for n in range(1, 7):
        e, t, a, z = ([[rng.randint(-3, 3) for _ in range(2)] for _ in range(k)] for k in (n, 2, 1, 1))
        value_of = lambda y: a[0][y[0]] + z[0][y[-1]] + sum(e[i][k] for i, k in enumerate(y)) + sum(t[i][k] for i, k in zip(y, y[1:]))  # noqa: B023, E731
        found = repair.viterbi(e, t, a[0], z[0])
        assert value_of(found) == max(map(value_of, itertools.product((0, 1), repeat=n)))


def test_viterbi_decode_query(spark):
    rows = {r["doc_id"]: (r["tags"], r["ones"]) for r in catalog.viterbi_decode(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        best = [(0.0, 0), (0.0, 0)]  # of a sequence that ends in 0 or 1: its score and number of ones
        for k, line in enumerate(doc["text"].splitlines()):
            e = 1.0, len(line) % 7 / 3.0
            step = lambda y: max((best[x][0] + (0 if k == 0 else 0.5 if x == y else -0.5), -x) for x in (0, 1))  # noqa: B023, E731
            best = [(step(y)[0] + e[y], best[-step(y)[1]][1] * (k > 0) + y) for y in (0, 1)]
        assert rows[doc["doc_id"]] == (len(doc["text"].splitlines()), best[int(best[1][0] > best[0][0])][1])


def test_batch_retry_query(spark):
    assert {tuple(r) for r in catalog.batch_retry(spark, SF).collect()} == {(r["doc_id"], len(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def score(batch):
        if len(batch) > 1 or batch[0] == "bad":
            raise MemoryError("oom")
        return batch

    from siftline.operators import scorers

    def padded(texts):
        if len(texts) > 1 and len(texts) * max(map(len, texts)) > 20:
            raise MemoryError("too large")
        return [len(t) for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id long, text string").coalesce(1)
    got = {r["id"]: (r["n"], r["retried"]) for r in scorers.score_batches(rows, "text", padded, "n int", 3, (MemoryError,)).collect()}
    assert got == {i: (i, i >= 6) for i in range(10) if i < 9} | {9: (9, False)}
    with pytest.raises(Exception, match="ValueError"):
        scorers.score_batches(rows, "text", lambda texts: 1 / 0 if not texts else [int(t) for t in texts], "n int", 3, (MemoryError,)).collect()

    with pytest.raises(repair.BatchFailed) as failed:
        list(repair.with_retries([["a", "bad", "c"]], score, lambda e: isinstance(e, MemoryError)))
    assert (failed.value.size, failed.value.done) == (3, 1)


def test_settings_and_lines(spark):
    from siftline.functions import status as S
    from siftline.operators import gates
    from siftline.sources import requests

    assert [value(spark, N.dollars(F.col("x")), x=x) for x in (0.0, 0.0042, 1.5, 12.345)] == ["$0.00", "$0.004", "$1.50", "$12.35"]
    assert value(spark, S.cost_line(F.lit("p"), F.lit(0.001), F.lit(0.02), F.lit(1), F.lit(80)), x=1) == "p · ~$0.001-0.02 input cost avoided · 1 prune"
    assert value(spark, S.token_line(F.lit("p"), F.lit(1500), F.lit(2), F.lit(80)), x=1) == "p · ~1.5k input tokens avoided · 2 prunes"
    assert value(spark, S.compact_line(F.lit("p"), F.lit(12), F.lit(2), F.lit(80)), x=1) == "p · 12c · 2p" and value(spark, S.failure_text(F.lit("x")), x=1).startswith("pruning failed: x")
    with pytest.raises(Exception, match="not a positive integer"):
        value(spark, N.positive_int(F.col("x")), x="0")
    asks = lambda free, weights, least: value(spark, N.memory_allows(F.lit(free), F.lit(weights), F.lit(least).cast("int")), x=1)
    assert [asks(1000, 100, 0), asks(2047, 100, None), asks(2048, 100, None), asks(3000, 2500, None), asks(500, 100, 400)] == [True, False, True, False, True]
    gated = spark.createDataFrame([("prune",), ("small",)], "gate string")
    assert [d.count() for d in gates.split_by_gate(gated)] == [1, 1]
    assert value(spark, requests.stable_json(F.col("x")), x='{"b": [{"z": 1, "a": null}], "a": "é"}') == '{"a":"é","b":[{"a":null,"z":1}]}'


def test_case_and_trace_files(spark, tmp_path):
    from siftline.sources import requests

    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text('{"trajectories": [{"n": 1}, {"n": 2}]}')
    (tmp_path / "a/two.json").write_text(' [{"n": 3}]\n')
    (tmp_path / "a/three.json").write_text('{"n": 4, "text": "alone"}')
    (tmp_path / "a/four.json").write_text("no json")
    got = sorted(int(r["v"]) for r in requests.read_records(spark, f"{tmp_path}/a/*.json").select(F.get_json_object("value", "$.n").alias("v")).collect())
    assert got == [1, 2, 3, 4] and requests.read_whole_texts(spark, f"{tmp_path}/a/two.json").first()[0] == ' [{"n": 3}]\n'
    (tmp_path / "t.jsonl").write_text('{"id": "x", "prune": {"details": {"decision": "pruned", "originalChars": 9, "prunedChars": 4}}}\n')
    assert requests.read_traces(spark, f"{tmp_path}/t.jsonl").select("prune.details.originalChars").first()[0] == 9


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(df: pd.DataFrame) -> list:
    text = lambda v: "" if pd.isna(v) else format(float(v), ".9g") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
