"""Sources as relations against the row-wise repair, interval counts against all pairs, and texts that no parser takes."""

import collections
import pathlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.operators import intervals, prune, repair, syntax
from siftline.plans import code as code_queries
from siftline.sources import requests

HERE = pathlib.Path(__file__).resolve().parent.parent / "siftline"
TRICKY = '''import os, sys as system
from a.b import c, d as e
import x.y

LIMIT: int = 3
first, second = 1, 2
@outer(
    1)
class Box(Base,
          Other):
    """Two
    lines."""
    size = LIMIT
    width: int = (
        4)
    pass

    def __init__(self):
        self.x = system
    @wrap
    async def grow(self):
        async with self:
            return Box

    class Inner:
        def deep(self): return helper()

def helper(a,
           b):
    try:
        go(a,
           b)
    except* (A,
             B):
        pass
    except* C: pass
    else :
        x = y
    finally:
        done()
    match a:
        case 1:
            e()
    for i in range(
            LIMIT):
        while i: i -= 1
    else:
        c()

def helper():
    return Box
'''
DEEP = ["-" * 200_000 + "1", "a" + ".b" * 200_000, "(" * 5_000 + ")" * 5_000, "x = " + "1 + " * 100_000 + "1", "import x\n" + "-" * 200_000 + "1"]


def sources_of():
    files = [HERE / p for p in ("streaming/leases.py", "operators/repair.py", "operators/gates.py", "functions/status.py", "sources/requests.py")]
    texts = [f.read_text() for f in files] + [TRICKY, TRICKY.replace("except* ", "except "), "x = 1", ""]
    for i in range(8):
        rng = random.Random(i)
        texts.append("\n".join("\n".join(rng.choice(code_queries.UNITS)).replace("{a}", rng.choice("pqrs")).replace("{b}", rng.choice("pqrs")) for _ in range(9)))
    return texts


def test_closure_is_the_repair(spark):
    """Random masks: the same lines with the same reasons as the rules give one source at a time."""
    rng = random.Random(24)
    texts = [t for t in sources_of() for _ in range(3)]
    masks = [sorted(rng.sample(range(1, len(t.splitlines()) + 2), min(len(t.splitlines()) + 1, rng.randint(0, 5)))) for t in texts]
    sources = spark.createDataFrame([*enumerate(texts), (900, None), (901, "def (")], "source long, code string")
    asked = spark.createDataFrame([(i, n) for i, m in enumerate(masks) for n in m] + [(900, 1), (901, 1), (901, 7), (902, 1)], "source long, n long")
    got = collections.defaultdict(dict)
    for r in syntax.closure(sources, asked).collect():
        got[r["source"]][r["n"]] = r["reasons"]
    for i, (text, mask) in enumerate(zip(texts, masks)):
        want = repair.repair(text, mask)["reasons"]
        assert got[i] == want, (i, mask)
    assert 900 not in got and got[901] == {1: ["semantic"]} and 902 not in got
    assert any("referenced_top_level:Box:method" in reasons for lines in got.values() for reasons in lines.values())


def test_nodes(spark):
    rows = spark.createDataFrame([(1, TRICKY), (2, None), (3, ""), (4, "def ("), (5, "\x00"), *[(10 + i, t) for i, t in enumerate(DEEP)]], "source long, code string")
    got = collections.defaultdict(list)
    for r in syntax.python_nodes(rows).collect():
        got[r["source"]].append(r)
    assert set(got) <= {1, *range(10, 10 + len(DEEP))}
    kinds = {(r["part"], r["kind"], r["name"], r["first"], r["line"], r["head"], r["last"]) for r in got[1]}
    assert {("statement", "ClassDef", "Box", 7, 9, 10, 26), ("except", "TryStar", None, 33, 33, 34, 35), ("else", "TryStar", None, 37, 37, 37, 37), ("finally", "TryStar", None, 39, 39, 39, 39), ("statement", "Match", None, 41, 41, None, 43)} <= kinds
    assert len([r for r in got[1] if r["part"] == "statement"]) == len(repair.nodes(TRICKY))


def test_no_text_ends_the_job(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*DEEP, None, "", "import os\nprint(os)\n" * 30])], "id long, text string")
    got = {r["id"]: r for r in prune.prune_kernel(rows, "what does print do", threshold=0.9, repaired=True).collect()}
    assert len(got) == len(DEEP) + 3 and got[len(DEEP)]["reason"] == "no-scored-chunks"
    assert [repair.repair(t, [1])["status"] for t in (None, "def (", DEEP[0])] == ["input-parse-failed"] * 3
    assert rows.select(F.count_if(repair.parses_udf("text"))).first()[0] >= 1 and rows.select(repair.nodes_udf("text").alias("n")).where(F.size("n") > 0).count() >= 1
    nulls = spark.createDataFrame([(None, None), (None, [1]), ("x = 1", None), ("x = 1", [1, None])], "code string, kept array<int>")
    assert [r["s"] for r in nulls.select(repair.repair_udf("code", "kept").alias("r")).select(F.col("r.status").alias("s")).collect()] == ["input-parse-failed"] * 2 + ["ok"] * 2


def test_bad_and_deep_json(spark):
    deep = "[" * 20_000 + "]" * 20_000
    rows = spark.createDataFrame([("{\"b\": 1, \"a\": [{}]}",), ("{bad",), (None,), ("",), (deep,), ("NaN",), ("1",)], "v string")
    assert [r[0] for r in rows.select(requests.stable_json(F.col("v"))).collect()] == ['{"a":[{}],"b":1}', None, None, None, None, "NaN", "1"]


@pytest.mark.parametrize("lines,kept,want", [
    (["a = 1", "b = 2", "c = 3"], {1, 3}, "a = 1\n[pruned]\nc = 3".replace("[pruned]", "b = 2")),  # a gap shorter than its marker stays
    (["a = 1", "bbbbbbbbb = 2", "c = 3"], {1, 3}, "a = 1\n[pruned]\nc = 3"),
    (["def f():", "    bbbbbbbbbbb = 2", "    c = 3", "d = 4"], {1, 4}, "def f():\n    [pruned]\nd = 4"),  # inside the block that was opened
    (["if x:  # note", "    bbbbbbbbbbb = 2", "else:", "    cccccccccc = 2"], {1, 3}, "if x:  # note\n    [pruned]\nelse:\n    [pruned]"),
    (["    a", "    bbbbbbbbbbbb", "except E:"], {1, 3}, "    a\n    [pruned]\nexcept E:"),  # not indented as what goes on with a statement
    (["aaaaaaaaaaaaa", "", "    b"], {2, 3}, "    [pruned]\n\n    b"),  # indented as the next line that isn't blank
    (["a", "bbbbbbbbbbbbbbbbb", "ccccccccccc"], {1}, "a\n[pruned]"),
    (["  a", "bb"], {1}, "  a\nbb"),
    (["aaaaaaaaaaaaaaa"], set(), "[pruned]"),
])
def test_rendering(lines, kept, want):
    assert repair.render(lines, kept) == want


bounds = st.integers(-40, 40)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), bounds, bounds), max_size=12), st.lists(st.tuples(st.integers(0, 2), bounds), max_size=25))
def test_interval_counts(spark, spans, points):
    spans, points = [(k, i, a, b) for i, (k, a, b) in enumerate(spans)], [*points, (None, 1), (1, None)]
    a = spark.createDataFrame([*spans, (1, 100, None, 3), (1, 101, 0, 1 << 40), (None, 102, 0, 9)], "k long, id long, first long, last long")
    b = spark.createDataFrame(points, "k long, n long")
    want = {(k, i, c) for k, i, lo, hi in [*spans, (1, 101, 0, 1 << 40)] if (c := sum(1 for q, n in points if q == k and n is not None and lo <= n <= hi))}
    assert {tuple(r) for r in intervals.interval_counts(a, b, ["k"], ["id"]).collect()} == want
    assert {tuple(r) for r in intervals.intervals_hit(a, b, ["k"], ["id"], levels=50).collect()} == {x[:2] for x in want}


def test_few_bins_cover_an_interval(spark):
    rows = spark.createDataFrame([(1, 1_000_000), (0, (1 << 20) - 1), (5, 5), (-7, 9)], "lo long, hi long")
    for r in rows.select("lo", "hi", intervals.cover(F.col("lo"), F.col("hi"), 21).alias("c")).collect():
        parts = sorted((x["bin"] << x["level"], (x["bin"] + 1) << x["level"]) for x in r["c"])
        assert parts[0][0] == r["lo"] and parts[-1][1] == r["hi"] + 1 and all(p[1] == q[0] for p, q in zip(parts, parts[1:])) and len(parts) <= 2 * 21


def test_closure_sends_no_table_to_the_driver(spark):
    """Work tables' files are small beside their rows, so the plan must not go by their size."""
    sources = spark.createDataFrame([(k, "import os\ndef f(x):\n    return os.sep\ny = f(1)\n") for k in range(20)], "source long, code string")
    found = syntax.closure(sources, spark.createDataFrame([(k, 4) for k in range(20)], "source long, n int"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["source"], r["n"]) for r in found.collect()} >= {(k, n) for k in range(20) for n in (2, 4)}
