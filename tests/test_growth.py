"""What must not grow with the input: files of case files, and how often intervals are made."""

import os

from pyspark.sql import functions as F

from siftline.operators import intervals, syntax
from siftline.plans import catalog
from siftline.streaming import replay


def test_case_files_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "folder", lambda spark: str(tmp_path))
    rows = [(k, t, "user", f"text {k} and {t}, long enough") for k in range(200) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/sf/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["chars"] for r in catalog.QUERIES["case_files"](spark, f"{tmp_path}/sf").collect()}
    assert got == {(k, t): len(x) for k, t, _, x in rows}
    (cases,) = [f for f in os.listdir(tmp_path) if f.startswith("cases-")]
    whole = [f for d, _, names in os.walk(f"{tmp_path}/{cases}/whole") for f in names if f.endswith(".txt")]
    assert len(whole) == 4


def test_intervals_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def end(x):
        made.add(1)
        return x + 3

    rows = spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("first"), F.udf(end, "long").asNondeterministic()("id").alias("last"))
    points = spark.range(0, 20, 2).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    got = {(r["first"], r["last"]): r["points"] for r in intervals.interval_counts(rows, points, ["k"], ["first", "last"]).collect()}
    assert got == {(i, i + 3): 2 for i in range(10)} and made.value == 10


def test_closure_has_no_rounds(spark, monkeypatch):
    """A chain of 30 references, and batches that cut a source's rows: one work table, whatever the chain's length."""
    tables = []
    monkeypatch.setattr(syntax, "written", lambda df, f=syntax.written: tables.append(df) or f(df))
    code = "".join(f"v{i} = v{i + 1}\n" for i in range(30))
    sources = spark.createDataFrame([(k, code) for k in range(3)], "source long, code string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = syntax.closure(sources, spark.createDataFrame([(k, 1) for k in range(2)], "source long, n int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["source"], r["n"]) for r in rows} == {(k, n) for k in range(2) for n in range(1, 31)} and len(tables) == 1
