"""Blocked scans and buckets over a table against plain loops; hot keys over several tasks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import scans, sessions


def make_rows(n=3000):
    rng = random.Random(4)
    keys = ["hot"] * 18 + ["a", None]
    return [(rng.choice(keys), rng.choice([None, *range(60)]) if i % 50 == 0 else i * 3 % 4001, i, rng.choice([None, None, i % 7]), i % 5) for i in range(n)]


SCHEMA = "k string, t int, id int, price int, size int"


def by_loop(rows):
    last, total, out = {}, {}, []
    for k, t, i, price, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        if price is not None:
            last[k] = price
        total[k] = total.get(k, 0) + size
        out.append((k, t, i, last.get(k), total[k]))
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize("block_rows", [1, 100, 10_000])
def test_carries(spark, block_rows):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    last = {r["id"]: (r["k"], r["t"], r["price"]) for r in scans.carry_last(df, ["k"], ["t", "id"], ["price"], block_rows).collect()}
    sums = {r["id"]: r["size"] for r in scans.carry_sum(df, ["k"], ["t", "id"], ["size"], block_rows).collect()}
    assert [(*last[i][:2], i, last[i][2], sums[i]) for i in sorted(last)] == by_loop(rows)


def test_a_hot_key_is_scanned_by_several_tasks(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    assert df.where("k = 'hot'").count() > 2500
    placed = scans.in_blocks(df, "t", 100)
    dealt = placed.repartition(8, "k", "_block").where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 1500
    plan = scans.carry_sum(df, ["k"], ["t", "id"], ["size"], 100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "_block#" in plan.split("hashpartitioning(k#")[1][:60]


def test_as_of_with_a_hot_session(spark):
    rng = random.Random(2)
    base = datetime.datetime(2024, 1, 1)
    calls = [("hot" if rng.random() < 0.9 else "b", base + datetime.timedelta(seconds=rng.randrange(4000)), i) for i in range(1500)]
    prices = [(rng.choice(["hot", "b", "c"]), base + datetime.timedelta(seconds=s), float(s)) for s in range(0, 4000, 37)]
    got = sessions.as_of(spark.createDataFrame(calls, "k string, ts timestamp, id int"), spark.createDataFrame(prices, "k string, ts timestamp, price double"), "k", "ts", "price", block_rows=50)
    want = {i: max(((s, p) for q, s, p in prices if q == k and s <= ts), default=(None, None))[1] for k, ts, i in calls}
    assert {r["id"]: r["price"] for r in got.collect()} == want


def test_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(20), i) for i in range(500)]
    got = scans.ranked(spark.createDataFrame(rows, "n int, id int").repartition(5), "n", "id").collect()
    assert [(r["n"], r["id"]) for r in sorted(got, key=lambda r: r["_rank"])] == sorted(rows) and sorted(r["_rank"] for r in got) == list(range(500))


@pytest.mark.parametrize("lengths,most,ratio", [([100, 120, 2000], 4, 1.5), ([7] * 40, 4, 1.0), (list(range(1, 90)), 1000, 1.25), ([5], 3, 2.0), ([], 3, 2.0), ([random.Random(3).randrange(1, 60) for _ in range(150)], 6, 1.3)])
def test_buckets_of_a_table(spark, lengths, most, ratio):
    rows = [(n, i) for i, n in enumerate(lengths)]
    want, done = {}, []
    for n, i in sorted(rows):
        if not done or len(done[-1]) >= most or n > done[-1][0] * ratio:
            done.append([])
        done[-1].append(n)
        want[i] = len(done) - 1
    got = scans.bucket_table(spark.createDataFrame(rows, "n long, id long"), "n", ["id"], most, ratio).collect()
    assert {r["id"]: r["bucket"] for r in got} == want


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scans.carry_last(empty, ["k"], ["t", "id"], ["price"]).count() == 0 and scans.carry_sum(empty, ["k"], ["t", "id"], ["size"]).count() == 0
