"""Tag decoding in lockstep and in blocks against the plain loop and all sequences."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from siftline.operators import decode, repair


def fields(seed, n, tags, most):
    rng = random.Random(seed)
    score = lambda *shape: np.array([rng.randint(-6, 6) / 4 for _ in range(int(np.prod(shape)))]).reshape(shape)
    return [(score(rng.randint(0, most), tags), score(tags, tags), score(tags), score(tags)) for _ in range(n)]


def test_lockstep_is_the_loop():
    for tags in (1, 2, 3, 5):
        rows = fields(tags, 60, tags, 40)
        got = decode.viterbi_batch(*([r[k] for r in rows] for k in range(4)))
        assert [g.tolist() for g in got] == [repair.viterbi(*r) for r in rows]


def test_three_tags_against_all_sequences():
    for e, t, a, z in fields(9, 25, 3, 5):
        value = lambda y: a[y[0]] + z[y[-1]] + sum(e[i][k] for i, k in enumerate(y)) + sum(t[i][k] for i, k in zip(y, y[1:]))  # noqa: B023, E731
        found = decode.viterbi_batch([e], [t], [a], [z])[0].tolist()
        assert len(found) == len(e) and (not found or value(found) == max(map(value, itertools.product(range(3), repeat=len(e)))))


def test_products_in_any_grouping():
    e, t, a, z = fields(3, 1, 4, 0)[0]
    e = np.array([[random.Random(i * 4 + j).randint(-8, 8) / 4 for j in range(4)] for i in range(37)])
    step = lambda p, q: (p[:, :, None] + q[None]).max(1)
    for k in (1, 9, 30):
        assert (step(decode.product(e[:k], t), decode.product(e[k:], t)) == decode.product(e, t)).all()


def test_blocks_of_one_long_sequence(spark):
    rng = random.Random(7)
    e = [[rng.randint(-6, 6) / 4 for _ in range(3)] for _ in range(3000)]
    t, a, z = [[0.5, -0.25, 0], [0, 0.25, -1], [-0.5, 0, 0.75]], [0, 0.5, 1], [1, 0, 0.25]
    rows = [("long", i // 37, e[i : i + 37]) for i in range(0, 3000, 37)] + [("one", 0, [[0.0, 1.0, 0.5]]), ("two", 5, e[:2]), ("two", 7, e[2:3]), (None, 0, e[:1])]
    blocks = spark.createDataFrame([(k, i, x) for k, i, x in rows], "k string, block long, emissions array<array<double>>").repartition(8)
    got = decode.decode_blocks(blocks, t, a, z, ["k"]).collect()
    of = lambda k: [x for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["block"]) for x in r["tags"]]
    assert of("long") == repair.viterbi(e, t, a, z) and of("one") == repair.viterbi([[0.0, 1.0, 0.5]], t, a, z) and of("two") == repair.viterbi(e[:3], t, a, z)


def test_nulls_and_other_sizes(spark):
    rows = [(1, None, [[0.0]], [0.0]), (2, [], [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]), (3, [[1.0, 2.0, 0.0]], [[0.0] * 3] * 3, [0.0] * 3), (4, [[1.0, 0.5]] * 5, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]), (5, [[1.0]], [[0.0]], None)]
    df = spark.createDataFrame(rows, "id long, e array<array<double>>, t array<array<double>>, a array<double>")
    got = {r["id"]: r["y"] for r in df.select("id", decode.viterbi_udf("e", F.col("t"), F.col("a"), F.col("a")).alias("y")).collect()}
    assert got == {1: None, 2: [], 3: [1], 4: [0] * 5, 5: None}


def test_blocks_over_batches(spark):
    """Sequences go on from batch to batch, and none is brought into a group of its own."""
    rng, rows, want = random.Random(3), [], {}
    t, a, z = [[0.5, -0.25], [0, 0.25]], [0, 0.5], [1, 0]
    for k in range(60):
        e = [[rng.randint(-6, 6) / 4 for _ in range(2)] for _ in range(rng.randint(1, 90))]
        want[k] = repair.viterbi(e, t, a, z)
        cut = [0, *sorted(rng.sample(range(1, len(e)), min(len(e) - 1, rng.randint(0, 20)))), len(e)]
        rows += [(k, i, e[lo:hi]) for i, (lo, hi) in enumerate(itertools.pairwise(cut))]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "7")
    try:
        found = decode.decode_blocks(spark.createDataFrame(rows, "k long, block long, emissions array<array<double>>").repartition(5), t, a, z, ["k"])
        got = found.collect()
    finally:
        spark.conf.unset(setting)
    assert {k: [x for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["block"]) for x in r["tags"]] for k in want} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
