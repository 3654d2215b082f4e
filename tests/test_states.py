"""Backends' states against a plain fold, and objects of JSON values against a plain walk."""

import json
import random

from pyspark.sql import functions as F

from siftline.operators import backend
from siftline.sources import variants


def test_each_transition():
    """What the requests lead to, by state; a child that doesn't run is only ever cold or failed."""
    lead = lambda e, alive=True: [backend.after(e, s, alive)[0] for s in backend.STATES]
    assert lead("load-resident") == ["resident"] * 4 and lead("ok-untold") == ["loading", "loading", "resident", "loading"]
    assert lead("refused") == lead("transport-failed") == ["failed"] * 4 and lead("stopped") == ["cold"] * 4
    assert lead("unload-cold") == ["cold"] * 4 and lead("unload-refused") == ["cold", "failed", "failed", "failed"] and lead("unload-refused", False) == ["cold"] * 4
    assert lead("child-exited") == ["failed"] * 4 and lead("child-exited", False) == list(backend.STATES) and lead("memory-refused", False) == ["failed"] * 4


def test_fold_in_any_stretches(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([*backend.EVENTS, "something else", None])) for i in range(400)]
    for width in (1, 7, 1000):
        df = spark.createDataFrame([(k, i // width, i, e) for k, i, e in rows], "k string, stretch long, i long, event string").repartition(5)
        want, at = {}, {}
        for k, i, e in rows:
            state, alive, n = at.get(k, ("cold", False, 0))
            at[k] = (*(backend.after(e, state, alive) if e in backend.EVENTS else (state, alive)), n + 1)
            want[k, i // width] = at[k][:2]
        got = backend.fold(df, ["k"], "stretch", ["i"]).collect()
        assert {(r["k"], r["stretch"]): (r["state"], r["alive"]) for r in got} == want and sum(r["events"] for r in got) == len(rows)


def walk(x):
    if isinstance(x, dict):
        yield x
        for k in sorted(x):
            yield from walk(x[k])
    elif isinstance(x, list):
        for y in x:
            yield from walk(y)


def test_objects_of_values(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.4:
            return {k: value(depth - 1) for k in rng.sample("zyxabc", rng.randrange(4))}
        return [value(depth - 1) for _ in range(rng.randrange(4))] if depth and kind < 0.8 else rng.choice([1, "s", None, True])

    texts = [json.dumps(value(5)) for _ in range(60)]
    bad = [None, "", "{", "nul", "[1", '{"a": }']
    deep = '{"a":' * 10_000 + "1" + "}" * 10_000
    rows = spark.createDataFrame([*enumerate(texts + bad + [deep, '{"a":' * 90 + "1" + "}" * 90])], "id long, value string")
    got = {}
    for r in variants.objects(rows, "id").select("id", "pos", F.to_json("object").alias("o")).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(json.loads(r["o"]))
    n = len(texts) + len(bad)
    assert {i: got.get(i, []) for i in range(n)} == {i: list(walk(json.loads(t))) for i, t in enumerate(texts)} | {len(texts) + k: [] for k in range(len(bad))}
    assert n not in got and len(got[n + 1]) == 90
    assert variants.objects(rows.where("id = 60"), "id").count() == 0 and variants.objects(rows.limit(0), "id").count() == 0
