"""Frames: splits, bounds, streams, and a sink that commits or leaves nothing."""

import io
import json
import os
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from siftline.sources import frames


@pytest.fixture(autouse=True)
def source(spark):
    spark.dataSource.register(frames.FrameSource)


def test_every_line_in_one_stretch():
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice("ab\n\né") for _ in range(rng.randrange(40))).encode()
        want, at = [], 0
        for line in data.split(b"\n"):
            if at < len(data):
                want.append((at, line if len(line) <= 5 else None))
            at += len(line) + 1
        size = rng.randrange(1, 12)
        got = [x for k in range(0, len(data), size) for x in frames.frames(io.BytesIO(data), k, min(k + size, len(data)), 5)]
        assert got == want, (data, size)


def test_a_frame_beyond_the_bound(spark, tmp_path):
    """17 MiB without a line end: an error row, the lines around it unharmed, and never more than the bound in memory."""
    with open(tmp_path / "a.ndjson", "wb") as f:
        f.write(b'{"id": 1, "op": "status"}\n')
        for _ in range(17):
            f.write(b"x" * (1 << 20))
        f.write(b'\n{"id": 2, "op": "dance"}\n\n{"id": 3, "op": "exit"}')
    read = spark.read.format("frames").load(str(tmp_path))
    assert [(r["id"], r["ok"], r["error"]) for r in frames.requests_of(read).orderBy("pos").collect()] == [(1, True, None), (None, False, "frame too large"), (2, False, "unknown op: dance"), (3, True, None)]

    class Endless:
        def __init__(self, blocks):
            self.left = blocks

        def seek(self, at):
            pass

        def read(self, n):
            self.left -= 1
            return b"x" * n if self.left >= 0 else b""

    tracemalloc.start()
    assert list(frames.frames(Endless(400), 0, 1 << 40, 16 << 20)) == [(0, None)]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}é\n") for i in range(100)], "b long, a string").repartition(3)
    path = f"file://{tmp_path}/out"
    rows.write.format("frames").mode("append").save(path)
    rows.limit(1).write.format("frames").mode("append").save(path)
    got = [json.loads(r["frame"]) for r in spark.read.format("frames").option("splitBytes", 100).load(path).collect()]
    assert len(got) == 101 and {x["b"] for x in got} == set(range(100)) and all(list(x) == ["a", "b"] for x in got)
    rows.where("b < 5").write.format("frames").mode("overwrite").save(path)
    assert spark.read.format("frames").load(path).count() == 5
    broken = rows.withColumn("c", F.when(F.col("b") == 60, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception):
        broken.write.format("frames").mode("append").save(path)
    assert spark.read.format("frames").load(path).count() == 5 and not [f for f in os.listdir(tmp_path / "out") if f.startswith("_pending")]
    assert spark.read.format("frames").load(f"{tmp_path}/none").count() == 0


def test_streamed_once(spark, tmp_path):
    """New files are new batches; a batch that is run again adds nothing."""
    def run():
        rows = spark.readStream.format("frames").load(f"{tmp_path}/in").select("frame")
        query = rows.writeStream.format("frames").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    os.makedirs(tmp_path / "in")
    for k in range(2):
        (tmp_path / f"in/{k}.txt").write_text(f"a{k}\nb{k}\n")
        run()
    read = lambda: sorted(r["frame"] for r in spark.read.format("frames").load(f"{tmp_path}/out").collect())
    assert read() == ["a0", "a1", "b0", "b1"]
    commits = sorted((f for f in os.listdir(tmp_path / "state/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(tmp_path / "state/commits" / f):
            os.remove(tmp_path / "state/commits" / f)
    run()
    assert read() == ["a0", "a1", "b0", "b1"]
