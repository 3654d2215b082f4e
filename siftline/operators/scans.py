"""Scans in order of a key's rows, of a whole table too, without one task for a hot key: blocks are scanned apart, and what a block takes over comes from the blocks' summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.work import written

#: Rows that a block is to have on average.
BLOCK_ROWS = 50_000


def in_blocks(rows: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with _block: the number of the stretch of `order` (a number or time) that a row is in, ascending; a null order is in the first, and stands first. One pass finds the ends and the number of rows."""
    at = F.col(order).cast("double")
    n, low, high = rows.agg(F.count("*"), F.min(at), F.max(at)).first()
    width = (high - low) / max(1, n // block_rows) if n and low is not None and high > low else 1.0
    return rows.withColumn("_block", F.coalesce(F.floor((at - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1)).cast("long"))


def _before(rows: DataFrame, keys: list[str], summary: list[Column], carry) -> DataFrame:
    """What each block of a key takes over: carry(window) over the summaries of the key's blocks before it; a row a block."""
    blocks = rows.groupBy(*keys, "_block").agg(*summary)
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), *carry(w))


def _meet(rows: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(before[f"_k{i}"])
    return rows.join(before, same, "left")


def carry_last(rows: DataFrame, keys: list[str], order: list[str], values: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with each of values replaced by the last that isn't null up to the row, by key, in order (the first of order cuts the blocks)."""
    placed = in_blocks(rows, order[0], block_rows)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_s{i}") for i, v in enumerate(values)]
    before = _before(placed, keys, last, lambda w: [F.last(f"_s{i}", ignorenulls=True).over(w).alias(f"_p{i}") for i in range(len(values))])
    own = placed.select(*rows.columns, "_block", *(F.last(v, ignorenulls=True).over(within).alias(f"_o{i}") for i, v in enumerate(values)))
    out = {v: F.coalesce(f"_o{i}", f"_p{i}") for i, v in enumerate(values)}
    return _meet(own, before, keys).select(*(out[c].alias(c) if c in out else c for c in rows.columns))


def carry_sum(rows: DataFrame, keys: list[str], order: list[str], values: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with each of values replaced by its sum up to the row, by key, in order."""
    placed = in_blocks(rows, order[0], block_rows)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _before(placed, keys, [F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)], lambda w: [F.sum(f"_s{i}").over(w).alias(f"_p{i}") for i in range(len(values))])
    own = placed.select(*rows.columns, "_block", *(F.sum(v).over(within).alias(f"_o{i}") for i, v in enumerate(values)))
    total = {v: F.coalesce(F.col(f"_o{i}") + F.col(f"_p{i}"), f"_o{i}", f"_p{i}") for i, v in enumerate(values)}
    return _meet(own, before, keys).select(*(total[c].alias(c) if c in total else c for c in rows.columns))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows, in a work table, with _rank: their place (from 0) in the order of the whole table. Sorted by ranges; a range's first place comes from the counts of those before, a row a range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(np.arange(seen, seen + n))], [*batch.schema.names, "_part", "_nth"])
            seen += n

    kept = written(dealt.mapInArrow(number, StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_nth", LongType())])))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = kept.groupBy("_part").agg(F.count("*").alias("c")).select("_part", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("_begin"))
    return kept.join(F.broadcast(begins), "_part").withColumn("_rank", F.col("_begin") + F.col("_nth")).drop("_part", "_nth", "_begin")


def bucket_table(rows: DataFrame, length: str, ids: list[str], most: int, ratio: float) -> DataFrame:
    """rows with bucket: those of a whole table, in order of (length, ids), in buckets of at most `most` rows whose longest is at most `ratio` times the shortest, each begun only where the one before is full.

    Where a bucket that began at a row would end is known for every row alone: the first place behind it of a longer length than allowed, or `most` places on. From the first row the
    bucket starts are found by pointer jumping: those reached so far and what they reach with pointers that double each round, so rounds are the logarithm of the number of buckets.
    """
    placed = written(ranked(rows, length, *ids))
    # the place behind the last row of each length; there are no more lengths than a text has characters
    ends = placed.groupBy(F.col(length).alias("_len")).agg((F.max("_rank") + 1).alias("_end"))
    limits = placed.select(length).distinct().select(F.col(length).alias("_of"), F.floor(F.col(length) * F.lit(ratio)).alias("_limit"))
    # the last length within the limit of each: both lie in one order, so it is a running maximum
    both = limits.select(F.col("_limit").alias("_v"), F.lit(1).alias("_side"), "_of", F.lit(None).cast("long").alias("_end")).unionByName(ends.select(F.col("_len").cast("long").alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(limits.schema["_of"].dataType).alias("_of"), "_end"))
    found = carry_last(both.withColumn("_all", F.lit(0)), ["_all"], ["_v", "_side"], ["_end"]).where("_side = 1").select("_of", "_end")
    jumps = placed.join(found, placed[length] == found["_of"]).select(F.col("_rank").alias("at"), F.least("_end", F.col("_rank") + most).alias("to"))
    jumps, reached = written(jumps), written(placed.where("_rank = 0").select(F.col("_rank").alias("at")))
    while True:
        fresh = reached.join(jumps, "at").select(F.col("to").alias("at")).join(placed.select(F.col("_rank").alias("at")), "at", "left_semi").join(reached, "at", "left_anti")
        fresh = written(fresh)
        if fresh.isEmpty():
            break
        reached = written(reached.union(fresh))
        second = jumps.select(F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(second, "to", "left").select("at", F.coalesce("then", "to").alias("to")))
    starts = placed.select(*rows.columns, "_rank").join(reached.select(F.col("at").alias("_rank"), F.lit(1).alias("bucket")), "_rank", "left").fillna(0, ["bucket"]).withColumn("_all", F.lit(0))
    return carry_sum(starts, ["_all"], ["_rank"], ["bucket"]).withColumn("bucket", F.col("bucket") - 1).select(*rows.columns, "bucket")
