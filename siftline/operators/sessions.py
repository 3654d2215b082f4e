"""Sessions: counters, running counters, costs at the price in force, leases, originals. Batch forms; see streaming for their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from . import scans
from .gates import original_fits


def prune_sizes(calls: DataFrame, before: Column, after: Column) -> DataFrame:
    out = calls.withColumn("before", before.cast("long")).withColumn("after", after.cast("long"))
    return out.withColumn("before_tokens", N.token_estimate(F.col("before"))).withColumn("after_tokens", N.token_estimate(F.col("after")))


def session_counters(calls: DataFrame, session: str) -> DataFrame:
    """calls with before, after and their token estimates: totals a session; saved_chars may be negative, saved_tokens not."""
    sums = calls.groupBy(session).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("before", "after", "before_tokens", "after_tokens")))
    return sums.withColumn("saved_chars", F.col("before") - F.col("after")).withColumn("saved_tokens", N.saved(F.col("before_tokens"), F.col("after_tokens")))


def running_counters(calls: DataFrame, session: str, order: str, block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """Totals after each call; a session of many calls is summed in blocks."""
    rows = calls.select(session, order, F.lit(1).cast("long").alias("calls"), (F.col("before") - F.col("after")).alias("saved_chars"), (F.col("before_tokens") - F.col("after_tokens")).alias("saved_tokens"))
    return scans.carry_sum(rows, [session], [order], ["calls", "saved_chars", "saved_tokens"], block_rows).withColumn("saved_tokens", F.greatest(F.lit(0), "saved_tokens"))


def as_of(calls: DataFrame, prices: DataFrame, key: str, ts: str, *values: str, block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """calls with the latest values of prices (key, ts, values) at or before each: both in one order, in blocks of time, so neither a range join nor one task for a hot key."""
    left = calls.withColumn("_call", F.lit(True))
    right = prices.select(key, ts, *(F.col(v).alias(f"_{v}") for v in values), F.lit(False).alias("_call"))
    both = left.unionByName(right, allowMissingColumns=True)
    carried = scans.carry_last(both, [key], [ts, "_call"], [f"_{v}" for v in values], block_rows)
    return carried.where("_call").select(*calls.columns, *(F.col(f"_{v}").alias(v) for v in values))


def leases(events: DataFrame, session: str, ts: str, ttl: str) -> DataFrame:
    """Spans of activity without a pause of over ttl. A pause of exactly ttl keeps the lease."""
    return events.groupBy(session, F.session_window(ts, ttl)).agg(F.count("*").alias("beats"), F.min(ts).alias("opened"), F.max(ts).alias("last_beat")).drop("session_window")


def open_leases(spans: DataFrame, ttl_seconds: int) -> DataFrame:
    """How many leases are open after each opening and expiry: +1 and -1 in order of time. The running sum is per day, on top of the days' totals, so no task sees all."""
    moves = spans.select(F.col("opened").alias("ts"), F.lit(1).alias("step")).union(spans.select((F.col("last_beat") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("ts"), F.lit(-1).alias("step")))
    moves = moves.groupBy("ts").agg(F.sum("step").alias("step")).withColumn("day", F.to_date("ts"))
    before = moves.groupBy("day").agg(F.sum("step").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    running = moves.withColumn("run", F.sum("step").over(Window.partitionBy("day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(before, "day").select("ts", (F.col("base") + F.col("run")).alias("open"))


def last_original(calls: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """The latest text of each session if it fits the cache, else null."""
    return calls.groupBy(session).agg(F.max_by(text, order).alias("t")).select(session, F.when(original_fits(F.col("t")), F.col("t")).alias("original"))


def restored(entries: DataFrame, session: str, order: str, *fields: str) -> DataFrame:
    """Each field's last value that isn't null."""
    return entries.groupBy(session).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def unloads(spans: DataFrame, ttl_seconds: int) -> DataFrame:
    """When the last open lease ends, and so what serves them is to be unloaded: ts, each once, however leases race."""
    return open_leases(spans, ttl_seconds).where("open = 0").select("ts")
