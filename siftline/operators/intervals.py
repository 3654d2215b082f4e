"""Points in intervals without their pairs: intervals are covered by few bins of doubling widths, points are counted by bin, and both meet by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written


def cover(low: Column, high: Column, levels: int) -> Column:
    """The bins (level, bin) that cover [low, high] and nothing else, each number once: at most two a level. A bin of level k holds the 2^k numbers whose k-th shift it is."""

    def at(k: Column) -> Column:
        shift = lambda x: F.call_function("shiftright", x, k)
        first, after = -shift(-low), shift(high + 1)  # what is left to cover after the finer levels, in bins of this one
        bin_of = lambda x: F.struct(k.alias("level"), x.alias("bin"))
        return F.array(F.when((first < after) & (first % 2 != 0), bin_of(first)), F.when((first < after) & (after % 2 != 0), bin_of(after - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def interval_counts(intervals: DataFrame, points: DataFrame, keys: list[str], ids: list[str], low: str = "first", high: str = "last", at: str = "n", levels: int | None = None) -> DataFrame:
    """keys, ids and `points`: how many of the points (keys, at) each interval [low, high] (named by keys and ids) holds, 0 left out.

    Bounds and points are whole numbers. Points are summed by bin before they meet, so an interval meets a number of rows of the order of the logarithm of its length, however many points it
    holds. Intervals that are empty or have a null bound hold none, null points and keys meet nothing. levels: of the longest interval, found by a pass over them if not given; for that they
    are made once, into a work table.
    """
    rows = intervals.select(*keys, *ids, F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high")).where("_low <= _high")
    if levels is None:
        rows = written(rows)
        longest = rows.agg(F.max(F.col("_high") - F.col("_low"))).first()[0]
        levels = (longest or 0).bit_length()
    bins = points.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("long").alias("_at")).agg(F.count("*").alias("_n"))
    bins = bins.select(*keys, "_n", F.col("_at"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("bin", F.expr("shiftright(_at, level)"))
    bins = bins.groupBy(*keys, "level", "bin").agg(F.sum("_n").alias("_n"))
    covered = rows.select(*keys, *ids, F.inline(cover(F.col("_low"), F.col("_high"), levels)))
    return covered.join(bins.hint("merge"), [*keys, "level", "bin"]).groupBy(*keys, *ids).agg(F.sum("_n").alias("points"))


def intervals_hit(intervals: DataFrame, points: DataFrame, keys: list[str], ids: list[str], **names) -> DataFrame:
    """keys and ids of the intervals that hold a point."""
    return interval_counts(intervals, points, keys, ids, **names).select(*keys, *ids)
