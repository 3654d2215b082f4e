"""JSON values as VARIANT rows, unfolded level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as _Window
from pyspark.sql import functions as F

from .work import written


def objects(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, pos, depth and object (VARIANT): every object within a row's JSON text, outermost first, in the order of a walk that enters a value before it goes on (an object's fields by name).

    Null, what is no JSON, and what is nested deeper than the parser goes (1,000 levels) have none. Each level is a table of what can still be entered, so a row is never walked in one call.
    """
    level = rows.select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("path"), F.try_parse_json(value).alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level, levels = written(level.where(inner)), []
    spark = rows.sparkSession
    while not level.isEmpty():
        levels.append(level.where(kind.startswith("OBJECT")).select("_key", "path", F.size("path").alias("depth"), F.col("v").alias("object")))
        below = spark.sql("SELECT l._key, concat(l.path, array(x.pos)) AS path, x.value AS v FROM {level} l, LATERAL variant_explode(l.v) x", level=level)
        level = written(below.where(inner))
    if not levels:
        return rows.limit(0).select(key, F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"), F.try_parse_json(value).alias("object"))
    # a path stands before all that begin with it, so paths in order are the walk
    numbered = F.row_number().over(_Window.partitionBy("_key").orderBy("path")) - 1
    return reduce(DataFrame.unionByName, levels).select(F.col("_key").alias(key), numbered.cast("long").alias("pos"), "depth", "object")
