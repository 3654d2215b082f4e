"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target number of words by water-filling; a document's expected copies are its source's target over its source's
size. Within a source, documents are put in order of size, their expected copies are summed up, one offset per source is
added, and a document is emitted once for each integer between its sum and the one before. In that order every stretch of
sizes gets its share, so the words taken come near the target.

The prefix sums need no source in one task: expected copies are the same throughout a source, so a document's sum follows from its rank, and
the rank from counts of (source, size class) and (source, size class, slot) plus the row's number in that block. A slot is a
hash of doc_id, so a source that holds a third of all rows, or a third of all rows being copies, is dealt over SLOTS blocks a size class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import work_table

SLOTS = 256
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
_WORDS = r"[^\x20\x09-\x0D]+"


def count_words(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORDS)), F.lit(0)).cast("long")


def fair_targets(sizes: DataFrame) -> DataFrame:
    """sizes (no_source, name, source_size): adds target. Sources by name, null last, weigh 5, 2, 1, repeating.

    One row a source: the windows without partition order the sources alone. A source is full if its limit is no more than the level at
    which the rest, by weight, and the full ones' limits add up to all words; limits over weights in order make these a prefix.
    """
    every = Window.orderBy("no_source", "name")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(MOST_COPIES)).withColumn("height", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("height", "no_source", "name").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("height", "no_source", "name").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") < F.col("height"), F.col("level"))).over(whole))
    # that of the first source that isn't full is the largest of those below their heights; none: all are full, which takes a total of 0
    return rows.withColumn("target", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (size times copies); all columns of docs stay (text as it was; clashing names are replaced).

    Size: number of maximal runs other than ASCII white space (null: 0). Target: 5, 2, 1 parts for sources by code point, null last, of all sizes,
    at most 3 times the source's size, the excess shared out again by weight. No document has over 3 copies. The same rows give the
    same copies on every run: offsets and slots are hashes. Rows of one doc_id are separate documents; rows equal in doc_id and text are
    ties, of which any may have the copy. No rows: no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    key = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    rows = (
        docs.withColumn("size", count_words(text))
        .withColumn("no_source", F.col(source).isNull())
        .withColumn("name", F.coalesce(F.col(source).cast("string"), F.lit("")))
        # neither is ever null; coalesce says so to the optimizer, which else counts words again in filters on the join's keys
        .withColumn("class", F.coalesce(F.when(F.col("size") > 0, F.length(F.bin(F.col("size"))) * 32 + F.floor(F.col("size") * 32 / F.pow(F.lit(2.0), F.length(F.bin(F.col("size"))) - 1)).cast("int")), F.lit(0)))
        .withColumn("slot", F.coalesce((key(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))) % SLOTS).cast("int"), F.lit(0)))
    )
    of = ["no_source", "name"]
    # counts alone, written so that the texts are read once for them and once for the ranks
    blocks = work_table(rows.groupBy(*of, "class", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = blocks.groupBy(*of, "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = fair_targets(classes.groupBy(*of).agg(F.sum("words").alias("source_size")))
    classes = classes.withColumn("class_from", before(Window.partitionBy(*of).orderBy("class"))).drop("n", "words").join(targets, of)
    blocks = blocks.withColumn("slot_from", before(Window.partitionBy(*of, "class").orderBy("slot"))).drop("n", "words").join(classes, [*of, "class"])
    place = Window.partitionBy(*of, "class", "slot").orderBy("size", F.col(doc_id).asc_nulls_first(), F.xxhash64(F.col(text)))
    ranked = rows.withColumn("rank", F.row_number().over(place)).join(blocks.select(*of, "class", "slot", "class_from", "slot_from", "source_size", "target"), [*of, "class", "slot"])
    rank = F.col("rank") + F.col("class_from") + F.col("slot_from")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = key(F.concat(F.lit(f"{seed}/"), F.col("name"))) / F.lit(float(1 << 24))
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    out = ranked.withColumn("copies", F.least(crossed, F.lit(MOST_COPIES)).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.select(*columns, F.explode(F.expr("if(copies > 0, sequence(1L, copies), array())")).alias("_copy")).drop("_copy")


#: DuckDB twin of mix_sources with seed 17. It states the rule directly: one ranking per source, no blocks.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source IS NULL AS no_source, coalesce(source, '') AS name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
dealt AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 32 + CAST(floor(size * 32 / pow(2.0, length(bin(size)) - 1)) AS INT) END AS class,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6) AS BIGINT) % 256 AS slot
  FROM sized),
sizes AS (SELECT no_source, name, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY no_source, encode(name)) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS lim FROM sizes),
heights AS (SELECT *, lim / weight AS height FROM weighed),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER (ORDER BY height, no_source, encode(name) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY height, no_source, encode(name) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM heights),
targets AS (
  SELECT *, coalesce(least(lim, max(CASE WHEN lvl < height THEN lvl END) OVER () * weight), lim) AS target FROM levels),
ranked AS (
  SELECT d.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.no_source, d.name ORDER BY class, slot, size, d.doc_id NULLS FIRST) AS r,
         CAST('0x' || substr(md5('17/' || d.name), 1, 6) AS BIGINT) / 16777216.0::DOUBLE AS o,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate
  FROM dealt d JOIN targets t ON d.no_source = t.no_source AND d.name = t.name)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(rate * r + o) - floor(rate * (r - 1) + o), 3) AS BIGINT) AS taken
FROM ranked
"""
