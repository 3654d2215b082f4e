"""Queries by scans in blocks: tag sequences, and buckets over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, scans
from .catalog import VITERBI, query, table, text_lines, texts


@query(VITERBI.format(e="length(line) % 7 / 4.0::DOUBLE") + "SELECT doc_id, string_agg(tag, '' ORDER BY n) AS tags FROM B GROUP BY doc_id")
def viterbi_blocks(spark, sf_dir):
    # blocks of four lines, so that most documents have several
    steps = F.transform(text_lines(), lambda x: F.array(F.lit(1.0), F.length(x) % 7 / 4.0))
    rows = texts(spark, sf_dir).select("doc_id", steps.alias("e"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("e") - 1) / 4).cast("int")), lambda k: F.struct(k.alias("block"), F.slice("e", k * 4 + 1, 4).alias("emissions")))
    found = decode.decode_blocks(rows.select("doc_id", F.inline(cut)), [[0.5, -0.5], [-0.5, 0.5]], [0.0, 0.0], [0.0, 0.0], ["doc_id"])
    return found.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "tags"))), lambda x: x["tags"])), "").alias("tags"))


@query("""WITH RECURSIVE X AS (SELECT conv_id, turn, CAST(length(text) + 1 AS BIGINT) AS n, row_number() OVER (ORDER BY length(text) + 1, conv_id, turn) AS i FROM conversations),
R AS (
  SELECT conv_id, turn, i, n, CAST(0 AS BIGINT) AS bucket, 1 AS members, n AS head FROM X WHERE i = 1
  UNION ALL
  SELECT X.conv_id, X.turn, X.i, X.n, CASE WHEN members >= 4 OR X.n > head * 1.5 THEN bucket + 1 ELSE bucket END, CASE WHEN members >= 4 OR X.n > head * 1.5 THEN 1 ELSE members + 1 END, CASE WHEN members >= 4 OR X.n > head * 1.5 THEN X.n ELSE head END
  FROM R JOIN X ON X.i = R.i + 1)
SELECT conv_id, turn, n, bucket FROM R""")
def table_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") + 1).cast("long").alias("n"))
    return scans.bucket_table(rows, "n", ["conv_id", "turn"], 4, 1.5)
