"""Queries over the states of backends, and over JSON values unfolded as variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backend, chunks, tokens
from ..sources import frames, variants
from ..sources.work import folder
from .catalog import _SPANS, query, table, texts

_EVENT_SQL = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(backend.EVENTS)) + " ELSE 'load-resident' END"
_ALIVE_FIRST = "CASE WHEN event IN ('load-resident', 'ok-untold', 'refused') THEN true WHEN event IN ('transport-failed', 'child-exited', 'stopped') THEN false ELSE alive END"
_NEXT = """CASE event WHEN 'load-resident' THEN 'resident' WHEN 'ok-untold' THEN CASE WHEN state = 'resident' THEN 'resident' ELSE 'loading' END WHEN 'refused' THEN 'failed' WHEN 'transport-failed' THEN 'failed'
WHEN 'unload-cold' THEN 'cold' WHEN 'unload-refused' THEN CASE WHEN alive AND state <> 'cold' THEN 'failed' ELSE 'cold' END
WHEN 'child-exited' THEN CASE WHEN alive THEN 'failed' ELSE state END WHEN 'stopped' THEN 'cold' ELSE CASE WHEN alive THEN 'resident' ELSE 'failed' END END"""


@query(f"""WITH RECURSIVE X AS (SELECT user_id, CAST(ts AS DATE) AS day, {_EVENT_SQL} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
R AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS day, 'cold' AS state, false AS alive FROM (SELECT DISTINCT user_id FROM X)
  UNION ALL
  SELECT R.user_id, X.i, X.day, {_NEXT}, {_ALIVE_FIRST} FROM R JOIN X ON X.user_id = R.user_id AND X.i = R.i + 1)
SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS events, arg_max(state, i) AS state, arg_max(alive, i) AS alive FROM R WHERE i > 0 GROUP BY user_id, day""")
def backend_states(spark, sf_dir):
    k = F.col("event_id") % 11
    event = F.coalesce(*[F.when(k == i, e) for i, e in enumerate(backend.EVENTS)], F.lit("load-resident"))
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", event.alias("event"))
    return backend.fold(rows, ["user_id"], "day", ["ts", "event_id"])


@query("""WITH T AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
O AS (SELECT conv_id, i * 3 + 1 AS pos, 2 AS depth, role FROM T UNION ALL SELECT conv_id, i * 3 + 2, 3, CAST(n AS VARCHAR) FROM T UNION ALL SELECT conv_id, i * 3 + 3, 5, 'deep' || turn FROM T)
SELECT conv_id, pos, depth, role AS name FROM O UNION ALL SELECT DISTINCT conv_id, 0, 0, 'top' FROM conversations""")
def json_objects(spark, sf_dir):
    turn = F.struct(F.struct(F.length("text").cast("string").alias("name")).alias("a"), F.array(F.array(F.struct(F.concat(F.lit("deep"), "turn").alias("name")))).alias("b"), F.col("role").alias("name"), F.col("turn").alias("z"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("x"))
    value = F.to_json(F.struct(F.lit("top").alias("name"), F.transform("x", lambda y: y["t"]).alias("turns")))
    found = variants.objects(rows.select("conv_id", value.alias("value")), "conv_id")
    return found.select("conv_id", "pos", "depth", F.try_variant_get("object", "$.name", "string").alias("name"))


@query(f"""WITH C AS (SELECT doc_id, 'char' AS tokenizer, length(text) AS m, unnest(range(0, greatest(0, CAST(ceil((length(text) - 512) / 448.0) AS BIGINT)) + 1)) AS idx FROM documents),
{_SPANS}, B AS (SELECT doc_id, 'word' AS tokenizer, m, unnest(range(0, greatest(0, CAST(ceil((m - 64) / 48.0) AS BIGINT)) + 1)) AS idx FROM (SELECT DISTINCT doc_id, m FROM T2))
SELECT doc_id, tokenizer, idx AS chunk_idx, least(512, m - idx * 448) AS tokens, idx * 448 AS start, least(m, idx * 448 + 512) AS "end" FROM C
UNION ALL SELECT B.doc_id, tokenizer, idx, count(*), CAST(min(start) AS BIGINT), CAST(max(stop) AS BIGINT) FROM B JOIN T2 ON T2.doc_id = B.doc_id AND k BETWEEN idx * 48 AND idx * 48 + 63 GROUP BY ALL""")
def tokenizer_windows(spark, sf_dir):
    docs = texts(spark, sf_dir)

    def windows(name, most, overlap):
        # a text without words has no window of them, an empty one has an empty window of characters
        rows = docs.select("doc_id", F.lit(name).alias("tokenizer"), tokens.tokens("text", name).alias("t")).where((F.size("t") > 0) | F.lit(name == "char"))
        cut = chunks.explode_windows(rows, "t", most, overlap, "doc_id", "tokenizer")
        ends = (F.coalesce(F.try_element_at("tokens", F.lit(at))[end], F.lit(0)) for at, end in ((1, "start"), (-1, "end")))
        return cut.select("doc_id", "tokenizer", F.col("chunk_idx").cast("long"), F.size("tokens").cast("long").alias("tokens"), *(e.cast("long").alias(n) for e, n in zip(ends, ("start", "end"))))

    return windows("char", 512, 64).unionByName(windows("word", 64, 16))


@query("""WITH X AS (SELECT conv_id, turn, conv_id || ':' || turn || ':' || replace(text, chr(10), ' ') AS f FROM conversations)
SELECT CASE WHEN strlen(f) <= 300 THEN conv_id END AS conv_id, CASE WHEN strlen(f) > 300 THEN 'frame too large' END AS error, count(*) AS frames, CAST(coalesce(sum(CASE WHEN strlen(f) <= 300 THEN strlen(f) END), 0) AS BIGINT) AS bytes FROM X GROUP BY ALL""")
def frame_source(spark, sf_dir):
    path = folder(spark, "frames")
    spark.dataSource.register(frames.FrameSource)
    frame = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.replace("text", F.lit("\n"), F.lit(" ")))
    table(spark, sf_dir, "conversations").select(frame.alias("frame")).write.format("frames").mode("append").save(path)
    rows = spark.read.format("frames").option("maxFrameBytes", 300).option("splitBytes", 20_000).load(path)
    return rows.groupBy(F.substring_index("frame", ":", 1).cast("long").alias("conv_id"), "error").agg(F.count("*").alias("frames"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).cast("long").alias("bytes"))
