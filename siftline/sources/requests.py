"""Sources: request lines, case files, whole texts; and the sinks' row forms."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.gates import MAX_FRAME_BYTES

REQUEST = "id bigint, op string, text string, query string, _corrupt string"
# Names of the fields that hold a question and a text, first ones first, and of those that hold lists of records.
QUERY_KEYS = ("query", "goal_hint", "goal", "hint", "context_focus_question", "question")
TEXT_KEYS = ("code", "text", "observation", "output", "tool_output", "content", "stdout")
RECORD_KEYS = ("cases", "records", "trajectories", "data")


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of JSON files (lines: of JSON lines) as (path, pos, value): those of a list, of the first list below one of RECORD_KEYS, else the object itself. Blank lines and
    what is no JSON give none. A file of lines is read in splits; other files are read whole, as a JSON document must be."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = lambda v: F.when(F.ltrim(v).startswith("["), v)
    listed = F.col("value") if lines else F.coalesce(kind(F.col("value")), *[kind(F.get_json_object("value", f"$.{k}")) for k in RECORD_KEYS])
    records = F.lit(None).cast("array<string>") if lines else F.from_json(listed, "array<string>")
    one = F.when(F.get_json_object("value", "$").isNotNull() & F.ltrim("value").startswith("{"), F.array("value"))
    return raw.select("path", F.posexplode(F.coalesce(records, one)).alias("pos", "value"))


def read_traces(spark: SparkSession, path: str, field: str = "prune") -> DataFrame:
    """Session traces (JSON lines) with the fields that reports need; field: the one with the prune's details and the session's counters."""
    details = "details:struct<decision:string,reason:string,originalChars:bigint,prunedChars:bigint>"
    counters = "counters:struct<calls:bigint,originalChars:bigint,prunedChars:bigint,savedChars:bigint>"
    return spark.read.schema(f"id string, kind string, backend string, `{field}` struct<{details},{counters}>").json(path)


def stream_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request lines of files as they come: parse_requests of a stream."""
    return parse_requests(spark.readStream.text(folder))


def write_responses(replies: DataFrame, folder: str, checkpoint: str):
    """Starts writing a stream of replies as compact JSON lines, each once; what is there is taken, then it stops."""
    lines = replies.select(F.to_json(F.struct(*[F.col(c) for c in replies.columns])).alias("value"))
    return lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def string_list(value: Column) -> Column:
    """The strings of a JSON list; of anything else, none."""
    items = F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<variant>")
    strings = F.filter(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))), lambda s: s.isNotNull())
    return F.coalesce(strings, F.array().cast("array<string>"))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def parse_requests(lines: DataFrame, value: str = "value") -> DataFrame:
    """Request lines to id, op, text, query, ok, error. Blank lines go; a bad line is a row with an error, and the rest goes on."""
    rows = lines.where(~F.col(value).rlike(r"(?U)^\s*$")).withColumn("_r", F.from_json(value, REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    r = F.col("_r")
    known = r["op"].isin("load", "prune", "unload", "exit", "status")
    error = (
        F.when(F.octet_length(value) > MAX_FRAME_BYTES, "frame too large")
        .when(r["_corrupt"].isNotNull() | ~F.ltrim(value).startswith("{"), "invalid request")
        .when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown op: "), F.coalesce(r["op"], F.lit(""))))
        .when((r["op"] == "prune") & r["text"].isNull(), "text must be a string")
        .when((r["op"] == "prune") & (r["query"].isNull() | r["query"].rlike(r"(?U)^\s*$")), "query must not be blank")
    )
    return rows.select(*[c for c in lines.columns if c != value], r["id"].alias("id"), r["op"].alias("op"), r["text"].alias("text"), r["query"].alias("query"), error.isNull().alias("ok"), error.alias("error"))


def first_field(value: Column, keys: tuple[str, ...]) -> Column:
    """The first of several JSON fields that isn't blank."""
    got = [F.get_json_object(value, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(~g.rlike(r"(?U)^\s*$"), g) for g in got])


def cases(records: DataFrame, value: str = "value") -> DataFrame:
    """JSON objects to cases: query and text by their usual names; texts under 20 or queries under 8 characters go."""
    out = records.select(*[c for c in records.columns if c != value], F.coalesce(F.get_json_object(value, "$.id"), F.get_json_object(value, "$.case_id")).alias("case_id"), first_field(F.col(value), QUERY_KEYS).alias("query"), first_field(F.col(value), TEXT_KEYS).alias("text"))
    return out.where((F.length("text") >= 20) & (F.length("query") >= 8))


@udtf(returnType="pos int, object string")
class WalkObjects:
    """Every object within a JSON value, outermost first, with its position."""

    def eval(self, value: str) -> Iterator[tuple[int, str]]:
        def walk(x):
            if isinstance(x, dict):
                yield x
                x = list(x.values())
            if isinstance(x, list):
                for y in x:
                    yield from walk(y)

        try:
            found = walk(json.loads(value))
        except ValueError:
            return
        for i, x in enumerate(found):
            yield i, json.dumps(x, sort_keys=True, ensure_ascii=False)


def _stable(values):
    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return values.map(one)


def stable_json(value: Column) -> Column:
    """A JSON text with the keys of all its objects in order, compact; null for what is no JSON, or nested too deep to be read."""
    return F.pandas_udf(_stable, "string")(value)


def sorted_json(**columns: Column) -> Column:
    """A JSON object with its keys in order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns.items())]), {"ignoreNullFields": "false"})


def tail_cases(items: DataFrame, key: str, answer: str, count: int, at: int) -> DataFrame:
    """A synthetic case of count lines (key, n, line) for each item: definitions that have nothing to do with it, and its answer (null: an empty line) as line `at`, near the end."""
    n = F.col("n")
    noise = F.when(n % 3 == 1, F.format_string("def unrelated_%d(value):", n)).when(n % 3 == 2, F.format_string("    return value + %d", n)).otherwise("")
    rows = items.select(key, F.coalesce(answer, F.lit("")).alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("n"))
    return rows.select(key, n.cast("long").alias("n"), F.when(n == at, F.col("_a")).otherwise(noise).alias("line"))
