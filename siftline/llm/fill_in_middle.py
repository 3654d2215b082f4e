"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, written with marks in one of two orders, and restored.

Units are relations: a text's matches are exploded with their positions, a window sums their lengths, the two cut requests of each text meet the
units by ordinal, and the offsets found are aggregated per text, where substring makes the parts. The texts are dealt out once, by a number of the row, and
every step reads that one exchange, so a hot doc_id or a group of copies is spread like any other rows. The number follows from where a row stands in the scan, which a task that is
run again reads alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import shuffle_parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Blocks end after other than a letter, so no unit is cut; an array of units has no more than a block's.
BLOCK = "(?s).{0,65535}[^A-Za-z]|[A-Za-z]+"
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Exchange partitions for each of the session's: a text's units take some thirty times its bytes while they are sorted, which is to fit in memory.
PARTS = 4


def draws(doc_id: Column) -> Column:
    """Four unsigned 32-bit integers from the hex SHA-256 of `1:` and the decimal id (null: `1:` alone)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def unit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("long")


def form(text: Column, drawn: Column) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when((text == "") | marked | (drawn[2] % 100 >= 100 - PLAIN_SHARE), "plain").when(drawn[3] % 100 < SPM_SHARE, "spm").otherwise("psm")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. No part holds a mark, and none can arise where parts meet, so splitting at the marks gives the parts."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and restored of every row.

    The form and the cuts follow from doc_id and the text's units alone, so equal rows have equal results and reruns agree. Null or empty text: no units, plain,
    empty output. Texts that hold a mark are plain. Null doc_id: draws of its own. Repeated rows are each returned; other columns, whatever their names, are left out. Lengths are
    in code points, null where plain. No rows: none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartition(PARTS * shuffle_parts(docs.sparkSession), "_row")
    drawn = draws(F.col("doc_id"))
    told = rows.withColumn("n", unit_count(F.col("text"))).withColumn("form", form(F.col("text"), drawn))
    first, second = drawn[0] % (F.col("n") + 1), drawn[1] % (F.col("n") + 1)
    cut = F.col("form") != "plain"

    blocks = told.select("_row", F.posexplode_outer(F.regexp_extract_all(F.when(cut, F.col("text")), F.lit(BLOCK), F.lit(0))).alias("b", "block"))
    units = blocks.select("_row", "b", F.posexplode_outer(F.regexp_extract_all("block", F.lit(UNIT), F.lit(0))).alias("u", "unit")).where("unit IS NOT NULL")
    running = Window.partitionBy("_row").orderBy("b", "u").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select("_row", "b", "u", F.length("unit").alias("chars")).select("_row", F.count("*").over(running).alias("ordinal"), F.sum("chars").over(running).alias("end"))

    requests = told.select(F.col("_row").alias("_asked"), F.when(cut, F.least(first, second)).alias("low"), F.when(cut, F.greatest(first, second)).alias("high"))
    # one equality, on what both sides are dealt by; the ordinals are compared within it
    met = ends.join(requests.hint("shuffle_hash"), (F.col("_row") == F.col("_asked")) & ((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high"))))
    offsets = met.groupBy(F.col("_row").alias("_cut")).agg(*(F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))).alias(f"{c}_end") for c in ("low", "high")))

    out = told.join(offsets.hint("shuffle_hash"), F.col("_row") == F.col("_cut"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    low, high = zero("low_end"), zero("high_end")
    parts = out.withColumn("_p", F.substring("text", F.lit(1), low)).withColumn("_m", F.substring("text", low + 1, high - low)).withColumn("_s", F.substring("text", high + 1, F.length("text")))
    psm = F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m")
    spm = F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    made = parts.select("doc_id", "n", "form", F.when(cut, low.cast("long")).alias("prefix_chars"), F.when(cut, (high - low).cast("long")).alias("middle_chars"), output.alias("output"))
    return made.withColumn("restored", restored(F.col("output"), F.col("form")))


ORACLE_SQL = f"""
WITH D AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
U AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS u, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM D),
F AS (SELECT *, len(u) AS n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM U),
K AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS hi FROM F),
P AS (SELECT doc_id, text, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM K)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM P
"""
