"""The pruning kernel on arrays: a text's lines stay in its row, so pruning needs no shuffle, sort or Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunks, repair, scorers

PLACEHOLDER_CHARS = len("(filtered 0 lines)")
LEAST_CONTENT = 0.05
SKELETON = ("import ", "from ", "def ", "async def ", "class ", "@")


def lexical_mask(lines: Column, tokens: Column | str) -> Column:
    """Which lines have one of the tokens, or, if tokens is a string, of those of that question."""
    if isinstance(tokens, str):
        pattern = T.focus_pattern(tokens)
        return F.transform(lines, lambda line: F.lower(line).rlike(pattern))
    return T.let(tokens, lambda known: F.transform(lines, lambda line: T.is_relevant(line, known)))


def threshold_mask(scores: Column, threshold: float = 0.5, prefix: int = 0) -> Column:
    """Line scores (null: 0) at or over the threshold, and the first `prefix` lines."""
    return F.transform(scores, lambda s, i: (F.coalesce(s, F.lit(0.0)) >= threshold) | (i < prefix))


def bridge_gaps(mask: Column) -> Column:
    """Also keeps single lines between two kept ones, by the mask as it was."""
    near = lambda m, i: F.coalesce(F.get(m, i), F.lit(False))
    return T.let(mask, lambda m: F.transform(m, lambda k, i: k | ((i > 0) & near(m, i - 1) & near(m, i + 1))))


def kept_numbers(mask: Column) -> Column:
    return F.filter(F.transform(mask, lambda k, i: F.when(k, i + 1)), lambda n: n.isNotNull())


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda s, x: s + F.when(T.is_blank(x), 0).otherwise(F.length(x)))


def _after_gaps(lines: Column, shown: Column, gap, trailing) -> Column:
    """Shown lines (numbers), each after gap(lines before it), and trailing(lines after the last)."""

    def whole(x: Column, s: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(s, k - 1))
        pieces = F.transform(s, lambda n, k: F.concat(T.let(F.slice(x, before(k) + 1, n - before(k) - 1), gap), F.array(F.get(x, n - 1))))
        last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))
        return F.concat(F.flatten(pieces), T.let(F.slice(x, last + 1, F.size(x) - last), trailing))

    return T.let(lines, lambda x: T.let(shown, lambda s: whole(x, s)))


def render_plain(lines: Column, mask: Column) -> Column:
    """Kept lines that aren't blank; runs between them become "(filtered N lines)" if that is shorter, the last run always."""
    nothing = F.array().cast("array<string>")
    shown = T.let(lines, lambda x: F.filter(kept_numbers(mask), lambda n: ~T.is_blank(F.get(x, n - 1))))
    note = lambda g: F.array(F.concat(F.lit("(filtered "), F.size(g).cast("string"), F.lit(" lines)")))
    return F.array_join(_after_gaps(lines, shown, lambda g: F.when(_chars(g) > PLACEHOLDER_CHARS, note(g)).otherwise(g), lambda g: F.when(F.size(g) > 0, note(g)).otherwise(nothing)), "\n")


def render_marked(text: Column, lines: Column, mask: Column) -> Column:
    """Kept lines, each dropped run as one [pruned]; the text itself if nothing is kept. A final line feed stays."""
    nothing = F.array().cast("array<string>")
    mark = lambda g: F.when(F.size(g) > 0, F.array(F.lit("[pruned]"))).otherwise(nothing)
    shown = kept_numbers(mask)
    joined = F.regexp_replace(F.array_join(_after_gaps(lines, shown, mark, mark), "\n"), r"(?U)^\s+|\s+$", "")
    out = F.when((F.size(shown) > 0) & (joined != ""), joined).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(text.endswith("\n") & (out != ""), F.concat(out, F.lit("\n"))).otherwise(out)


def skeleton(lines: Column) -> Column:
    """Definitions and imports of Python lines, a [pruned] for every gap after the first of them."""
    nothing = F.array().cast("array<string>")
    starts = lambda x: F.reduce(F.array(*[F.lit(p) for p in SKELETON]), F.lit(False), lambda s, p: s | F.startswith(F.ltrim(x), p))
    shown = kept_numbers(F.transform(lines, starts))
    mark = lambda g: F.when(F.size(g) > 0, F.array(F.lit("[pruned]"))).otherwise(nothing)
    first = F.coalesce(F.get(shown, F.lit(0)), F.size(lines) + 1)
    rest = F.slice(lines, first, F.size(lines))
    return F.when(F.size(shown) > 0, F.array_join(_after_gaps(rest, F.transform(shown, lambda n: n - first + 1), mark, mark), "\n")).otherwise(F.lit(""))


def content_chars(text: Column) -> Column:
    """Characters of lines that are neither blank nor markers."""
    return F.aggregate(T.lines(text), F.lit(0), lambda s, x: s + F.when(T.is_blank(x) | T.is_marker(x), 0).otherwise(F.length(x)))


def with_floor(text: Column, pruned: Column, is_python: Column | None = None) -> Column:
    """struct(text, floor): the pruned text; if under a twentieth of the original is left, the skeleton of Python that has more content than that, else the original."""
    made = lambda out, floor: F.struct(out.alias("text"), F.lit(floor).cast("string").alias("floor"))
    original = made(text, "floor-original")
    bare = lambda left: T.let(skeleton(T.lines(text)), lambda s: F.when(is_python & (content_chars(s) > left), made(s, "floor-python-skeleton")).otherwise(original))
    return T.let(pruned, lambda p: T.let(content_chars(p), lambda left: F.when(left >= F.length(text) * LEAST_CONTENT, made(p, None)).otherwise(original if is_python is None else bare(left))))


def verdict(before: Column, after: Column, passed: Column) -> tuple[Column, Column]:
    """Decision and reason. passed: why the text passes through, or null; a skeleton is a pruned text."""
    passed = F.when(passed != "floor-python-skeleton", passed)
    same = before == after
    return F.when(passed.isNotNull() | same, "unchanged").otherwise("pruned"), F.coalesce(passed, F.when(same, "no-lines-removed").otherwise("model"))


def prune_lexical(df: DataFrame, question: str, text: str = "text", empty_line: bool = False) -> DataFrame:
    """df with lines, kept (numbers), pruned, decision and reason, by the lexical scorer, bridge, plain rendering and floor. empty_line: an empty text has an empty line, else none."""
    def kernel(x: Column) -> Column:
        return T.let(bridge_gaps(lexical_mask(x, question)), lambda m: result(x, m, with_floor(F.col(text), render_plain(x, m))))

    def result(x: Column, m: Column, floored: Column) -> Column:
        decided = lambda f: verdict(F.col(text), f["text"], f["floor"])
        return T.let(floored, lambda f: F.struct(x.alias("lines"), kept_numbers(m).alias("kept"), f["text"].alias("pruned"), decided(f)[0].alias("decision"), decided(f)[1].alias("reason")))

    return df.withColumn("_p", T.let(T.lines(T.with_a_line(F.col(text)) if empty_line else F.col(text)), kernel)).select(*df.columns, "_p.*")


def prune_kernel(df: DataFrame, question: str, scorer: str = "lexical", text: str = "text", most: int = 64, overlap: int = 16, threshold: float = 0.5, prefix: int = 0, repaired: bool = False, empty_line: bool = False) -> DataFrame:
    """df with lines, scores, kept, pruned, floor, repair, decision and reason: the whole kernel.

    Words in overlapping windows are scored window by window (scorer: a registered name), equal spans merged, rolled up to lines, cut at the threshold, bridged, rendered,
    repaired if asked for and Python, put above the floor and judged. All of it stays in the text's row: no shuffle. A text without words, or null: passes through as no-scored-chunks;
    with empty_line it goes on as others do, and an empty one has an empty line.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_t", whole).withColumn("_s", T.with_a_line(whole) if empty_line else whole)
    windows = chunks.token_windows(chunks.words(F.col("_s")), most, overlap)
    scored = F.transform(windows, lambda w: scorers.get(scorer)(w["tokens"], F.lit(question)))
    out = chunks.with_line_scores(out.withColumn("scores", scored), "_s", "scores", most, overlap).withColumn("lines", T.lines(F.col("_s")))
    out = out.withColumn("_mask", bridge_gaps(threshold_mask(F.col("scores"), threshold, prefix))).withColumn("kept", kept_numbers(F.col("_mask")))
    out = out.withColumn("_plain", render_plain(F.col("lines"), F.col("_mask")))
    python = F.lit(False)
    if repaired:
        # the tests and the repair run on rows that may be Python only; the others give them empty texts
        maybe = F.when(repair.may_be_python(F.col("_t")), F.col("_t")).otherwise(F.lit(""))
        out = out.withColumn("_python", repair.parses_udf(maybe) & repair.may_be_python(F.col("_t")))
        out = out.withColumn("_r", repair.repair_udf(F.when(F.col("_python"), F.col("_t")).otherwise(F.lit("")), F.when(F.col("_python"), F.col("kept")).otherwise(F.array().cast("array<int>"))))
        fixed = F.col("_python") & (F.col("_r.status") == "ok")
        out = out.withColumn("repair", F.when(F.col("_python"), F.col("_r.status"))).withColumn("_plain", F.when(fixed, F.col("_r.code")).otherwise(F.col("_plain")))
        python = F.col("_python")
    else:
        out = out.withColumn("repair", F.lit(None).cast("string"))
    passed = F.when(~F.exists("scores", lambda s: s.isNotNull()) & F.lit(not empty_line), F.lit("no-scored-chunks"))
    out = out.withColumn("_f", F.when(passed.isNotNull(), F.struct(F.col("_t").alias("text"), F.lit(None).cast("string").alias("floor"))).otherwise(with_floor(F.col("_t"), F.col("_plain"), python)))
    judged = verdict(F.col("_t"), F.col("_f.text"), F.coalesce(passed, F.col("_f.floor")))
    return out.select(*df.columns, "lines", "scores", "kept", F.col("_f.text").alias("pruned"), F.col("_f.floor").alias("floor"), "repair", judged[0].alias("decision"), judged[1].alias("reason"))
