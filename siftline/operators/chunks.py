"""Tokens, overlapping windows, merged scores, line scores, and packing into batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.batches import by_stretches, give_back, text_stretches
from ..functions.text import let, lines

TOKEN = "array<struct<start:int,end:int>>"


def char_tokens(text: Column) -> Column:
    return F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))


def _word_spans(text: pa.Array) -> pa.Array:
    texts = [t or "" for t in text.to_pylist()]
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = (points != 32) & (points != 10)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cut = np.searchsorted(starts, begins)
    base = np.repeat(begins[:-1], np.diff(cut))
    spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans)


def word_tokens(text: Column) -> Column:
    """Spans (0-based, end exclusive) of words separated by blanks and line feeds, vectorised over Arrow batches: a fold over an array would copy it at every step."""

    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_stretches(_word_spans, columns)

    return F.arrow_udf(spans, TOKEN)(text)


def token_windows(tokens: Column, most: int, overlap: int) -> Column:
    """Windows of at most `most` tokens, each repeating the last `overlap` of the one before: struct(idx, tokens). No tokens: one empty window."""
    stride = most - max(0, min(overlap, most - 1))
    count = lambda t: F.greatest(F.lit(0), F.ceil((F.size(t) - most) / stride)).cast("int")
    return let(tokens, lambda t: F.transform(F.sequence(F.lit(0), count(t)), lambda k: F.struct(k.alias("idx"), F.slice(t, k * stride + 1, most).alias("tokens"))))


def explode_windows(df: DataFrame, tokens: str, most: int, overlap: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(token_windows(F.col(tokens), most, overlap)).alias("w")).select(*keep, F.col("w.idx").alias("chunk_idx"), "w.tokens")


def merge_scores(scored: DataFrame, key: str) -> DataFrame:
    """scored (key, start, end, score) of overlapping windows: the mean for each span; spans that merely overlap stay apart."""
    return scored.where("end > start AND start >= 0").groupBy(key, "start", "end").agg(F.avg("score").alias("score"))


def valid_spans(spans: DataFrame) -> DataFrame:
    """spans (start, end, length of the text): those that aren't empty and lie within the text, as at the merge of windows."""
    return spans.where("end > start AND start >= 0 AND end <= length")


def clamp_spans(spans: DataFrame) -> DataFrame:
    """spans (start, end, length of the text): cut to the text, as at the roll-up to lines; without those of which nothing is left."""
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("length"))).alias(c)
    return spans.select(*[inside(c) if c in ("start", "end") else c for c in spans.columns]).where("end > start")


_BREAKS = np.array([10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029], dtype=np.uint32)


def _line_spans(text: pa.Array) -> pa.Array:
    """Over all texts at once: the code points at which lines end, and so where they begin."""
    texts = [t or "" for t in text.to_pylist()]
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])  # behind each text stands a line feed that isn't its own
    breaks = (points <= 13) & (points >= 10) | (points >= 0x1C) & np.isin(points, _BREAKS) if len(points) else points > 0
    breaks[begins[1:] - 1] = False
    second = np.zeros(len(points), dtype=bool)
    second[1:] = breaks[1:] & (points[1:] == 10) & breaks[:-1] & (points[:-1] == 13)
    at = np.flatnonzero(breaks & ~second)
    after = at + 1
    two = after < len(points)
    two[two] = second[after[two]]
    after = after + two
    kept = at + ~((points[at] == 10) | (points[at] == 13))  # other ends of lines count as text
    # a line begins with each text that isn't empty and behind each break that isn't its text's end
    full = np.flatnonzero(np.diff(begins) > 1)
    last = begins[1:] - 1
    opened = after[after < last[np.searchsorted(begins, at, side="right") - 1]]
    starts = np.sort(np.concatenate([begins[full], opened]))
    ended = last[np.searchsorted(begins, starts, side="right") - 1]
    first = np.searchsorted(at, starts)
    stops = np.append(kept, len(points))[first]
    found = np.append(at, len(points))[first]
    stops = np.where(found < ended, stops, ended)
    cut = np.searchsorted(starts, begins)
    base = np.repeat(begins[:-1], np.diff(cut))
    spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans)


def line_spans(text: Column) -> Column:
    """The character range of every line: without carriage returns and line feeds at its end; other ends of lines count as its text. Linear in the text, over Arrow batches."""

    def spans(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_stretches(_line_spans, columns)

    return F.arrow_udf(spans, TOKEN)(text)


def line_ranges(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """key columns, n (from 1), line, start, end: each line and its character range."""
    rows = df.select(*keep, F.posexplode_outer(F.arrays_zip(lines(F.col(text)).alias("line"), line_spans(F.col(text)).alias("span"))).alias("i", "z"))
    return rows.where("z IS NOT NULL").select(*keep, (F.col("i") + 1).alias("n"), F.col("z.line").alias("line"), F.col("z.span.start").alias("start"), F.col("z.span.end").alias("end"))


def roll_up(begin: np.ndarray, stop: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines (begin, stop, in order) and distinct spans: for each line the mean score of its spans by overlap, within [0, 1], and whether it has any. A span meets
    the lines from the first that ends after its start to the last that begins before its end, so the cost is that of the meetings."""
    first, last = np.searchsorted(stop, start, side="right"), np.searchsorted(begin, end, side="left")
    times = np.maximum(last - first, 0)
    span = np.repeat(np.arange(len(start)), times)
    line = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    weight = np.maximum(np.minimum(stop[line], end[span]) - np.maximum(begin[line], start[span]), 0)
    total = np.bincount(line, weight, minlength=len(begin))
    sums = np.bincount(line, score[span] * weight, minlength=len(begin))
    return np.clip(sums / np.maximum(total, 1), 0.0, 1.0), total > 0


def words(text: Column) -> Column:
    """The texts of word_tokens."""
    return F.filter(F.split(text, "[ \n]", -1), lambda w: w != "")


def with_line_scores(df: DataFrame, text: str, scores: str, most: int, overlap: int) -> DataFrame:
    """df with the column scores (an array of each window's scores of word_tokens; neither it nor text null) replaced by the score of each line, null where a line has none.

    Tokens that several windows have get the mean. It stays within the row: no shuffle, and a cost linear in the text.
    """
    stride = most - max(0, min(overlap, most - 1))

    def roll(text: pa.Array, scores: pa.Array) -> pa.Array:
        spans, ranges, out = _word_spans(text), _line_spans(text), []
        at, cut = ranges.offsets.to_numpy(), spans.offsets.to_numpy()
        begin, stop = (ranges.values.field(c).to_numpy() for c in ("start", "end"))
        start, end = (spans.values.field(c).to_numpy() for c in ("start", "end"))
        means = _merged(cut, scores, stride)
        for k in range(len(text)):
            line, any_ = roll_up(begin[at[k] : at[k + 1]], stop[at[k] : at[k + 1]], start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]], means[cut[k] : cut[k + 1]])
            out.append(pa.array(line, pa.float64(), mask=~any_))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.concat_arrays(out or [pa.array([], pa.float64())]))

    return _with_column(df, text, scores, roll, ArrayType(DoubleType()))


def with_merged_spans(df: DataFrame, text: str, scores: str, most: int, overlap: int) -> DataFrame:
    """As with_line_scores, but scores becomes the tokens' spans with their mean scores: (start, end, score)."""
    stride = most - max(0, min(overlap, most - 1))

    def merge(text: pa.Array, scores: pa.Array) -> pa.Array:
        spans = _word_spans(text)
        means = pa.array(_merged(spans.offsets.to_numpy(), scores, stride))
        return pa.ListArray.from_arrays(spans.offsets, pa.StructArray.from_arrays([spans.values.field(0), spans.values.field(1), means], ["start", "end", "score"]))

    return _with_column(df, text, scores, merge, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])))


def _merged(cut: np.ndarray, scores: pa.Array, stride: int) -> np.ndarray:
    """The mean score of every token of a batch's texts (cut: where each text's tokens begin), over the windows that have it."""
    of_text, windows = scores.offsets.to_numpy(), scores.values
    of_window = windows.offsets.to_numpy()[of_text[0] : of_text[-1] + 1]
    value = windows.values.to_numpy(zero_copy_only=False)[of_window[0] : of_window[-1]] if len(of_window) else np.zeros(0)
    sizes = np.diff(of_window)
    nth = np.arange(len(sizes)) - np.repeat(of_text[:-1] - of_text[0], np.diff(of_text))  # of its text's windows
    first = np.repeat(cut[:-1], np.diff(of_text)) + nth * stride
    token = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    return np.bincount(token, value, minlength=cut[-1]) / np.maximum(np.bincount(token, minlength=cut[-1]), 1)


def _with_column(df: DataFrame, text: str, scores: str, made, kind) -> DataFrame:
    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            for lo, hi in text_stretches(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(lo, hi - lo)
                of = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                of[scores] = made(of[text], of[scores])
                yield pa.RecordBatch.from_arrays([*of.values()], [*of])
        give_back()

    return df.mapInArrow(emit, StructType([StructField(f.name, kind) if f.name == scores else f for f in df.schema.fields]))


def _pack(lengths: Column, closes) -> Column:
    """Greedy batches of an array, a new one wherever closes(first, size, longest so far, next) holds; over Arrow batches, since a fold over arrays copies them at every step."""

    def packed(column: pd.Series) -> pd.Series:
        return column.map(pack)

    def pack(row) -> list | None:
        done, longest = [], 0
        for x in row if row is not None else ():
            if not done or closes(done[-1][0], len(done[-1]), longest, x):
                done.append([])
                longest = x
            done[-1].append(x)
            longest = max(longest, x)
        return done if row is not None else None

    return F.pandas_udf(packed, "array<array<int>>")(lengths)


def bucket_lengths(lengths: Column, most: int, ratio: float) -> Column:
    """Lengths, sorted, in buckets of at most `most` whose longest is at most `ratio` times the shortest."""
    return _pack(F.array_sort(lengths), lambda first, size, longest, x: size >= most or x > first * ratio)


def split_by_budget(lengths: Column, budget: int) -> Column:
    """Batches, in order, whose count times longest stays within the budget; a longer single stands alone."""
    return _pack(lengths, lambda first, size, longest, x: (size + 1) * max(longest, x) > budget)


def pad(ids: Column, length: Column, filler: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), length - F.size(ids))))


def shifted(spans: Column, by: Column) -> Column:
    """Spans moved by so many characters, as from a window's text to the whole."""
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))
