"""Dealing out all windows of a fixed length so that equal windows meet, at a cost linear in the corpus.

A window (W consecutive units: words or bytes) is represented by its *anchor*, the k-gram of least hash within it. Equal
windows have equal anchors, so each window needs comparing only with those of its anchor. Consecutive windows that share
one anchor occurrence form a *segment*. Anchors that occur once in the corpus, nearly all of them in fresh text, are
dismissed after counting 64-bit values; only segments of repeated anchors are cut out of the documents and indexed.

Hot data: equal segments are counted map-side before anything is indexed. Occurrences of what has more than 1 / HOT_SHARE of them all (so fewer than HOT_SHARE
values, whatever the corpus) are joined by broadcast, where they stand, the others by shuffle. An anchor with more than HOT_SEGMENTS different segments is
indexed window by window, dealt by the window's own hash. There is one such anchor to HOT_SEGMENTS segments at most, so their list is broadcast and segments stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, shuffle_parts, work_table
from ._text import as_long, chunks, column, gram_hashes, range_hashes

HOT_SEGMENTS = 20_000
HOT_SHARE = 1024
OCCURRENCE_BYTES = 1 << 20
SHARD_UNITS = {"words": 200_000, "bytes": 1_200_000}
_POSITION = np.uint64((1 << 24) - 1)


def _least(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of span hashes the place of the least, by the bits above _POSITION, the first of equal ones. Positions count within stretches they have the bits for, so g may have any length."""
    step = int(_POSITION) + 1 - (span - 1)
    out = np.empty(len(g) - span + 1, dtype=np.int64)
    for lo in range(0, len(out), step):
        part = g[lo : lo + step + span - 1]
        least = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if span > have:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        out[lo : lo + step] = (least & _POSITION).astype(np.int64) + lo
    return out


def segments(units: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of concatenated documents (begins: first unit of each, and the end): document, anchor hash, first window, number of windows, anchor position."""
    none = np.zeros(0, dtype=np.int64)
    if len(units) < window:
        return none, none.astype(np.uint64), none, none, none
    g = gram_hashes(units, gram)
    at = _least(g, window - gram + 1)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    start = np.flatnonzero(doc[: len(at)] == doc[window - 1 : window - 1 + len(at)])
    at = at[start]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return doc[start[first]], g[at[first]], start[first], np.diff(first, append=len(at)), at[first]


def occurrences(docs: DataFrame, to_units: Callable, window: int, gram: int) -> DataFrame:
    """docs (key, data) -> anchor, seg (content hash), key, start, n_win, a_pos of all segments."""

    def emit(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data", OCCURRENCE_BYTES):
            units, begins = to_units(texts)
            doc, anchor, start, n_win, at = segments(units, begins, window, gram)
            seg = range_hashes(units, start, start + n_win + window - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(anchor)), pa.array(as_long(seg)), pa.array(column(batch, "key")[doc], pa.int64()), pa.array((start - begins[doc]).astype(np.int32)), pa.array(n_win.astype(np.int32)), pa.array((at - start).astype(np.int32))],
                ["anchor", "seg", "key", "start", "n_win", "a_pos"],
            )

    return docs.mapInArrow(emit, "anchor long, seg long, key long, start int, n_win int, a_pos int")


def repeated_windows(docs: DataFrame, to_units: Callable, unit: str, window: int, gram: int, payload: Callable, index: Callable, first_is_free: bool) -> DataFrame:
    """docs (key, data) -> key, marks (array of start, n_win, bits): which windows repeat.

    index(pdf, window) gets the pieces of one shard (anchor, seg, off, key, start, n_win, a_pos, payload; one row per
    distinct segment) and returns an array of flags of windows for each. payload(texts, spans) cuts the pieces.
    first_is_free: the earliest occurrence of a window isn't marked (flags say "starts earlier"), else all are. bits null: all n_win.
    """
    occ = work_table(occurrences(docs, to_units, window, gram))
    most = occ.count() // HOT_SHARE + 1
    again = work_table(occ.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    often = F.broadcast(again.where(F.col("n") > most).select("anchor"))
    seldom = again.where(F.col("n") <= most).select("anchor").hint("merge")
    cand = work_table(occ.join(often, "anchor", "left_semi").union(occ.join(often, "anchor", "left_anti").join(seldom, "anchor", "left_semi")))
    drop_table(occ)
    segs = work_table(cand.groupBy("anchor", "seg").agg(F.min(F.struct("key", "start")).alias("first"), F.max("n_win").alias("n_win"), F.max("a_pos").alias("a_pos"), F.count("*").alias("n")))
    units_of = lambda c: F.col(c) + F.lit(window - 1)
    total = segs.agg(F.sum(units_of("n_win"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_UNITS[unit]))
    hot = segs.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot"))
    lists = segs.join(F.broadcast(hot), "anchor", "left").groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("anchor", "seg", F.col("first.start").alias("start"), "n_win", "a_pos", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("list"))

    def batch_of(rows: list[tuple]):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "anchor", "seg", "off", "key", "start", "n_win", "a_pos", "payload"])

    def cut(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data"):
            rows: list[tuple] = []
            for key, text, listed in zip(column(batch, "key").tolist(), texts, batch.column(batch.schema.get_field_index("list")).to_pylist(), strict=True):
                spans = []
                for s in listed:
                    pieces = [(s, j, 1) for j in range(s["n_win"])] if s["hot"] else [(s, 0, s["n_win"])]
                    spans += pieces
                for (s, off, n), part, deal in payload(text, [(s, off, n, s["start"] + off, s["start"] + off + n + window - 1) for s, off, n in spans]):
                    rows.append(((deal if s["hot"] else s["anchor"]) % shards, s["anchor"], s["seg"], off, key, s["start"] + off, n, s["a_pos"] - off, part))
                    if len(rows) == 20_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    pieces = docs.join(lists, "key").mapInArrow(cut, "shard long, anchor long, seg long, off int, key long, start int, n_win int, a_pos int, payload binary")

    def flag(pdf):
        pdf = pdf.sort_values(["key", "start"], ignore_index=True)
        flags = index(pdf, window)
        pdf["bits"] = [np.packbits(f, bitorder="little").tobytes() for f in flags]
        return pdf.loc[[bool(f.any()) for f in flags], ["anchor", "seg", "off", "n_win", "bits"]]

    deal = pieces.repartition(max(shuffle_parts(docs.sparkSession), min(shards, 4096)), "shard")
    flags = work_table(deal.groupBy("shard").applyInPandas(flag, "anchor long, seg long, off int, n_win int, bits binary"))
    parts = flags.groupBy("anchor", "seg").agg(F.collect_list(F.struct("off", "n_win", "bits")).alias("parts"))
    known = segs.join(parts, ["anchor", "seg"], "left").select("anchor", "seg", "first", "parts", "n").where("n > 1 or parts is not null")
    free = F.col("first") == F.struct("key", "start") if first_is_free else F.col("n") == 1
    all_of = F.array(F.struct(F.lit(0).alias("off"), F.col("n_win"), F.lit(None).cast("binary").alias("bits")))
    often = F.broadcast(segs.where(F.col("n") > most).select("anchor", "seg"))
    hot_known = F.broadcast(known.where(F.col("n") > most))
    pairs = cand.join(hot_known, ["anchor", "seg"]).unionByName(cand.join(often, ["anchor", "seg"], "left_anti").join(known.where(F.col("n") <= most).hint("merge"), ["anchor", "seg"]))
    marked = pairs.select("key", "start", F.when(free, F.col("parts")).otherwise(all_of).alias("parts")).where("parts is not null")
    marks = marked.groupBy("key").agg(F.flatten(F.collect_list(F.expr("transform(parts, p -> struct(start + p.off as start, p.n_win as n_win, p.bits as bits))"))).alias("marks"))
    out = work_table(marks)
    for t in (again, cand, segs, flags):
        drop_table(t)
    return out


def covered(marks: list[dict] | None, n: int, window: int) -> np.ndarray:
    """Which of n units a marked window covers."""
    step = np.zeros(n + 1, dtype=np.int32)
    for m in marks or ():
        if m["start"] + m["n_win"] + window - 1 > n:
            continue
        if m["bits"] is None:
            step[m["start"]] += 1
            step[m["start"] + m["n_win"] - 1 + window] -= 1
        else:
            at = m["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], dtype=np.uint8), bitorder="little"))
            step[at] += 1
            step[at + window] -= 1
    return np.cumsum(step[:-1]) > 0
