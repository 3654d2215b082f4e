"""Suffix-array dedup: repeated byte strings found by constructing a transform of many documents column by column.

The documents of a shard are its distinct segments, standing side by side so that their anchors share a column: a string that
two of them have in common with the same anchor lies in the same columns. Each round goes one column to the left and inserts one
symbol per document: a stable sort by the new symbols turns the order of the suffixes right of the column into that of the suffixes beginning at it
(the column's symbols in the former order are its stretch of the Burrows-Wheeler transform), and the common prefixes of neighbours
follow from those of the round before: one more than the least between their former places if their symbols agree, else none. Wherever a
common prefix reaches the threshold, both neighbours begin a repeated string. A round reads the former order and prefixes once and in sequence and writes the
new ones, so they could stay in external files; shards are bounded, so here they are arrays in memory, which no lost executor or full disk harms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import covered, repeated_windows
from ._text import BYTE_CODES, chunks, column

GRAM_BYTES = 64
_PAD = 256


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair, lo < hi."""
    tables, width = [values], 1
    longest = int((hi - lo).max(initial=1))
    while width * 2 <= longest:
        tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    for k, table in enumerate(tables):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k)])
    return out


def flag_repeats(pdf, window: int) -> list[np.ndarray]:
    """For each piece of a shard: which of its windows another piece, or another place of it, has too."""
    parts = pdf["payload"].tolist()
    flags = [np.zeros(n, dtype=bool) for n in pdf["n_win"]]
    anchor, a_pos = pdf["anchor"].to_numpy(), pdf["a_pos"].to_numpy()
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(members[group] > 1)
    if not len(rows):
        return flags
    group, shift = group[rows], a_pos[rows].max() - a_pos[rows]
    width = int(max(s + len(parts[r]) for s, r in zip(shift, rows, strict=True)))
    columns = np.full((width, len(rows)), _PAD, dtype=np.int16)
    for k, (s, r) in enumerate(zip(shift.tolist(), rows.tolist(), strict=True)):
        columns[s : s + len(parts[r]), k] = np.frombuffer(parts[r], dtype=np.uint8)
    order = np.argsort(group, kind="stable")
    keys = group * (_PAD + 1)
    common = np.zeros(len(rows), dtype=np.int32)
    hits = np.zeros((width, len(rows)), dtype=bool)
    for c in range(width - 1, -1, -1):
        key = (keys + columns[c])[order]
        by = np.argsort(key, kind="stable")
        key = key[by]
        fresh = np.zeros_like(common)
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % (_PAD + 1) != _PAD)) + 1
        lo, hi = by[same - 1] + 1, by[same] + 1
        near = hi - lo == 1
        least = common[lo]
        if not near.all():
            far = np.flatnonzero(~near)
            least[far] = range_min(common, lo[far], hi[far])
        fresh[same] = least + 1
        order, common = order[by], fresh
        full = np.flatnonzero(common >= window)
        hits[c, order[full]] = hits[c, order[full - 1]] = True
    for k, r in enumerate(rows.tolist()):
        flags[r] = hits[shift[k] : shift[k] + len(flags[r]), k].copy()
    return flags


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_CODES[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.cumsum([0, *map(len, texts)])


def _cut(text: bytes, spans: list[tuple]) -> Iterator:
    for s, off, n, lo, hi in spans:
        part = text[lo:hi]
        yield (s, off, n), part, int.from_bytes(hashlib.blake2b(part, digest_size=7).digest())


def dedup_byte_strings(docs: DataFrame, window: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes every byte covered by a string of `window` bytes that starts anywhere else too, in any document or the same one.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept_text (bytes that are no longer valid UTF-8 become the
    replacement character there, not in the hash). Null text: empty. A null doc_id is a document of its own. Rows of one doc_id and text count as two places of the
    text, and each gets its result; rows of one doc_id with different texts share their marks where these fit. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long").alias("key"), F.col(text).cast("binary").alias("data"))
    marks = repeated_windows(rows, _units, "bytes", window, GRAM_BYTES, _cut, flag_repeats, first_is_free=False)

    def keep(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data"):
            marked = batch.column(batch.schema.get_field_index("marks")).to_pylist()
            removed, spans, digests, kept_texts = [], [], [], []
            for t, m in zip(texts, marked, strict=True):
                gone = covered(m, len(t), window) if m else np.zeros(len(t), dtype=bool)
                kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes() if m else t
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "key"), pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    out = rows.join(marks, "key", "left").mapInArrow(keep, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("key") != -(1 << 63), F.col("key")).alias(doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
