"""Substring dedup: repeated word windows found by backward search in compressed FM-indexes, one per shard.

Windows are dealt to shards by their anchors (see _anchors), so that all copies of a window meet in one shard whose size is
bounded. Each shard builds an FM-index over its distinct segments: the Burrows-Wheeler transform in a wavelet matrix of bit
vectors with rank counts, beside the C array. The segments of the streamed documents are then matched from right to left, all
lanes at a time: every step extends the match by one word (two rank queries a level), and a match that has reached the
threshold first drops its last word (the interval of the shorter string). Where the matching statistic reaches the threshold,
the interval gives the earliest place in the corpus that has this window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import covered, repeated_windows
from ._text import chunks, column, word_hashes

GRAM_WORDS = 6


class WaveletMatrix:
    """Rank over a sequence of integers: one bit vector a level, a count before each 64-bit word of it."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.counts, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(values) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.bits.append(words)
            self.counts.append(counts)
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        begin = np.zeros_like(i)
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = self._ones(level, np.concatenate([begin, i]))
            b, e = ones[: len(i)], ones[len(i) :]
            begin, i = np.where(one, self.zeros[level] + b, begin - b), np.where(one, self.zeros[level] + e, i - e)
        return i - begin


class FmIndex:
    """Of a text of integers in which each document ends with a symbol of its own (the least ones)."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank, have = text.astype(np.int64), 1
        while have < depth + 2:  # suffixes are needed in the order of their first symbols only, which documents' ends make distinct soon
            after = np.zeros(n, dtype=np.int64)
            after[: n - have] = rank[have:] + 1
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.diff(key[order], prepend=-1) != 0
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new) - 1
            have *= 2
            if new.all():
                break
        self.order = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.bwt = WaveletMatrix(text[self.order - 1], max(1, int(text.max()).bit_length()))
        same = np.ones(n - 1, dtype=bool)
        a, b = self.order[:-1], self.order[1:]
        self.begin, self.end = {}, {}
        for d in range(depth):
            ok = np.flatnonzero(same)
            i, j = a[ok] + d, b[ok] + d
            same[ok] = (i < n) & (j < n) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])
            if d + 1 >= depth - 1:
                heads = np.flatnonzero(np.concatenate([[True], ~same]))
                run = np.cumsum(np.concatenate([[True], ~same])) - 1
                self.begin[d + 1], self.end[d + 1] = heads[run], np.append(heads[1:], n)[run]
        heads = np.flatnonzero(self.begin[depth] == np.arange(n))
        self.earliest = np.minimum.reduceat(self.order, heads)[np.cumsum(self.begin[depth] == np.arange(n)) - 1]

    def match(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the documents text[starts:ends] whose matching statistic (cut off at depth) reaches depth: the place, and the earliest place in the index with the same string."""
        by_length = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[by_length], ends[by_length]
        lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(text), dtype=np.int64)
        length, found, where = np.zeros(len(starts), dtype=np.int64), [], []
        for step in range(1, int((ends - starts).max(initial=0)) + 1):
            live = int(np.searchsorted(starts - ends, -step, side="right"))
            at = ends[:live] - step
            full = np.flatnonzero(length[:live] == self.depth)
            cut = lo[full]
            lo[full], hi[full], length[full] = self.begin[self.depth - 1][cut], self.end[self.depth - 1][cut], self.depth - 1
            c = text[at]
            lo[:live] = self.first[c] + self.bwt.rank(c, lo[:live])
            hi[:live] = self.first[c] + self.bwt.rank(c, hi[:live])
            length[:live] = np.where(hi[:live] > lo[:live], length[:live] + 1, 0)
            full = np.flatnonzero(length[:live] == self.depth)
            found.append(at[full])
            where.append(self.earliest[lo[full]])
        return np.concatenate(found or [starts[:0]]), np.concatenate(where or [starts[:0]])


def flag_earlier(pdf, window: int) -> list[np.ndarray]:
    """For each piece of a shard, in corpus order: which of its windows start earlier too."""
    parts = [np.frombuffer(p, dtype=np.uint64) for p in pdf["payload"]]
    sizes = np.array([len(p) for p in parts])
    _, words = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(int(ends[-1]) + 1, dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside], text[ends] = words + len(parts), np.arange(len(parts))
    place, earliest = FmIndex(text, window).match(text, ends - sizes, ends)
    earlier = np.zeros(len(text), dtype=bool)
    earlier[place] = earliest < place
    return [earlier[e - s : e - s + n] for e, s, n in zip(ends, sizes, pdf["n_win"], strict=True)]


def _cut(text: bytes, spans: list[tuple]) -> Iterator:
    words, _ = word_hashes([text])
    for s, off, n, lo, hi in spans:
        part = words[lo:hi].tobytes()
        yield (s, off, n), part, int.from_bytes(hashlib.blake2b(part, digest_size=7).digest())


def dedup_word_windows(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts earlier: at a smaller doc_id, or before in the document.

    Words are maximal runs of bytes other than ASCII white space, unchanged. Returns doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space) and kept_text. Null or empty text: no words. A null doc_id comes before all others. Rows of the same doc_id and text
    count as one document that each of them returns; rows of one doc_id with different texts share their marks where these fit. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long").alias("key"), F.col(text).cast("binary").alias("data"))
    marks = repeated_windows(rows, lambda t: word_hashes(t), "words", window, GRAM_WORDS, _cut, flag_earlier, first_is_free=True)

    def keep(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data"):
            marked = batch.column(batch.schema.get_field_index("marks")).to_pylist()
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for t, m in zip(texts, marked, strict=True):
                words = t.split()
                gone = covered(m, len(words), window) if m else np.zeros(len(words), dtype=bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if m else words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "key"), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], ["key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = rows.join(marks, "key", "left").mapInArrow(keep, "key long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.when(F.col("key") != -(1 << 63), F.col("key")).alias(doc_id), "n_words", "n_removed", "kept_sha256", "kept_text")
