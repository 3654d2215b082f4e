"""Document fingerprints: digests of content-defined chunks, compared by containment weighted by length.

A gear hash (the sum of a random number for each of the last 32 bytes, doubled at each step) is computed at every byte; a chunk ends where its top bits are
zero: more of them before the normal size, fewer after it, so sizes gather round it, within a least and a largest size. Boundaries follow content, so an insertion
changes the chunks it touches and no others. There are three scales for short, middle and long texts. A text is cut on its own scale and on all finer ones, so
any two texts have a scale in common, however different their lengths; they are compared on the coarsest that serves the shorter one. A boundary
hangs on the 32 bytes before it, so of a text that stands in another, the first 32 bytes or so may be cut differently; for texts of about that length likeness is low.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import shuffle_parts
from ._text import BYTE_CODES, mix, range_hashes

#: Least, normal and largest chunk size; zero top bits asked for before and after the normal size.
SCALES = {"t": (1, 4, 16, 3, 1), "f": (4, 16, 64, 6, 2), "c": (16, 64, 256, 8, 4)}
#: Least bytes of the texts that are cut on a scale. No upper bound: a long text is also cut on the scales of the short ones it may hold.
SERVES = {"t": 1, "f": 96, "c": 1024}
_GEAR = (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_NO_ID = -(1 << 63)
#: Bytes of fingerprints that are returned at a time.
OUTPUT_BYTES = 1 << 22


def gear_hashes(data: np.ndarray) -> np.ndarray:
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def chunk_ends(h: np.ndarray, scale: tuple) -> list[int]:
    least, normal, most, hard_bits, easy_bits = scale
    easy = np.flatnonzero(h >> np.uint32(32 - easy_bits) == 0)
    hard = easy[h[easy] >> np.uint32(32 - hard_bits) == 0]
    if normal <= 4:
        return _followed(len(h), hard, easy, least, normal, most)
    hard, easy, n, begin, ends = hard.tolist(), easy.tolist(), len(h), 0, []
    n_hard, n_easy = len(hard), len(easy)
    while n - begin > least:
        k = bisect_left(hard, begin + least)
        if k < n_hard and hard[k] < begin + normal:
            end = hard[k] + 1
        else:
            k = bisect_left(easy, begin + normal)
            end = min(easy[k] + 1 if k < n_easy else n, begin + most)
        begin = min(end, n)
        ends.append(begin)
    if begin < n:
        ends.append(n)
    return ends


def _followed(n: int, hard: np.ndarray, easy: np.ndarray, least: int, normal: int, most: int) -> list[int]:
    """The same ends: where a chunk would end is found for every byte at once, which is faster where chunks are of a few bytes."""
    place = np.arange(n, dtype=np.int64)
    near = np.full(n + normal, n + normal, dtype=np.int64)
    far = np.full(n + normal, n - 1, dtype=np.int64)
    near[hard], far[easy] = hard, easy
    near, far = np.minimum.accumulate(near[::-1])[::-1], np.minimum.accumulate(far[::-1])[::-1]
    end = np.where(near[least : n + least] < place + normal, near[least : n + least] + 1, np.minimum(far[normal:] + 1, place + most))
    end[max(0, n - least) :] = n
    following, begin, ends = np.minimum(end, n).tolist(), 0, []
    while begin < n:
        begin = following[begin]
        ends.append(begin)
    return ends


_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)


def chunk_sets(text: bytes) -> dict[str, np.ndarray]:
    """The distinct chunks of a text on its own scale and all finer ones, packed: 48 bits of digest, 12 bits of length."""
    if not text:
        return {}
    data = np.frombuffer(text, dtype=np.uint8)
    h, units, out = gear_hashes(data), BYTE_CODES[data], {}
    for name, least in SERVES.items():
        if least <= len(text):
            ends = np.array(chunk_ends(h, SCALES[name]), dtype=np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            out[name] = np.unique((range_hashes(units, begins, ends) >> np.uint64(16) << np.uint64(12)) | (ends - begins).astype(np.uint64))
    return out


def written(sets: dict[str, np.ndarray]) -> str:
    """A fingerprint as text: for each scale its name, the number of chunks, and 10 characters (base 64) a chunk, ascending. Empty text: empty."""
    out = ""
    for name, packed in sets.items():
        codes = np.unpackbits(packed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 4:].reshape(-1, 10, 6) @ np.array([32, 16, 8, 4, 2, 1], dtype=np.uint8)
        out += f"{name}{len(packed)}:" + _DIGITS[codes].tobytes().decode()
    return out


def likeness(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> float:
    """Length of the chunks in common by that of the smaller side's, on the coarsest scale that both have: all texts have the finest. 1 for two empty texts, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    name = next(s for s in "cft" if s in a and s in b)
    weight = lambda x: int((x & np.uint64(4095)).sum())
    return weight(np.intersect1d(a[name], b[name], assume_unique=True)) / min(weight(a[name]), weight(b[name]))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by the first as many code points, or all, of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see edited; the following document is the next by descending doc_id, after the last the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited and to the following text).
    Null text: empty. A null doc_id comes last. Rows of one doc_id follow one another by text. Other columns are ignored.

    Documents are dealt by ranges of doc_id, a task each (the range's number is the partition's, so no two meet by hash); each range also gets a copy of the document that follows its last one, so no order over all rows is needed.
    The driver gets one number a range.
    """
    spark = docs.sparkSession
    ranges = 2 * shuffle_parts(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("data"))
    bounds = np.unique(np.array(rows.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    placed = rows.withColumn("range", range_of("key"))
    heads = sorted(((r["range"], r["key"]) for r in rows.select("key").withColumn("range", range_of("key")).groupBy("range").agg(F.max("key").alias("key")).collect()), reverse=True)
    after = [(r, heads[(i + 1) % len(heads)][1]) for i, (r, _) in enumerate(heads)]
    copies = placed.drop("range").join(F.broadcast(spark.createDataFrame(after, "range int, key long")), "key").select("key", "data", "range", F.lit(1).alias("copy"))
    dealt = placed.select("key", "data", "range", F.lit(0).alias("copy")).union(copies).repartitionById(ranges, "range").sortWithinPartitions("range", "copy", F.desc("key"), "data")

    def rows_of(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def emit(batches: Iterator) -> Iterator:
        have = None
        for batch in batches:
            keys, texts, at, copy = (batch.column(i).to_pylist() for i in range(4))
            out, held = [], 0
            for key, t, r, c in zip(keys, texts, at, copy, strict=True):
                sets = chunk_sets(t.encode())
                if have and have[2] == r:
                    mine = edited(have[1], t)
                    its = chunk_sets(mine.encode())
                    out.append((have[0], len(have[1]), hashlib.sha256(mine.encode()).hexdigest(), written(have[3]), written(its), likeness(have[3], its), likeness(have[3], sets)))
                    held += len(out[-1][3]) + len(out[-1][4])
                    if held >= OUTPUT_BYTES:
                        yield rows_of(out)
                        out, held = [], 0
                have = None if c else (key, t, r, sets)
            yield rows_of(out)

    done = dealt.mapInArrow(emit, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.select(F.when(F.col("key") != _NO_ID, F.col("key")).alias(doc_id), *done.columns[1:])
