"""Token-ID output: Parquet files of token lists that can be read by row range and by column.

A file holds the documents of one range of doc_id, ascending; files ascend too. Token ids are a list column with dictionary encoding (16 bits an id
or fewer), doc_id and the running starts are delta-encoded, row groups and pages are bounded, and page indexes let a reader of a few
documents skip all other pages, and a reader of metadata all tokens.

The tokenizer splits texts before merging bytes, and never across the place before a blank or line feed that follows other than white space. Texts are cut
there, every distinct piece is encoded by the tokenizer once, and pieces' ids are put together again: several times as fast, with the same ids. A tokenizer file that splits texts in
another way encodes every text whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import shuffle_parts
from ._text import chunks, column

END_ID = 0
PARQUET_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
}
_CACHE_PIECES = 600_000
_BLANK, _SPACE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[[10, 32]] = True
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Ids of texts as unsigned 32-bit integers, by a byte-level tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        first = told["pre_tokenizer"] or {}
        # only of this way to split a text is it known where it may be cut
        self.cuts = told["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character a byte
        self._forget()

    def _forget(self) -> None:
        """Piece k has ids[upto[k] : upto[k + 1]]."""
        self.known, self.ids, self.upto = {}, np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _add(self, pieces: list[str], ids: list[np.ndarray], counts: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(counts)])

    @staticmethod
    def of(path: str) -> PieceEncoder:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        return _encoders[path]

    def _learn(self, pieces: list[str], sizes: np.ndarray) -> None:
        """New pieces with their bytes. Those of one kind follow one another safely, so hundreds are encoded as one text and told apart by bytes."""
        odd = np.fromiter((p[0] not in " \n" or p[-1].isspace() for p in pieces), bool, len(pieces))
        alone = [pieces[i] for i in np.flatnonzero(odd).tolist()]  # a text's first piece, or one that must not be followed by another
        ids = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4") for p in alone]
        self._add(alone, ids, np.fromiter(map(len, ids), np.int64, len(ids)))
        pieces, ends, ids = [p for p, o in zip(pieces, odd.tolist(), strict=True) if not o], np.cumsum(sizes[~odd]), []
        for i in range(0, len(pieces), 4096):
            group = ["".join(pieces[j : j + 256]) for j in range(i, min(i + 4096, len(pieces)), 256)]
            ids += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
        if pieces:
            upto = np.searchsorted(np.cumsum(self.lengths[np.concatenate(ids)]), ends) + 1
            self._add(pieces, ids, np.diff(upto, prepend=0))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8) one after another, and how many each text has."""
        texts = [t if _is_utf8(t) else t.decode("utf-8", "replace").encode() for t in texts]
        if not self.cuts:
            found = [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4") for t in texts]
            return np.concatenate([self.ids[:0], *found]), np.array([len(x) for x in found], dtype=np.int64)
        data, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
        starts = piece_starts(np.frombuffer(data, dtype=np.uint8), begins)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > _CACHE_PIECES:
            self._forget()
        new = np.fromiter((p not in self.known for p in distinct), bool, len(distinct))
        self._learn([distinct[i] for i in np.flatnonzero(new).tolist()], pc.binary_length(pieces.dictionary).to_numpy()[new])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[which]
        counts = self.upto[at + 1] - self.upto[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.upto[at] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, begins)])


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start: at the first byte of each text, and at blanks and line feeds that don't follow white space, Unicode's included."""
    at = np.flatnonzero(_BLANK[data])
    at = at[at > 0]
    at = at[~_SPACE[data[at - 1]]]
    wide = at[(data[at - 1] >= 128) & (at > 1)]
    one, two = data[wide - 1], data[wide - 2]
    three = data[np.maximum(wide - 3, 0)]
    space = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE3) & (two == 0x80) & (one == 0x80) | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    space |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[at] = True
    marks[wide[space]] = False
    marks[begins] = True  # the last is the end, where an empty text or none may begin
    return np.flatnonzero(marks[:-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Writes doc_id, shard, shard_start (ids before it in its file), n_tokens and ids, in ascending doc_id order, null first.

    Null or empty text: the end id alone. Rows of one doc_id follow one another; where they fill more than one file, they are dealt to these by a hash of the text, and
    stand by text in each. Other columns are ignored. No rows: a file without rows.
    """
    def emit(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encoder, shard, start = PieceEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches, "data", 6 << 20):
            found, sizes = encoder.encode(texts)
            found, sizes = np.insert(found, np.cumsum(sizes), END_ID), sizes + 1
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(texts), shard, dtype=np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes), ids], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
            start += int(offsets[-1])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data"))
    dealt = rows.repartitionByRange(files or shuffle_parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("data")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "data")
    dealt.mapInArrow(emit, "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>").write.options(**PARQUET_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with start: the ids of all documents before. Starts need the files' totals only, one row a file (files are as many as write_tokens was told)."""
    rows = spark.read.schema("doc_id long, shard int, shard_start long, n_tokens long, ids array<int>").parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shards_start"))
    return rows.join(F.broadcast(totals), "shard").select("doc_id", (F.col("shard_start") + F.col("shards_start")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """ids replaced by ids_crc32: of all of them as little-endian unsigned 32-bit integers."""

    def emit(batches: Iterator) -> Iterator:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            data, offsets = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4"), ids.offsets.to_numpy().tolist()
            sums = [zlib.crc32(data[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(emit, "doc_id long, start long, n_tokens long, ids_crc32 long")
