"""Alignment of two tokenizers by a dangling-suffix transducer, and how often their ids end together in a corpus.

Both token sequences spell the same bytes. The transducer's state is which side leads and the bytes by which it does; the next token is always the other side's,
and either shortens those bytes or takes the lead. Transitions are remembered by state and token. Where no bytes are left over, both sides' tokens end: a group closes, and
its last two tokens are linked.

Neither tokenizer's tokens cross the place before a blank that follows other than white space, nor that between an ASCII letter and a digit or mark (but an apostrophe), so texts
are cut there and each distinct piece is aligned once.

Two ids can only be linked if the bytes of one end with those of the other, so the vocabularies alone bound the number of id pairs (a few hundred thousand,
however large the corpus). The counts are summed in Spark; only this bounded table is broadcast.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import Memo, distinct_pieces, per_text, spread, valid
from ._store import work_table
from ._text import chunks
from .bpe_stream import _bytes_of_letters
from .token_output import piece_starts

TEXT_BYTES = 1 << 20
_LETTERS, _MARKS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MARKS[[i for i in range(33, 127) if not _LETTERS[i] and i != 39]] = True
_MIXED = re.compile(r"[A-Za-z][!-&(-@\[-`{-~]|[!-&(-@\[-`{-~][A-Za-z]")
MOST_TRANSITIONS = 200_000
_DIFFERENT = (0, 0, 0, "", b"")
_aligners: dict[tuple[str, str], Aligner] = {}


def byte_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, ids = _bytes_of_letters(), told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


def piece_vocabulary(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a blank, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    name = model.id_to_piece
    return [bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(model.vocab_size())]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can be linked: those of which one's bytes end with the other's."""
    held_a, held_b = {}, {}
    for held, side in ((held_a, a), (held_b, b)):
        for x in side:
            held[x] = held.get(x, 0) + 1
    ends = lambda side, held, first: sum(held.get(x[k:], 0) for x in side for k in range(first, len(x)))
    return ends(a, held_b, 0) + ends(b, held_a, 1)


class Transducer:
    """States are numbers of (whether A leads, the bytes by which), 0 of none; they are suffixes of tokens, and so bounded."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides = (b, a)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.states, self.moves = {(True, b""): 0}, [(True, b"")], {}

    def _move(self, state: int, token: int) -> int:
        """The state after the lagging side's next token; -1 if the bytes differ."""
        leads, rest = self.states[state]
        new = self.sides[0 if leads and rest else 1][token]
        if not rest:
            after = (True, new)
        elif rest.startswith(new):
            after = (leads, rest[len(new) :])
        elif new.startswith(rest):
            after = (not leads, new[len(rest) :])
        else:
            return -1
        after = after if after[1] else (True, b"")
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """For each group the numbers of tokens of A and B up to its end; None if the two don't spell the same bytes."""
        if len(self.moves) > MOST_TRANSITIONS:
            self._forget()
        out, i, j, state = [], 0, 0, 0
        while i < len(a) or j < len(b) or state:
            if state == 0 or not self.states[state][0]:  # A's turn
                if i == len(a):
                    return None
                token, i = a[i], i + 1
            else:
                if j == len(b):
                    return None
                token, j = b[j], j + 1
            key = (state, token)
            after = self.moves.get(key)
            if after is None:
                after = self.moves[key] = self._move(state, token)
            if after < 0:
                return None
            state = after
            if state == 0:
                out.append((i, j))
        return out


class Aligner:
    """Both tokenizers and the transducer between them."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a, self.b = byte_vocabulary(byte_file), piece_vocabulary(piece_file)
        told = json.loads(self.first.to_str())
        rule = told["pre_tokenizer"] or {}
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        # only of these kinds is it known that no token crosses a cut
        blank, kept = "▁", self.second.encode("a  b ", out_type=str)
        if told["normalizer"] or rule.get("type") != "ByteLevel" or not rule.get("use_regex") or rule.get("add_prefix_space") or any(blank in n.lstrip(blank) for n in names) or "".join(kept) != f"{blank}a{blank * 2}b{blank}":
            raise ValueError("tokenizers that can't be aligned piece by piece")
        self.blank = self.second.encode("a ")[-1]
        # what stands before a piece that doesn't begin with a blank, and how many tokens that has
        self.before = {True: (",", len(self.second.encode(","))), False: ("a", len(self.second.encode("a")))}
        kinds = (self.second.is_byte, self.second.is_control, self.second.is_unknown)
        self.fine = not any(_MIXED.search(n) for i, n in enumerate(names) if not any(k(i) for k in kinds))
        self.written = [str(i) for i in range(max(len(self.a), len(self.b)))]
        self.transducer = Transducer(self.a, self.b)
        self.memo = Memo(self._work)

    @staticmethod
    def of(byte_file: str, piece_file: str) -> Aligner:
        key = (byte_file, piece_file)
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        return _aligners[key]

    def _work(self, pieces: list[str]) -> list[tuple]:
        """For each piece: tokens of A, of B, groups, the groups as text, and the linked pairs, each a * (size of B) + b, as bytes; _DIFFERENT if the bytes are."""
        out = []
        for i in range(0, len(pieces), 1024):
            part = pieces[i : i + 1024]
            firsts = self.first.encode_batch_fast(part, add_special_tokens=False)
            # the model puts a blank of its own before each; where the text has none, the piece stands behind one that can't be merged with it
            led = [("", 0) if p[0] == " " else self.before[p[0].isalpha()] for p in part]
            seconds = self.second.encode([p[1:] if p[0] == " " else c + p for p, (c, _) in zip(part, led, strict=True)], num_threads=1)
            out += [self._aligned(p, f.ids, s[k:] if p != " " else [self.blank]) for p, f, s, (_, k) in zip(part, firsts, seconds, led, strict=True)]
        return out

    def _aligned(self, piece: str, a: list[int], b: list[int]) -> tuple:
        groups = self.transducer.groups(a, b)
        if groups is None or b"".join(map(self.a.__getitem__, a)) != piece.encode():
            return _DIFFERENT
        written, size = self.written, len(self.b)
        texts, links, i, j = [], [], 0, 0
        for p, q in groups:
            x, y = a[p - 1], b[q - 1]
            texts.append(f"{x}|{y}" if p - i == q - j == 1 else ",".join(map(written.__getitem__, a[i:p])) + "|" + ",".join(map(written.__getitem__, b[j:q])))
            links.append(x * size + y)
            i, j = p, q
        return len(a), len(b), len(groups), ";".join(texts), struct.pack(f"={len(links)}q", *links)

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of each text: tokens of A, of B, groups (links) and their text; and all linked pairs one after another."""
        texts = [valid(t) for t in texts]
        data, begins = b"".join(b" " + t for t in texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
        flat = np.frombuffer(data, dtype=np.uint8)
        starts = piece_starts(flat, begins)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[begins] = True
        starts = starts[(flat[starts] == 32) | first[starts]]
        if self.fine:
            letters, marks = _LETTERS[flat], _MARKS[flat]
            first[1:-1] |= letters[:-1] & marks[1:] | marks[:-1] & letters[1:]
            first[starts] = True
            starts = np.flatnonzero(first[:-1])
        which, pieces = distinct_pieces(data, starts)
        made = self.memo.of(pieces)
        cut = np.searchsorted(starts, begins)
        good = per_text(np.fromiter((m is _DIFFERENT for m in made), np.int64, len(made))[which], cut) == 0
        good &= np.fromiter(map(bool, texts), bool, len(texts))
        kept = np.repeat(good, np.diff(cut))
        which = which[kept]
        cut = np.concatenate([[0], np.cumsum(np.diff(cut) * good)])
        sums = [per_text(np.fromiter((m[k] for m in made), np.int64, len(made))[which], cut) for k in range(3)]
        names, at = [m[3] for m in made], which.tolist()
        written = [";".join(map(names.__getitem__, at[lo:hi])) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        sizes = np.fromiter((m[2] for m in made), np.int64, len(made))
        return *sums, written, spread(np.frombuffer(b"".join(m[4] for m in made), dtype=np.int64), sizes, which)


def align(docs: DataFrame, byte_file: str, piece_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`) and links (array of a * vocabulary of B + b) of every row.

    Null or empty texts, and those whose tokens of either side don't spell a blank and the text, have none: zeros, empty text and list. Repeated rows and null doc_id are returned as
    they are; other columns, whatever their names, are left out. No shuffle.
    """

    def emit(batches: Iterator) -> Iterator:
        aligner = Aligner.of(byte_file, piece_file)
        for batch, texts in chunks(batches, "data", TEXT_BYTES):
            n_a, n_b, n_groups, groups, links = aligner.align(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32)), pa.array(links))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), lists], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(emit, "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n and best: how often each pair is linked in all rows, and whether no pair with its B id is more often. Counts are summed before they are shuffled; no more rows than most_pairs."""
    counts = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    highest = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(highest, F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """aligned with n_links, n_best (links whose count is the highest of their B id) and count_sum instead of links. counts has at most `bound` rows."""
    table = counts.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"more than {bound} id pairs")
    pairs = table.column("pair").to_numpy()
    order = np.argsort(pairs)
    shared = aligned.sparkSession.sparkContext.broadcast((pairs[order], table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]))

    def emit(batches: Iterator) -> Iterator:
        pairs, n, best = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("links")
            links = batch.column(at)
            offsets = links.offsets.to_numpy()
            where = np.searchsorted(pairs, links.values.to_numpy()[offsets[0] : offsets[-1]])
            cut = offsets - offsets[0]
            made = [pa.array(np.diff(cut).astype(np.int64)), pa.array(per_text(best[where], cut)), pa.array(per_text(n[where], cut))]
            kept = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], [*(batch.schema.names[k] for k in kept), "n_links", "n_best", "count_sum"])

    return aligned.mapInArrow(emit, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links"] + ["n_links long", "n_best long", "count_sum long"]))


def align_and_count(docs: DataFrame, byte_file: str, piece_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (empty without tokens) of every row; see align. Rows are tokenized once, into a work table without the groups' texts."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    table = work_table(align(docs, byte_file, piece_file, doc_id, text).select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
    a, b = byte_vocabulary(byte_file), piece_vocabulary(piece_file)
    out = score_links(table, pair_counts(table, len(b)), most_pairs(a, b))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
