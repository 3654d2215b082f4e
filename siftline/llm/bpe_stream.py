"""BPE as a streaming transducer with bounded lookahead, and decoding by an incremental byte-to-text state machine.

Merges in order of rank, leftmost first. How far back a text's continuation can change its tokens is bounded by the merge list alone: whenever a rule
(u, v) acts on one continuation and not on the other, the common tokens end one token u earlier, and the next such rule has a higher rank and a right part that begins with
that u. The longest such chain, summed over the lengths of its u, is how far back a change can reach. A token that ends so many symbols before the last one read is
final and is emitted; what follows starts anew behind it. The first token that isn't final may begin a token's length earlier, so the sufficient lookahead is that reach and
the longest token but one symbol; a word of any length needs a buffer of one block and the lookahead.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import Memo, distinct_pieces, spread, valid
from ._text import chunks

#: Symbols read before stable tokens are looked for.
BLOCK = 1024
#: Strings of so many symbols are merged by looking over all their pairs each time, longer ones by a heap.
SHORT = 48
NEVER = 1 << 62
_NONE = (NEVER, -1)
#: Bytes of text encoded at once, and tokens decoded at once.
TEXT_BYTES, DECODED_TOKENS = 1 << 20, 1 << 18
#: Pieces whose ids a worker keeps, up to twice as many; each takes some 200 bytes.
KEPT_PIECES = 250_000
# Fixed value: the pattern of words by which it is known that letters, digits and marks are apart, and that only an apostrophe can join them.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_transducers: dict[str, TextTransducer] = {}
_KINDS = np.zeros(256, dtype=np.uint8)  # of ASCII bytes: white space 1, letters 2, digits 3, other marks 4; apostrophes and other bytes 0
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[[*range(65, 91), *range(97, 123)]] = 2
_KINDS[48:58] = 3
_KINDS[[i for i in range(128) if not _KINDS[i] and i != 39]] = 4


class Merges:
    """A merge list over token ids: ranks, how far back a continuation reaches, and the lookahead that suffices for it."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        self.reach = 0
        made_by: dict[int, int] = {}
        left: dict[int, int] = {}
        length: dict[int, int] = {}
        longest: dict[int, int] = {}  # of the chains so far that end with a rule whose left part is this token
        for rank, (a, b) in enumerate(merges):
            u, v, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rules.setdefault((u, v), (rank, whole))
            if whole not in made_by:
                made_by[whole], left[whole], length[whole] = rank, u, length.get(u, 1) + length.get(v, 1)
            chain, spine = 0, v
            while spine is not None:
                chain, spine = max(chain, longest.get(spine, 0)), left.get(spine)
            longest[u] = max(longest.get(u, 0), chain + length.get(u, 1))
            self.reach = max(self.reach, longest[u])
        #: whether parts are made before they are used, on which the bound rests
        self.proper = all(made_by.get(x, -1) < rank for pair, (rank, _) in self.rules.items() for x in pair) and len({w for _, w in self.rules.values()}) == len(self.rules)
        self.length = length
        self.lookahead = self.reach + max(length.values(), default=1) - 1

    def merge(self, units: list[int]) -> list[int]:
        """The tokens of a string of symbols: of all pairs of neighbours the one of least rank is merged, of equal ones the leftmost, until there is none."""
        rules, ids, n = self.rules, list(units), len(units)
        if n <= SHORT:
            ranks = [rules.get(pair, _NONE)[0] for pair in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [rules[ids[i], ids[i + 1]][1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rules.get((ids[i], ids[i + 1]), _NONE)[0]
                if i:
                    ranks[i - 1] = rules.get((ids[i - 1], ids[i]), _NONE)[0]
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, whole) for rank, whole, i in heap]
        heapify(heap)
        while heap:
            rank, i, whole = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rules.get((ids[i], ids[j])) != (rank, whole):
                continue
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := rules.get((whole, ids[k])):
                    heappush(heap, (r[0], i, r[1]))
            h = before[i]
            if h >= 0 and (r := rules.get((ids[h], whole))):
                heappush(heap, (r[0], h, r[1]))
        return [x for x in ids if x >= 0]


class WordStream:
    """One word's symbols in, its tokens out as soon as no further symbol can change them."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.held = merges, block, []

    def feed(self, units: list[int]) -> list[int]:
        self.held += units
        if len(self.held) < self.block + self.merges.lookahead or not self.merges.proper:
            return []
        out, end, stable = [], 0, len(self.held) - self.merges.reach
        for token in self.merges.merge(self.held):
            length = self.merges.length.get(token, 1)
            if end + length > stable:
                break
            out.append(token)
            end += length
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), []
        return out


class ByteToText:
    """Bytes in, characters out as soon as they are whole; what can't be UTF-8 becomes the replacement character, as far as it is one."""

    def __init__(self):
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, last: bool = False) -> str:
        return self.state.decode(data, last)


def _bytes_of_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 characters stand for themselves, the others, in order, for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextTransducer:
    """Ids of texts and texts of ids by a byte-level BPE file whose pre-tokens never hold white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tools = Tokenizer.from_file(path)  # its normaliser and its splitting into words; merging is done here
        told = json.loads(self.tools.to_str())
        model = told["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"not a plain BPE file: {path}")
        self.vocabulary = model["vocab"]
        self.merges = Merges(self.vocabulary, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.word_end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {i: t for t, i in (self.vocabulary | self.added).items()}
        letters = _bytes_of_letters()
        # without a decoder, tokens are written as they are, with blanks between
        self.between = b"" if told["decoder"] else b" "
        as_bytes = lambda t: bytes(letters[c] for c in t) if told["decoder"] and all(c in letters for c in t) else t.encode()
        written = [self.between + as_bytes(names.get(i, "")) for i in range(max(names) + 1)]
        self.written, self.sizes = np.frombuffer(b"".join(written), dtype=np.uint8), np.array([len(w) for w in written], dtype=np.int64)
        # where it is known how the file splits texts, they are cut at every such place, and plain letters are one word
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.split = steps[0].get("pattern") == {"Regex": WORDS} and steps[0].get("invert") and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.lowers = self.split and self.tools.normalizer is not None and self.tools.normalizer.normalize_str(letters) == letters.lower()
        self.words: dict[str, list[int]] = {}
        self.memo = Memo(lambda pieces: [(np.array(self.piece(p), dtype="<u4").tobytes(),) for p in pieces], KEPT_PIECES)

    @staticmethod
    def of(path: str) -> TextTransducer:
        if path not in _transducers:
            _transducers[path] = TextTransducer(path)
        return _transducers[path]

    def word(self, word: str) -> Iterator[int]:
        """A pre-token's ids, block by block; its last symbol carries the end of the word."""
        stream, last = WordStream(self.merges), len(word) - 1
        for i in range(0, len(word), BLOCK):
            part = [self.vocabulary.get(c + self.word_end if i + k == last else c) for k, c in enumerate(word[i : i + BLOCK])]
            yield from stream.feed([x for x in part if x is not None])
        yield from stream.finish()

    def piece(self, piece: str) -> list[int]:
        if self.lowers and len(piece) <= SHORT and piece.isascii() and piece.isalpha():
            return self.merges.merge([self.vocabulary[c] for c in piece[:-1].lower()] + [self.vocabulary[piece[-1].lower() + self.word_end]])
        out: list[int] = []
        for part in self.marks.split(piece) if self.marks else [piece]:
            if part in self.added:
                out.append(self.added[part])
                continue
            if self.tools.normalizer and part:
                part = self.tools.normalizer.normalize_str(part)
            for word, _ in self.tools.pre_tokenizer.pre_tokenize_str(part) if part else ():
                ids = self.words.get(word)
                if ids is None:
                    ids = list(self.word(word))
                    if len(word) <= 64:
                        if len(self.words) > 50_000:
                            self.words = {}
                        self.words[word] = ids
                out += ids
        return out

    @staticmethod
    def cuts(data: np.ndarray, begins: np.ndarray, fine: bool) -> np.ndarray:
        """Where no word goes on: at ASCII white space and, if fine, between ASCII letters, digits and marks; and at the texts' first bytes."""
        kinds = _KINDS[data]
        before, after = kinds[:-1], kinds[1:]
        at = np.zeros(len(data), dtype=bool)
        at[1:] = (before != after) & ((before == 1) | (after == 1) | (fine & (before > 0) & (after > 0)))
        at[begins[:-1][np.diff(begins) > 0]] = True
        return np.flatnonzero(at)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8) one after another, and how many each text has."""
        texts = [valid(t) for t in texts]
        data, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
        if not data:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        starts = self.cuts(np.frombuffer(data, dtype=np.uint8), begins, self.split and not any(t.encode() in data for t in self.added))
        which, pieces = distinct_pieces(data, starts)
        ids = [x for (x,) in self.memo.of(pieces)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = np.concatenate([[0], np.cumsum(sizes[which])])
        return spread(np.frombuffer(b"".join(ids), dtype="<u4"), sizes, which), np.diff(counts[np.searchsorted(starts, begins)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, some at a time."""
        state, out = ByteToText(), []
        for i in range(0, len(ids), DECODED_TOKENS):
            part = spread(self.written, self.sizes, ids[i : i + DECODED_TOKENS].astype(np.int64)).tobytes()
            out.append(state.feed(part if i else part[len(self.between) :]))
        return "".join([*out, state.feed(b"", True)])


def encode_and_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit integers, little-endian, as binary) and decoded (the text of the ids) of every row, without special tokens added.

    Added tokens of the file that stand in a text are ids of their own, as the file has it. Null or empty text: no ids, decoded empty. Repeated rows and null doc_id are returned as
    they are; other columns, whatever their names, are left out. No shuffle; a worker's memory is bounded by a row's text and its tokens.
    """

    def emit(batches: Iterator) -> Iterator:
        made = TextTransducer.of(tokenizer)
        for batch, texts in chunks(batches, "data", TEXT_BYTES):
            ids, counts = made.encode(texts)
            cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
            parts = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([made.decode(p) for p in parts], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(emit, "doc_id long, n_tokens long, ids binary, decoded string")
