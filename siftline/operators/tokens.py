"""Tokenizers by name, each giving ids and character offsets: characters, words, a vocabulary of a text file, a file of the tokenizers library. Register further ones."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.batches import by_stretches

TOKENS = "array<struct<id:bigint,start:int,end:int>>"


class Tokenizer(Protocol):
    """ids, starts and ends (characters, end exclusive) of the tokens of each text."""

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]: ...


_factories: dict[str, Callable[[str | None], Tokenizer]] = {}
_made: dict[tuple[str, str | None], Tokenizer] = {}


def register(name: str, factory: Callable[[str | None], Tokenizer]) -> None:
    """factory(path) makes a tokenizer; path: of its vocabulary, if it has one, on every worker."""
    _factories[name] = factory


def get(name: str, path: str | None = None) -> Tokenizer:
    if (name, path) not in _made:
        if name not in _factories:
            raise ValueError(f"no tokenizer {name}; there are {', '.join(sorted(_factories))}")
        _made[name, path] = _factories[name](path)
    return _made[name, path]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _chars(_: str | None) -> Tokenizer:
    return lambda texts: [(p.astype(np.int64), np.arange(len(p)), np.arange(1, len(p) + 1)) for p in map(_points, texts)]


def _words(_: str | None) -> Tokenizer:
    """Runs without blanks and line feeds; an id is the sum of the word's characters with their weights, so equal words have equal ids."""

    def tokens(text: str) -> tuple:
        p = _points(text)
        inside = np.zeros(len(p) + 2, dtype=np.int8)
        inside[1:-1] = (p != 32) & (p != 10)
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        place = np.arange(len(p)) - np.repeat(starts, ends - starts)[np.cumsum(inside[1:-1]) - 1] if len(starts) else np.zeros(len(p), dtype=np.int64)
        weight = (place % 61 + 1) ** 5 * inside[1:-1]
        upto = np.concatenate([[0], np.cumsum(p.astype(np.int64) * weight)])
        return upto[ends] - upto[starts], starts, ends

    return lambda texts: [tokens(t) for t in texts]


def _vocabulary(path: str | None) -> Tokenizer:
    """The longest entry of the file (an entry a line, its id the line's number from 0) that goes on from each place; a character that begins none has id -1."""
    with open(path, encoding="utf-8") as f:
        entries = {line.rstrip("\n"): i for i, line in enumerate(f)}
    entries.pop("", None)
    lengths: dict[str, list[int]] = {}
    for e in entries:
        lengths.setdefault(e[0], []).append(len(e))
    lengths = {c: sorted(set(n), reverse=True) for c, n in lengths.items()}

    def tokens(text: str) -> tuple:
        at, out = 0, []
        while at < len(text):
            n = next((n for n in lengths.get(text[at], ()) if text[at : at + n] in entries), None)
            out.append((-1 if n is None else entries[text[at : at + n]], at, at + (n or 1)))
            at += n or 1
        return tuple(np.array(out, dtype=np.int64).reshape(-1, 3).T)

    return lambda texts: [tokens(t) for t in texts]


def _library(path: str | None) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer as Library

    made = Library.from_file(path)

    def encode(texts: list[str]) -> list[tuple]:
        found = made.encode_batch(texts, add_special_tokens=False)
        return [(np.array(e.ids, dtype=np.int64), *np.array(e.offsets, dtype=np.int64).reshape(-1, 2).T) for e in found]

    return encode


for _name, _factory in (("char", _chars), ("word", _words), ("vocabulary", _vocabulary), ("tokenizers", _library)):
    register(_name, _factory)


def tokens(text: Column | str, tokenizer: str, path: str | None = None) -> Column:
    """An array of (id, start, end), stretch by stretch of a batch; null or empty text: none. The windows of chunks.token_windows take it as it is."""

    def encode(column: pa.Array) -> pa.Array:
        found = get(tokenizer, path)([t or "" for t in column.to_pylist()])
        cut = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
        parts = [np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(x[k]) for x in found)]) for k in range(3)]
        return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(parts[0].astype(np.int64)), *(pa.array(p.astype(np.int32)) for p in parts[1:])], ["id", "start", "end"]))

    def stretched(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return by_stretches(encode, columns)

    return F.arrow_udf(stretched, TOKENS)(text)


@udtf
class TokenRows:
    """tokenize(text, tokenizer, path, with_text), for LATERAL: a row a token. What it returns depends on the arguments: with_text adds the token's characters."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tokenizer: AnalyzeArgument, path: AnalyzeArgument | None = None, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if tokenizer.value not in _factories:
            raise ValueError(f"no tokenizer {tokenizer.value}; there are {', '.join(sorted(_factories))}")
        schema = StructType().add("n", IntegerType()).add("id", LongType()).add("start", IntegerType()).add("end", IntegerType())
        return AnalyzeResult(schema.add("token", StringType()) if with_text is not None and with_text.value else schema)

    def eval(self, text: str, tokenizer: str, path: str | None = None, with_text: bool = False) -> Iterator[tuple]:
        text = text or ""
        for n, row in enumerate(zip(*(x.tolist() for x in get(tokenizer, path)([text])[0]), strict=True)):
            yield (n, *row, text[row[1] : row[2]]) if with_text else (n, *row)
