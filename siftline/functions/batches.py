"""Arrow batches in stretches of bounded bytes: Spark bounds a batch by its rows, while what a function needs beside a text is a multiple of its length."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer row stands alone.
STRETCH = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library, which has no such call
    _libc = None


def stretches(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of consecutive rows, that of a single row apart of no more than limit in all."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Hands memory that a task no longer needs back to the system: workers outlive their tasks, and several of them share a machine."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def text_stretches(text: pa.Array, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    return stretches(pc.fill_null(pc.binary_length(text), 0).to_pylist(), limit)


def by_stretches(made: Callable[..., pa.Array], batches: Iterable, limit: int = STRETCH) -> Iterator[pa.Array]:
    """made(text, ...) over columns or tuples of columns, in stretches of their first column, a text: for iterator forms of arrow_udf, which may return a batch in parts."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for lo, hi in text_stretches(columns[0], limit):
            yield made(*(c.slice(lo, hi - lo) for c in columns))
    give_back()
