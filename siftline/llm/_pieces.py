"""Texts as ranges of distinct pieces: what is worked out for a piece holds for all its occurrences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Pieces of more characters are never kept.
LONG_PIECE = 1 << 10


def distinct_pieces(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """data (UTF-8) cut at starts (the first 0): the number of each piece among the distinct ones, and these."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_pylist()


class Memo:
    """What `work` gives for lists of new pieces, remembered in two generations: when the younger has `kept` of them it becomes the older, and what is used again moves on."""

    def __init__(self, work: Callable[[list[str]], list], kept: int = 100_000):
        self.work, self.kept, self.young, self.old = work, kept, {}, {}

    def of(self, pieces: list[str]) -> list:
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(p) or old.get(p) for p in pieces]
        at = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(at, self.work([pieces[i] for i in at]), strict=True):
            out[i] = x
        young.update((p, x) for p, x in zip(pieces, out, strict=True) if len(p) <= LONG_PIECE)
        return out


def spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of lists one after another in flat, with sizes: those of the numbers `which`, one after another."""
    begins, counts = np.cumsum(sizes) - sizes, sizes[which]
    upto = np.cumsum(counts)
    return flat[np.repeat(begins[which] - upto + counts, counts) + np.arange(upto[-1] if len(upto) else 0)]


def per_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; cut: where each text's pieces begin, and the end."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cut])


def valid(text: bytes) -> bytes:
    """The text, what is no UTF-8 replaced."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text
