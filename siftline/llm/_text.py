"""Vectorised text primitives shared by the operators: words as 64-bit hashes, rolling hashes, byte-bounded chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow.compute as pc

from ..functions.batches import give_back, stretches

#: Fixed odd multipliers of the polynomial and finalising hashes.
P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
CHUNK_BYTES = 3 << 20
#: Bytes of text whose words are hashed at once where workers must stay small; hashing takes several 64-bit arrays of that length.
HASHED_BYTES = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * Q)

_powers: dict[str, np.ndarray] = {}
#: A worker keeps so many powers of each kind at most.
MOST_POWERS = 4 << 20


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P (or its inverse) to the 0th ... nth power modulo 2^64; those of very long texts are not kept."""
    name = "inv" if inverse else "pow"
    have = _powers.get(name)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), P_INV if inverse else P, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= MOST_POWERS:
            _powers[name] = have
    return have[: n + 1]


def range_hashes(units: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of units[lo:hi] for each pair, equal for equal contents wherever they stand."""
    total = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum(units * powers(len(units))[:-1], out=total[1:])
    return mix((total[hi] - total[lo]) * powers(len(units), inverse=True)[lo] + (hi - lo).astype(np.uint64) * Q)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(Q), n, 1 << 64))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of units[i:i+k] for each i."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    have, size, out, length = units, 1, None, 0  # hashes of all strings of `size` and, of the lower bits of k, of `length`
    while True:
        if k & size:
            out = have if out is None else have[: len(out) - size] * _power(length) + out[size:]
            length += size
        if length == k:
            return mix(out[:n])
        have = have[:-size] * _power(size) + have[size:]
        size *= 2


_NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_bounds(data: np.ndarray, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space (20, 09-0D); terms: of those of ASCII letters, digits and other characters."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~(_NO_TERM if terms else _WHITE)[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[bytes], lower: bool = False, terms: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data, terms)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return range_hashes(BYTE_CODES[data], starts, ends), np.searchsorted(starts, begins)


def chunks(batches: Iterable, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[object, list[bytes]]]:
    """Slices of Arrow batches whose binary column `text` has about limit bytes (a longer row stands alone), with that column's values (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for lo, hi in stretches(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), limit):
            part = batch.slice(lo, hi - lo)
            yield part, [v or b"" for v in part.column(at).to_pylist()]
    give_back()


def column(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
