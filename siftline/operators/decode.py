"""Best tag sequences of linear-chain fields by (max, +) products: rows of a batch in lockstep, and long sequences in blocks that any task can take.

A block of a sequence is a matrix: the best score from the tag before it to each tag at its end. Such matrices are multiplied in any grouping, so blocks are worked on apart, joined by their
products, and worked on again with what comes in from the left; the way back is a composition of small maps, block by block, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import written

#: Steps of a sequence that are taken in lockstep with others'; longer ones are cut into blocks of so many.
BLOCK = 4096


def product(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The matrix of a block: from each tag before it to each at its end."""
    out = transitions + emissions[0]
    for row in emissions[1:]:
        out = (out[:, :, None] + transitions[None]).max(1) + row
    return out


def forward(entry: np.ndarray | None, first: np.ndarray, emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the tags at the end of a block, and for each step the best tag before each tag (of equal ones the lower). entry: the scores before it; None where the sequence begins, with first for start scores."""
    back = np.zeros(emissions.shape, dtype=np.int32)
    score = entry
    for i, row in enumerate(emissions):
        if score is None:
            score = first + row
            continue
        paths = score[:, None] + transitions
        back[i] = paths.argmax(0)
        score = paths.max(0) + row
    return score, back


def origin(back: np.ndarray) -> np.ndarray:
    """For each tag at the end of a block the tag before it on the best way."""
    tags = np.arange(back.shape[1])
    for row in back[::-1]:
        tags = row[tags]
    return tags


def way(back: np.ndarray, last: int) -> np.ndarray:
    tags = np.empty(len(back), dtype=np.int32)
    for i in range(len(back) - 1, -1, -1):
        tags[i], last = last, back[i, last]
    return tags


def viterbi_batch(emissions: list[np.ndarray], transitions: list[np.ndarray], start: list[np.ndarray], end: list[np.ndarray]) -> list[np.ndarray]:
    """The best tag sequences of several fields with the same number of tags, step by step for all of them at once. Longest first, so those that go on are a prefix of the rows."""
    order = sorted(range(len(emissions)), key=lambda k: -len(emissions[k]))
    sizes = np.array([len(emissions[k]) for k in order])
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, dtype=np.int32)] * len(emissions)
    tags = emissions[order[0]].shape[1]
    flat = np.concatenate([emissions[k] for k in order if len(emissions[k])])
    offset = np.cumsum(sizes) - sizes
    t, z = np.stack([transitions[k] for k in order]), np.stack([end[k] for k in order])
    active = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left")  # rows with more than so many steps
    n = active[0]
    score = np.full((len(order), tags), -np.inf)
    score[:n] = np.stack([start[k] for k in order])[:n] + flat[offset[:n]]
    back = []
    for i in range(1, sizes[0]):
        n = active[i]
        paths = score[:n, :, None] + t[:n]
        back.append(paths.argmax(1).astype(np.int8 if tags < 128 else np.int32))
        score[:n] = paths.max(1) + flat[offset[:n] + i]
    last = (score + z).argmax(1)
    out = np.zeros(len(flat), dtype=np.int32)
    for i in range(sizes[0] - 1, -1, -1):
        n = active[i]
        out[offset[:n] + i] = last[:n]
        if i:
            last[:n] = np.take_along_axis(back[i - 1], last[:n, None].astype(np.int64), 1)[:, 0]
    found = [out[a : a + m] for a, m in zip(offset.tolist(), sizes.tolist(), strict=True)]
    return [found[k] for k in np.argsort(order).tolist()]


def _rows(values) -> list[np.ndarray | None]:
    return [None if v is None else np.array([list(x) if isinstance(x, (list, np.ndarray)) else x for x in v], dtype=float) for v in values]


def _decoded(emissions: pd.Series, transitions: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    parts = [_rows(x) for x in (emissions, transitions, start, end)]
    out: list = [None] * len(emissions)
    kinds: dict[int, list[int]] = {}
    for k, row in enumerate(zip(*parts, strict=True)):
        if all(x is not None for x in row):
            kinds.setdefault(len(row[2]), []).append(k)
    for tags, at in kinds.items():
        at.sort(key=lambda k: len(parts[0][k]))
        shaped = [[p[k].reshape(-1, tags) if which == 0 else p[k] for k in at] for which, p in enumerate(parts)]
        for k, found in zip(at, viterbi_batch(*shaped), strict=True):
            out[k] = found.tolist()
    return pd.Series(out)


def viterbi_udf(emissions: Column | str, transitions: Column, start: Column, end: Column) -> Column:
    """The best tags of each row's field; of equally good ways the lower tag where they part last. Null where an argument is null, none of no steps. Sequences far longer than a row should be go to decode_blocks."""
    return F.pandas_udf(_decoded, "array<int>")(emissions, transitions, start, end)


def _arrays(batch, name: str, tags: int) -> list[np.ndarray]:
    return [np.array(v, dtype=float).reshape(-1, tags) for v in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _lockstep(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each step, which of several runs of steps still have it (longest first) and so where it lies in their concatenation."""
    order, offset = np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes
    for i in range(sizes.max(initial=0)):
        at = order[: np.searchsorted(-sizes[order], -i, side="left")]
        yield i, at, offset[at] + i


def _scanned(batches: Iterator, keys: list[str], step, begin, *width: int) -> Iterator[tuple]:
    """Batches of rows that come sorted by keys, each with what step(batch) left before its rows: sequences in lockstep, and what a sequence leaves at a batch's end goes on in the next one.

    begin(batch, rows) is what the first rows of sequences leave, step(batch, rows, before) what others do.
    """
    known, carried = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            codes = c.dictionary_encode("encode").indices.to_numpy()
            fresh[1:] |= codes[1:] != codes[:-1]
        own = [c[0].as_py() for c in columns]
        fresh[0] = first = own != known
        starts = np.flatnonzero(fresh) if first else np.concatenate([[0], np.flatnonzero(fresh)])
        sizes = np.diff(np.append(starts, batch.num_rows))
        before, state = np.zeros((batch.num_rows, *width)), np.zeros((len(starts), *width))
        if not first:
            state[0] = carried
        for i, runs, rows in _lockstep(sizes):
            new = fresh[rows] if i == 0 else np.zeros(len(rows), dtype=bool)
            before[rows] = state[runs]
            if new.any():
                state[runs[new]] = begin(batch, rows[new])
            if not new.all():
                state[runs[~new]] = step(batch, rows[~new], state[runs[~new]])
        after = np.empty_like(before)
        after[:-1], after[-1] = before[1:], state[-1]
        ends = np.append(starts[1:], batch.num_rows) - 1
        after[ends] = state
        known, carried = [c[batch.num_rows - 1].as_py() for c in columns], state[-1]
        yield batch, fresh, before, after


def _matrix(batch, name: str, *shape: int) -> np.ndarray:
    """A column of arrays of one length."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _steps(batch, tags: int) -> tuple[np.ndarray, np.ndarray]:
    """The emissions of a batch's blocks as rows of one array, and how many each block has."""
    column = batch.column(batch.schema.get_field_index("emissions"))
    flat = column.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, tags)
    return flat, np.diff(column.offsets.to_numpy())


def decode_blocks(blocks: DataFrame, transitions: list, start: list, end: list, keys: list[str], block: str = "block", emissions: str = "emissions") -> DataFrame:
    """keys, block and tags of sequences that come as blocks (keys, block: in order, emissions: an array of a score for each tag a step, not empty), of any length, in three passes over them.

    Between the passes a row a block meets at its sequence: a matrix of scores on the way there, a map of tags on the way back; sorted rows go by, so neither a sequence nor a key's rows have to fit
    in memory, and the blocks of a batch are worked on in lockstep. Where scores are not whole or dyadic numbers, ways that are equally good but for rounding may be told apart otherwise than step by step.
    """
    t, a, z = (np.array(x, dtype=float) for x in (transitions, start, end))
    tags = len(a)
    rows = blocks.select(*keys, F.col(block).cast("long").alias("block"), F.col(emissions).cast("array<array<double>>").alias("emissions"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", block long"
    named = [*keys, "block"]

    def kept(batch, **more) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in named), *more.values()], [*named, *more])

    def matrices(batches: Iterator) -> Iterator:
        """whole: from each tag before a block to each at its end; begun: scores at its end if the sequence begins with it."""
        for batch in batches:
            flat, sizes = _steps(batch, tags)
            whole, begun = np.zeros((len(sizes), tags, tags)), np.zeros((len(sizes), tags))
            for i, at, rows in _lockstep(sizes):
                e = flat[rows]
                whole[at] = t + e[:, None] if i == 0 else (whole[at][:, :, :, None] + t).max(2) + e[:, None]
                begun[at] = a + e if i == 0 else (begun[at][:, :, None] + t).max(1) + e
            yield kept(batch, whole=_lists(whole), begun=_lists(begun))

    def enter(batches: Iterator) -> Iterator:
        """The scores before each block (none where the sequence begins), and the best tag if it ends with it."""
        begin = lambda batch, rows: _matrix(batch, "begun", tags)[rows]
        step = lambda batch, rows, score: (score[:, :, None] + _matrix(batch, "whole", tags, tags)[rows]).max(1)
        for batch, fresh, before, after in _scanned(batches, keys, step, begin, tags):
            yield kept(batch, fresh=pa.array(fresh), entry=_lists(before), final=pa.array((after + z).argmax(1).astype(np.int32)))

    def backs(batch) -> tuple[np.ndarray, np.ndarray]:
        """For each step the best tag before each tag (of equal ones the lower), and the sizes of the blocks."""
        flat, sizes = _steps(batch, tags)
        fresh, score = batch.column(batch.schema.get_field_index("fresh")).to_numpy(zero_copy_only=False), _matrix(batch, "entry", tags).copy()
        back = np.zeros(flat.shape, dtype=np.int32)
        for i, at, rows in _lockstep(sizes):
            paths = score[at][:, :, None] + t
            back[rows], score[at] = paths.argmax(1), paths.max(1) + flat[rows]
            if i == 0:
                new = fresh[at]
                back[rows[new]], score[at[new]] = 0, a + flat[rows[new]]
        return back, sizes

    def maps(batches: Iterator) -> Iterator:
        for batch in batches:
            back, sizes = backs(batch)
            found = np.zeros((len(sizes), tags), dtype=np.int32)
            found[:] = np.arange(tags)
            for _, at, rows in reversed(list(_lockstep(sizes))):
                found[at] = np.take_along_axis(back[rows], found[at], 1)
            yield kept(batch, final=batch.column(batch.schema.get_field_index("final")), origin=_lists(found))

    def leave(batches: Iterator) -> Iterator:
        """The tag at each block's end; blocks come last first."""
        final = lambda batch: batch.column(batch.schema.get_field_index("final")).to_numpy()
        before_of = lambda batch, rows, tag: _matrix(batch, "origin", tags)[rows, tag.astype(np.int64)]
        for batch, fresh, before, _ in _scanned(batches, keys, before_of, lambda batch, rows: before_of(batch, rows, final(batch)[rows])):
            yield kept(batch, last=pa.array(np.where(fresh, final(batch), before).astype(np.int32)))

    def ways(batches: Iterator) -> Iterator:
        for batch in batches:
            back, sizes = backs(batch)
            tag, out = batch.column(batch.schema.get_field_index("last")).to_numpy().astype(np.int32).copy(), np.zeros(len(back), dtype=np.int32)
            for _, at, rows in reversed(list(_lockstep(sizes))):
                out[rows] = tag[at]
                tag[at] = back[rows, tag[at]]
            cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield kept(batch, tags=pa.ListArray.from_arrays(pa.array(cut), pa.array(out)))

    sequences = lambda df, *order: df.repartition(*keys).sortWithinPartitions(*keys, *order)
    entered = sequences(rows.mapInArrow(matrices, f"{schema}, whole array<double>, begun array<double>"), F.col("block")).mapInArrow(enter, f"{schema}, fresh boolean, entry array<double>, final int")
    known = written(rows.join(entered.hint("merge"), named))
    left = sequences(known.mapInArrow(maps, f"{schema}, final int, origin array<int>"), F.col("block").desc()).mapInArrow(leave, f"{schema}, last int")
    return known.join(left.hint("merge"), named).mapInArrow(ways, f"{schema}, tags array<int>")
