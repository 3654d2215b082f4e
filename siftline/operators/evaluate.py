"""Evaluation of masks: cases without repeats, comparisons, summaries, merged reports."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_NAME = re.compile("[a-z0-9_]+")
#: Bits of lines by items that are counted at a time, and words whose items a task remembers; neither changes a result.
COUNTED_BITS, REMEMBERED = 1 << 25, 500_000
#: Items whose tokens are broadcast at a time.
MOST_ITEMS = 2_000


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def dedup_cases(cases: DataFrame, *order: str) -> DataFrame:
    """The first case, in the given order, of each text and query."""
    first = Window.partitionBy(sha16(F.col("text")), "query").orderBy(*order)
    return cases.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def compare_masks(a: Column, b: Column, line_count: Column) -> list[Column]:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    agree = line_count - (either - both)
    return [
        (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) == 0).alias("exact"),
        F.when(line_count > 0, agree / line_count).otherwise(1.0).alias("line_agreement"),
        F.when(either > 0, both / either).otherwise(1.0).alias("jaccard"),
        both.cast("long").alias("both_kept"),
        F.size(F.array_except(a, b)).cast("long").alias("a_only"),
        F.size(F.array_except(b, a)).cast("long").alias("b_only"),
    ]


def summarize(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("comparisons"), F.count_if("exact").alias("exact"), F.round(F.avg("line_agreement"), 9).alias("agreement"), F.round(F.avg("jaccard"), 9).alias("jaccard"), F.sum("line_count").alias("line_count"))


def merge_reports(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Full outer on the keys; what only one report has stays, with the other's kept lines null."""
    return a.select(*keys, F.col("kept").alias("a_kept")).join(b.select(*keys, F.col("kept").alias("b_kept")), list(keys), "full_outer")


def missing(text: Column, needles: Column) -> Column:
    return F.filter(needles, lambda x: ~F.contains(text, x))


def focus_hits(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, hits, docs of every item as focus question (items of one id: as one): the (document, line) pairs that is_relevant keeps for all its query_tokens, and the documents (rows) with one.

    A focus token has only letters, digits and _, so it is in a line if it is in one of the line's words; each distinct word is looked up once, and a line's items
    are the union of its words' as a bit set. Items are taken in blocks of about MOST_ITEMS, dealt by a hash of their id, and only a block's tokens come to the driver and are broadcast;
    the documents are read once a block and never shuffled.
    """
    blocks = max(1, -(-items.select(item_id).distinct().count() // MOST_ITEMS))
    block = F.pmod(F.xxhash64(item_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_focus_hits(docs, items.where(block == k), item_id, text) for k in range(blocks)])


def _focus_hits(docs: DataFrame, items: DataFrame, item_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    ids: dict = {}
    owners: dict[str, int] = {}
    for key, tokens in items.select(item_id, T.query_tokens(F.coalesce(F.col(text), F.lit("")))).collect():
        bit = 1 << ids.setdefault(key, len(ids))
        for t in tokens:
            owners[t] = owners.get(t, 0) | bit
    shared = spark.sparkContext.broadcast(owners)
    lengths, width, everyone = sorted({len(t) for t in owners}), -(-len(ids) // 8), (1 << len(ids)) - 1

    def items_of(word: str) -> int:
        found, owners = 0, shared.value
        for n in lengths:
            if n > len(word):
                break
            for part in {word[k : k + n] for k in range(len(word) - n + 1)}:
                found |= owners.get(part, 0)
        return found

    def counts(sets: list[int]) -> np.ndarray:
        packed = np.frombuffer(b"".join(x.to_bytes(width, "little") for x in sets), dtype=np.uint8).reshape(len(sets), width)
        return np.unpackbits(packed, axis=1, bitorder="little")[:, : len(ids)].sum(axis=0, dtype=np.int64)

    def emit(batches: Iterator) -> Iterator:
        known: dict[str, int] = {}
        for batch in batches:
            total, of_lines, of_docs = np.zeros((2, len(ids)), dtype=np.int64), [], []
            for lines in batch.column(0).to_pylist():
                whole = 0
                for line in lines or ():
                    one = everyone if any(m in line for m in T.ALWAYS_KEPT) else 0
                    for word in {*_NAME.findall(line)}:
                        have = known.get(word)
                        if have is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = have = items_of(word)
                        one |= have
                    if one:
                        whole |= one
                        of_lines.append(one)
                        if len(of_lines) * width * 8 >= COUNTED_BITS:
                            total[0] += counts(of_lines)
                            of_lines = []
                if whole:
                    of_docs.append(whole)
            total[0] += counts(of_lines)
            total[1] += counts(of_docs)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int32()), pa.array(total[0]), pa.array(total[1])], ["at", "hits", "docs"])

    if not ids:
        return items.limit(0).select(item_id, F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("docs"))
    found = docs.select(T.lines(F.lower(text))).mapInArrow(emit, "at int, hits long, docs long").groupBy("at").agg(F.sum("hits").alias("hits"), F.sum("docs").alias("docs"))
    names = spark.createDataFrame(list(zip(ids.values(), ids, strict=True)), f"at int, {item_id} {items.schema[item_id].dataType.simpleString()}")
    return names.join(F.broadcast(found), "at", "left").select(item_id, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("docs", F.lit(0)).alias("docs"))


def known_names(rows: DataFrame, names: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """rows (key, names: distinct) to key, names and known: how many it has, and how many of them are in names (name).

    Up to `most` names are broadcast, so no name is shuffled and a frequent one is no hot key; more are met by a join that splits hot ones. Counts are summed within a task first. Rows without names go.
    """
    known = names.select("name").distinct().withColumn("known", F.lit(True))
    few = known.limit(most + 1).count() <= most
    spread = rows.select(key, F.explode("names").alias("name"))
    return spread.join(F.broadcast(known) if few else known, "name", "left").groupBy(key).agg(F.count("*").alias("names"), F.count("known").alias("known"))


def fixture_paths(texts: DataFrame, fixtures: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """texts with path: of fixtures (path, text) the least with the same text, else null. Both meet by a hash of the text; each fixture text is one row, so copies are no hot key on its side."""
    known = fixtures.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("_sha")).agg(F.min(path).alias(path))
    return texts.withColumn("_sha", F.sha2(text, 256)).join(known, "_sha", "left").drop("_sha")


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; where both have a key, the right one's."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def batch_rollup(batches: DataFrame, key: str, order: str, sums: tuple = (), greatest: tuple = (), latest: tuple = ()) -> DataFrame:
    """Statistics of batches by key: sums and maxima of what is there (null if none is), and the last of each that isn't null in the given order."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in latest]
    return batches.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in greatest), *last)
