"""N-gram Jaccard join: prefixes of word shingles in which frequent shingles count in combinations only.

Every document's shingles are put in one global order: rare ones first, frequent ones last, by hash within each class. Of two documents that
reach the threshold, the one of n shingles misses fewer than p = n - ceil(t n) + 1 of the other's. So if its first p shingles are rare, the two share one of
them: single rare shingles are indexed. If it has fewer rare ones, the prefix is extended into the frequent class by b more than are
missing, and the two share a rare shingle or more than b frequent ones, of which two fall into one of b hash bins: pairs of frequent shingles in a
bin are indexed. b follows the document's size in powers of two, and pairs are made by the bins of half that number, so documents of neighbouring sizes agree.
Of a pair, the smaller one shares at least 2t / (1 + t) of its shingles, so its prefix is nearly half as long. A signature from a document's shorter prefix is marked
(leads); one that none of its documents leads with can't make a pair and is dropped. So a passage that thousands of different documents have is only a signature where it is nearly all of one.

The frequent class is a bitmap of fixed size, by hash, of which any shingle can be looked up; a rare shingle that falls on a set bit counts as frequent everywhere.

Documents that share an indexed signature are candidates. All pairs of a group of copies would grow with its square, and links are needed only as far as they
join components, so candidates are verified in two rounds: first each document against the least that leads one of its signatures' documents and may be near enough; then, wherever a signature's
documents are in several components, those outside its largest one against all others of like size in other components. Parity
bitmaps (the symmetric difference is at least the bits in which two differ) dismiss most of the latter within the join, before any row is made. Those
bitmaps are short; of longer documents, finer ones as wide as the set are compared before any text is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bucketed_table, drop_table, shuffle_parts, work_table
from ._text import HASHED_BYTES, as_long, chunks, column, gram_hashes, mix, range_hashes, stretches, word_hashes
from .components import connected_components

SHINGLE_WORDS = 5
#: The frequent class: shingles in more than so many documents' prefixes, as a bitmap of 2 ** CLASS_BITS bits. Both only steer the work; the join is exact for any values.
RARE_UP_TO = 32
CLASS_BITS = 25
#: A value with more than 1 / HOT_SHARE of all occurrences is hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 2048
#: Tokens that a group of the counting and of the indexing stage has on average, and that a task adds up before it sends them.
GROUP_TOKENS, TASK_TOKENS = 1 << 19, 1 << 19
_BITS = 1024
_NO_ID = -(1 << 63)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles (fewer words: of the whole sequence)."""
    words, begins = word_hashes(texts, lower=True)
    grams = gram_hashes(words, k)
    for lo, hi in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        else:
            yield range_hashes(words, np.array([lo]), np.array([hi])) if hi > lo else words[:0]


def set_hashes(tokens: np.ndarray) -> tuple[int, int, int]:
    """Two independent hashes of a set of shingles, and one of both and its size, even (0 of the empty set)."""
    if not len(tokens):
        return 0, 0, 0
    one = np.bitwise_xor.reduce(mix(tokens))
    two = np.add.reduce(mix(tokens ^ np.uint64(0xABCDEF)), dtype=np.uint64)
    both = mix(np.array([one, two, len(tokens)], dtype=np.uint64))
    return int(one.view(np.int64)), int(two.view(np.int64)), int((mix(both[:1] ^ (both[1:2] + both[2:])) & ~np.uint64(1)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def leading_length(n: int, percent: int) -> int:
    """As prefix_length, against documents that are no smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a document's sorted shingles (frequent: which are of that class): its signatures, ascending, and which of them it leads with."""
    n = len(tokens)
    if n < 2:  # a single shingle is linked with equal sets only
        return tokens[:0], frequent[:0]
    p, short = prefix_length(n, percent), leading_length(n, percent)
    rare = tokens[~frequent][:p]
    sigs, leads = [rare], [np.arange(len(rare)) < short]
    if len(rare) < p:
        bins = 1 << max(0, (p // 4).bit_length() - 1)
        rest = tokens[frequent][: p - len(rare) + bins]
        own = np.arange(len(rest)) < (short - len(rare) + bins if len(rare) < short else 0)
        place = mix(rest) & np.uint64(max(1, bins // 2) - 1)
        by = np.argsort(place, kind="stable")
        rest, own, place = rest[by], own[by], place[by]
        for step in range(1, len(rest)):
            same = np.flatnonzero(place[:-step] == place[step:])
            if not len(same):
                break
            sigs.append(mix(mix(rest[same]) + rest[same + step]))
            leads.append(own[same] & own[same + step])
    sigs, leads = np.concatenate(sigs), np.concatenate(leads)
    by = np.lexsort((~leads, sigs))
    sigs, leads = sigs[by], leads[by]
    first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    return sigs[first], leads[first]


def hot_signatures(hot: np.ndarray) -> np.ndarray:
    """The signatures of pairs of hot shingles (sorted), sorted."""
    i, j = np.triu_indices(len(hot), 1)
    return np.unique(mix(mix(hot[i]) + hot[j]))


class Classes:
    """The frequent class as a bitmap by hash, and the hot shingles."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray):
        self.bits, self.hot = bits, hot

    @staticmethod
    def place(tokens: np.ndarray) -> np.ndarray:
        return (mix(tokens) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        at = self.place(tokens)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _deal(by_value: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, columns) with what falls into each bucket as bytes."""
    bucket = (mix(by_value) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    used, begin = np.unique(bucket[by], return_index=True)
    for b, lo, hi in zip(used.tolist(), begin.tolist(), np.append(begin, len(by))[1:].tolist(), strict=True):
        yield b, *(x[by[lo:hi]].tobytes() for x in columns)


def _joined(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint64)


def frequent_shingles(rows: DataFrame, k: int, percent: int, parts: int, total: int) -> Classes:
    """Of the shingles in prefixes in hash order (total occurrences in all): those in more than RARE_UP_TO documents', and the hot ones. Tasks add up their counts, so a
    frequent shingle comes from each but a few times. The driver gets the bitmap in parts, and fewer than HOT_SHARE shingles."""
    parts = min(parts, 1 << (CLASS_BITS - 3))
    width, most = (1 << CLASS_BITS) // parts, max(RARE_UP_TO, total // HOT_SHARE)

    def sent(tokens: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(tokens), return_counts=True)
        bucket = Classes.place(token) // width
        by = np.argsort(bucket, kind="stable")
        used, begin = np.unique(bucket[by], return_index=True)
        cut = [by[lo:hi] for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(by)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (token, n.astype(np.int64)))], ["bucket", "tokens", "counts"])

    def emit(batches: Iterator) -> Iterator:
        held, size = [], 0
        for _, texts in chunks(batches, "data", HASHED_BYTES):
            for s in shingle_sets(texts, k):
                if len(s) > 1:
                    held.append(s[: prefix_length(len(s), percent)].copy())
                    size += len(held[-1])
            if size >= TASK_TOKENS:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    def count(pdf):
        import pandas as pd

        token, at = np.unique(_joined(pdf["tokens"]), return_inverse=True)
        n = np.bincount(at, _joined(pdf["counts"]).view(np.int64), minlength=len(token))
        bits = np.zeros(width, dtype=np.uint8)
        bits[Classes.place(token[n > RARE_UP_TO]) % width] = 1
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()], "hot": [token[n > most].tobytes()]})

    found = rows.mapInArrow(emit, "bucket long, tokens binary, counts binary").groupBy("bucket").applyInPandas(count, "bucket long, bits binary, hot binary")
    bits, hot = np.zeros((parts, width // 8), dtype=np.uint8), []
    for r in found.collect():
        bits[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        hot.append(r["hot"])
    return Classes(bits.reshape(-1), np.sort(_joined(hot)))


def _links(pairs: DataFrame, sketch: DataFrame, texts: DataFrame, k: int, percent: int, one_each: bool = False) -> DataFrame:
    """pairs (a, b), distinct: those that reach the threshold; one_each: of each b's pairs that may, only that with the least a."""
    side = lambda c: sketch.select(F.col("key").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "bits", "fine")))

    def compare(batches: Iterator) -> Iterator:
        for batch in batches:
            fine = [batch.column(batch.schema.get_field_index(f"fine_{c}")).to_pylist() for c in "ab"]
            most = (column(batch, "n_a") + column(batch, "n_b")) * (100 - percent)
            ok = np.array([fine_difference(x, y) * (100 + percent) <= m for x, y, m in zip(*fine, most.tolist(), strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, c)[ok], pa.int64()) for c in "ab"], ["a", "b"])

    near = pairs.join(side("a"), "a").where("n_a is not null").join(side("b"), "b").where(_may_link("a", "b", percent))
    near = near.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(compare, "a long, b long").distinct()
    if one_each:
        near = near.groupBy("b").agg(F.min("a").alias("a"))
    text = lambda c: texts.select(F.col("key").alias(c), F.col("data").alias(f"data_{c}"))

    def verify(batches: Iterator) -> Iterator:
        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            data = [[t or b"" for t in batch.column(batch.schema.get_field_index(f"data_{c}")).to_pylist()] for c in "ab"]
            ok = []
            for lo, hi in stretches([len(x) + len(y) for x, y in zip(*data, strict=True)], HASHED_BYTES):
                for x, y in zip(*(shingle_sets(d[lo:hi], k) for d in data), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
            ok = np.array(ok, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], ["a", "b"])

    return near.join(text("a"), "a").join(text("b"), "b").mapInArrow(verify, "a long, b long")


def fine_bitmap(tokens: np.ndarray) -> bytes | None:
    """Parities of a longer document's shingles by hash, as many bits as shingles or up to twice that."""
    if len(tokens) <= _BITS // 2:
        return None
    width = 1 << (len(tokens) - 1).bit_length()
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def fine_difference(x: bytes | None, y: bytes | None) -> int:
    """At most the size of the symmetric difference: the bits in which two differ, the wider folded to the other's width."""
    if x is None or y is None:
        return 0
    width = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(v, dtype=np.uint8).reshape(-1, width), axis=0) for v in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def _may_link(a: str, b: str, percent: int):
    """Sizes and parity bitmaps allow the threshold: |x ^ y| <= (|x| + |y|) (1 - t) / (1 + t)."""
    n = [F.col(f"n_{a}"), F.col(f"n_{b}")]
    differ = sum((F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i])) for i in range(1, _BITS // 64)), F.bit_count(F.col(f"bits_{a}")[0].bitwiseXOR(F.col(f"bits_{b}")[0])))
    return (F.least(*n) * 100 >= F.greatest(*n) * percent) & (differ * (100 + percent) <= (n[0] + n[1]) * (100 - percent))


def near_duplicate_components(docs: DataFrame, percent: int = 80, k: int = SHINGLE_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents whose sets of k-word shingles (words lower-cased in A-Z) have a Jaccard similarity of at least percent / 100.

    Returns doc_id, n_shingles, class_id (least doc_id with the same set), component_id (least doc_id reachable by links). Null, empty or
    white text: the empty set, linked with nothing. A null doc_id gives a row of its own with null class_id and component_id if nothing smaller is reached; it is the least of
    all, so what is linked with it reaches null. Rows of one doc_id are one node: with different texts, it has the links of each. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(_NO_ID)).cast("long").alias("key"), F.col(text).cast("binary").alias("data"))

    def describe(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data", HASHED_BYTES):
            n, hashes, bits, fine = [], [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                hashes.append(set_hashes(s))
                odd = np.bincount((s % np.uint64(_BITS)).astype(np.int64), minlength=_BITS).astype(np.uint8) & 1
                bits.append(np.packbits(odd).view(np.int64).tolist())
                fine.append(fine_bitmap(s))
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "key"), pa.int64()), pa.array(n, pa.int64()), *(pa.array(h, pa.int64()) for h in zip(*hashes, strict=True)), pa.array(bits, pa.list_(pa.int64())), pa.array(fine, pa.binary())], ["key", "n", "one", "two", "class", "bits", "fine"])

    sets = work_table(rows.mapInArrow(describe, "key long, n long, one long, two long, class long, bits array<long>, fine binary"))
    same = ["n", "one", "two"]
    classes = sets.where("n > 0").groupBy(*same, "class").agg(F.min("key").alias("rep"))
    reps = work_table(classes.select("class", "rep"))
    members = work_table(sets.select("key", *same).join(classes.drop("class"), same, "left").select("key", "n", F.coalesce("rep", "key").alias("rep")))
    total = members.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    parts = 1 << (max(shuffle_parts(spark) * 2, 16, -(-total // GROUP_TOKENS)) - 1).bit_length()
    shared_classes = spark.sparkContext.broadcast(frequent_shingles(rows, k, percent, parts, total))

    def index(batches: Iterator) -> Iterator:
        known = shared_classes.value
        hot_sigs = hot_signatures(known.hot)
        for batch, texts in chunks(batches, "data", HASHED_BYTES):
            found = list(shingle_sets(texts, k))
            often = known.frequent(np.concatenate(found or [known.hot[:0]]))
            ends = np.cumsum([len(s) for s in found])
            # documents with equal sets are told apart no further than by their class, and a chunk's are dealt out once
            classes, first = np.unique(np.array([set_hashes(s)[2] for s in found], dtype=np.int64), return_index=True)
            made = [signatures(found[i], often[ends[i] - len(found[i]) : ends[i]], percent) for i in first.tolist()]
            sigs = np.concatenate([s for s, _ in made] or [known.hot[:0]])
            classes = np.repeat(classes.view(np.uint64), [len(s) for s, _ in made]) | np.concatenate([x for _, x in made] or [often[:0]]).astype(np.uint64)
            hot = hot_sigs[np.minimum(np.searchsorted(hot_sigs, sigs), len(hot_sigs) - 1)] == sigs if len(hot_sigs) else np.zeros(len(sigs), dtype=bool)
            # hot signatures are dealt by the document, in groups of their own
            out = list(_deal(sigs[~hot], parts, sigs[~hot], classes[~hot]))
            out += [(-1 - b, *x) for b, *x in _deal(classes[hot] >> np.uint64(1), parts, sigs[hot], classes[hot])]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in out], pa.int64()), pa.array([s for _, s, _ in out], pa.binary()), pa.array([x for _, _, x in out], pa.binary())], ["bucket", "sigs", "classes"])

    def shared(pdf):
        import pandas as pd

        sigs, keys, hot = _joined(pdf["sigs"]), _joined(pdf["classes"]), bool(pdf["bucket"].iloc[0] < 0)
        by = np.lexsort((keys, sigs))
        sigs, keys = sigs[by], keys[by]
        first = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1])])
        sigs, keys = sigs[first], keys[first]
        if not hot:
            heads = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]) != 0)
            many = (np.diff(heads, append=len(sigs)) > 1) & (np.maximum.reduceat(keys & np.uint64(1), heads) == 1) if len(heads) else heads > 0
            keep = np.repeat(many, np.diff(heads, append=len(sigs)))
            sigs, keys = sigs[keep], keys[keep]
        heads = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]) != 0)
        sizes = np.diff(heads, append=len(sigs))
        who = [np.repeat(f.reduceat(mix(keys + np.uint64(salt)), heads), sizes) if len(heads) else sigs for f, salt in ((np.add, 2), (np.bitwise_xor, 4))]
        return pd.DataFrame({"sig": as_long(sigs), "class": as_long(keys & ~np.uint64(1)), "leads": (keys & np.uint64(1)) == 1, "hot": hot, "who": as_long(who[0]), "too": as_long(who[1])})

    found = work_table(rows.mapInArrow(index, "bucket long, sigs binary, classes binary").groupBy("bucket").applyInPandas(shared, "sig long, class long, leads boolean, hot boolean, who long, too long"))
    # of hot signatures, partial sums meet here
    own = [F.xxhash64(F.lit(i), "class", "leads") for i in (1, 2)]
    hot = found.where("hot").groupBy("sig").agg(F.count("*").alias("m"), F.max("leads").alias("led"), F.bit_xor(own[0]).alias("who"), F.bit_xor(own[1]).alias("too")).where("m > 1 and led").drop("m", "led")
    found_too = found.where("not hot").drop("hot").unionByName(found.where("hot").drop("hot", "who", "too").join(hot, "sig"))
    # signatures with the same documents say the same: one of them stays
    lists = work_table(found_too.join(found_too.groupBy("who", "too").agg(F.min("sig").alias("sig")), ["who", "too", "sig"], "left_semi").join(reps, "class").groupBy("sig", F.col("rep").alias("key")).agg(F.max("leads").alias("leads")))
    drop_table(found)
    drop_table(reps)
    involved = lists.select("key").distinct()
    texts, texts_name = bucketed_table(rows.join(involved, "key", "left_semi"), "key")
    sketch = work_table(sets.join(involved, "key", "left_semi").select("key", "n", "bits", "fine"))

    most = lists.count() // HOT_SHARE + 1

    def by_signature(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows joined with facts (sig, m: its number of rows, ...). Facts of signatures with more than 1 / HOT_SHARE of all rows are broadcast, so that these stay where they lie."""
        often, seldom = facts.where(F.col("m") > most), facts.where(F.col("m") <= most)
        return rows.join(F.broadcast(often), "sig").unionByName(rows.join(F.broadcast(often.select("sig")), "sig", "left_anti").join(seldom.hint("merge"), "sig")).drop("m")

    leaders = lists.groupBy("sig").agg(F.count("*").alias("m"), F.min("key").alias("a"))
    stars = by_signature(lists, leaders).where("key != a").select("a", F.col("key").alias("b")).distinct()
    links = work_table(_links(stars, sketch, texts, k, percent, one_each=True))
    parts_of = connected_components(links)

    # documents whose sizes differ by no more than the threshold allows are in the same or neighbouring slots
    slot = F.floor(F.log(F.col("n")) / max(1.0001 * math.log(100 / percent), 1e-3)).alias("slot")
    placed = lists.join(sketch, "key").join(parts_of.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", "leads", "n", slot, "bits", F.coalesce("component", "key").alias("comp"))
    split = lists.select("sig", "key").join(parts_of.withColumnRenamed("node", "key"), "key", "left").groupBy("sig", F.coalesce("component", "key").alias("comp")).agg(F.count("*").alias("c"))
    largest = split.groupBy("sig").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("sig", "m", F.col("top.comp").alias("main"))
    placed = work_table(by_signature(placed, largest).withColumn("minor", F.col("comp") != F.col("main")))
    left = placed.where("minor").select("sig", "slot", F.col("key").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("n", "bits", "comp", "leads")))
    right = placed.select("sig", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"), F.col("key").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("n", "bits", "comp", "leads", "minor")))
    apart = (F.col("comp_a") != F.col("comp_b")) & (F.col("leads_a") | F.col("leads_b")) & (~F.col("minor_b") | (F.col("a") < F.col("b")))
    cross = left.join(right, (left["sig"] == right["sig"]) & (left["slot"] == right["slot"]) & apart & _may_link("a", "b", percent)).select("a", "b").distinct()
    more = work_table(_links(cross, sketch, texts, k, percent))
    joined = connected_components(links.union(more))
    out = members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "n", "rep", F.coalesce("component", "rep").alias("component"))
    spark.sql(f"DROP TABLE {texts_name}")
    for t in (sets, lists, texts, sketch, placed, links, more):
        drop_table(t)
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(known("key").alias(doc_id), F.col("n").alias("n_shingles"), known("rep").alias("class_id"), known("component").alias("component_id"))
