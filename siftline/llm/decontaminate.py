"""Benchmark decontamination by latent semantic retrieval.

Of every document, the places of words of the benchmark's own vocabulary are found once, for all items, and written to a table; all later steps read that alone, each row for itself, and
shuffle nothing but sums. Items are then taken in blocks. Passages (64 words, every 32) of all documents are TF-IDF vectors over a block's vocabulary, without words that a fifth of all documents have. A randomised SVD
(range finding with one power iteration; executors sum A'(A Q), the driver holds vocabulary x rank numbers) gives the latent space. The matrix has the passages of all
documents and, weighing as much as these together, the block's items: words that are rare in the corpus would else have no direction of their own. Items and passages are compared by
their cosine in that space alone. Passages whose cosine with an item is high enough are
candidates. Each is settled on the words: the longest common subsequence with windows of the document about as long as the item, and the share of the item's
answer (its last words, or a column of its own) that is found there. Words that no item has can't be part of one, so the places of the others suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, work_table
from ._text import HASHED_BYTES, chunks, column, word_hashes

PASSAGE, STRIDE, RANK = 64, 32, 64
COMMON_SHARE, LEAST_COSINE = 0.2, 0.5
ALIKE, ALIKE_WITH_ANSWER, ANSWER_FOUND, ANSWER_WORDS = 0.75, 0.55, 0.6, 6
BLOCK_ITEMS = 400
#: Words of items that one scan of the documents looks for (8 bytes each to every executor).
SCAN_WORDS = 4_000_000
CHUNK_HITS = 1 << 20
_NO_ID = -(1 << 63)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, lower=True, terms=True)


def positions(a: np.ndarray) -> dict[int, int]:
    """Of a sequence of symbols: the places of each as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def lcs_length(a: dict[int, int], n: int, b: list[int]) -> int:
    """Of two sequences, one of n symbols given by its positions: one addition for a symbol of b that a has too."""
    full = (1 << n) - 1
    row = full
    for x in b:
        if m := a.get(x, 0):
            keep = row & m
            row = (row + keep) | (row - keep)
    return n - (row & full).bit_count()


class Settler:
    """Compares items (sequences of vocabulary numbers, and their answers) with the vocabulary words near a document's candidate passages.

    A window's longest common subsequence with an item is at most the number of its words that the item has, and at most
    the number of the item's places whose words it has; windows which can't reach ALIKE_WITH_ANSWER by these are left out.
    """

    def __init__(self, texts: list[np.ndarray], answers: list[np.ndarray], vocabulary: int):
        self.sizes, self.masks = [len(t) for t in texts], [positions(t) for t in texts]
        self.answer_sizes, self.answer_masks = [len(a) for a in answers], [positions(a) for a in answers]
        self.has = np.zeros((len(texts), vocabulary), dtype=bool)
        for i, t in enumerate(texts):
            self.has[i, t] = True

    def _best(self, item: int, at: np.ndarray, word: np.ndarray, length: int, passage: int) -> tuple[float, int, int] | None:
        """The largest share of the item that is a subsequence of a window near the passage, and the window as a range of at and word."""
        n, masks = self.sizes[item], self.masks[item]
        lo, hi = max(0, passage - n), min(length, passage + PASSAGE + n)
        wide = n + n // 4 + 4
        begins = np.arange(lo, max(lo + 1, hi - wide + n // 4 + 1), max(1, n // 4))
        first, last = (np.searchsorted(at, x.astype(at.dtype)) for x in (begins, np.minimum(hi, begins + wide)))
        common = np.concatenate([[0], np.cumsum(self.has[item, word[first[0] : last[-1]]])])
        most = common[last - first[0]] - common[first - first[0]]
        needed = ALIKE_WITH_ANSWER * n - 1e-6
        best = None
        for k in np.flatnonzero(most >= needed).tolist():
            if most[k] < needed:
                continue
            window, places = word[first[k] : last[k]].tolist(), 0
            for x in window:
                places |= masks.get(x, 0)
            if places.bit_count() < needed:
                continue
            size = lcs_length(masks, n, window)
            if best is None or size > best[0] * n + 0.5:
                best = (size / n, int(first[k]), int(last[k]))
                needed = max(needed, size + 1)
        return best

    def best(self, at: np.ndarray, word: np.ndarray, length: int, listed: list[tuple[int, int, float]]) -> dict[int, tuple[float, float, float]]:
        """For each item of the candidates (item, passage, cosine): the best share, the share of its answer in that window, and the cosine. Items which no window can reach are absent."""
        out: dict[int, tuple] = {}
        for i, passage, cosine in listed:
            if match := self._best(i, at, word, length, passage):
                share, lo, hi = match
                answer = lcs_length(self.answer_masks[i], self.answer_sizes[i], word[lo:hi].tolist()) / max(1, self.answer_sizes[i])
                out[i] = max(out.get(i, (-1.0,)), (share, answer, cosine))
        return out


def _locate(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in words that are in the sorted vocabulary, and which word of it."""
    if not len(vocabulary):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    maybe = np.zeros(1 << 18, dtype=bool)
    maybe[(vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(words & np.uint64((1 << 18) - 1)).astype(np.int64)])
    w = np.minimum(np.searchsorted(vocabulary, words[at]), len(vocabulary) - 1)
    hit = vocabulary[w] == words[at]
    return at[hit], w[hit]


def _hits(batch, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (at, word): where each row's hits begin (and the end), their places and their numbers in the block's vocabulary (local: these, or -1, of the scan's)."""
    at, word = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "word"))
    begins = np.cumsum([0, *(len(x) // 4 for x in word)])
    at, word = (np.frombuffer(b"".join(x), dtype=np.int32) for x in (at, word))
    word = local[word]
    keep = word >= 0
    if keep.all():
        return begins, at, word
    return np.concatenate([[0], np.cumsum(keep)])[begins], at[keep], word[keep]


def _passages(begins: np.ndarray, at: np.ndarray, word: np.ndarray, rare: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of hits: each passage's row and first word, and its distinct rare words (rare: a vocabulary word's number among these, or -1) as sorted pairs (passage, word)."""
    word = rare[word].astype(np.int64)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    slot, keys = at.astype(np.int64) // stride, []
    for back in range(PASSAGE // stride):
        ok = (slot >= back) & (word >= 0)
        keys.append((row[ok] << 46) | ((slot[ok] - back) << 22) | word[ok])
    pairs = np.unique(np.concatenate(keys))
    place, number = np.unique(pairs >> 22, return_inverse=True)
    return place >> 24, (place & ((1 << 24) - 1)) * stride, number, pairs & ((1 << 22) - 1)


def _project(number: np.ndarray, word: np.ndarray, idf: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Sums of idf[word] basis[word] for each passage number (sorted)."""
    out = np.zeros((n, basis.shape[1]), dtype=np.float32)
    if len(word):
        weighted = basis * idf[:, None]
        for lo in range(0, n, 4096):
            i, j = np.searchsorted(number, [lo, min(n, lo + 4096)])
            heads = np.searchsorted(number[i:j], np.arange(lo, min(n, lo + 4096)))
            out[lo : lo + 4096] = np.add.reduceat(weighted[word[i:j]], heads)
    return out


def _gram(hits: DataFrame, local: np.ndarray, rare: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """A'(A basis) for the matrix A of unit passage vectors, and its number of rows: a partial sum a task, added up in a second, much smaller stage, then on the driver."""
    shape, shared = basis.shape, hits.sparkSession.sparkContext.broadcast((local, rare, idf.astype(np.float32), basis.astype(np.float32)))

    def multiply(batches: Iterator) -> Iterator:
        local, rare, idf, basis = shared.value
        passages = 0
        total = np.zeros(shape)
        for batch, _ in chunks(batches, "word", 2 * CHUNK_HITS):
            _, _, number, word = _passages(*_hits(batch, local), rare, PASSAGE)
            n = int(number[-1]) + 1 if len(number) else 0
            passages += n
            norm = np.sqrt(np.bincount(number, idf[word] ** 2, minlength=n))
            y = _project(number, word, idf, basis, n) / np.maximum(norm, 1e-9)[:, None] ** 2
            by = np.argsort(word, kind="stable")
            used, heads = np.unique(word[by], return_index=True)
            for a in range(0, len(used), 512):
                i, j = heads[a], (heads[a + 512] if a + 512 < len(used) else len(by))
                total[used[a : a + 512]] += np.add.reduceat(y[number[by[i:j]]], heads[a : a + 512] - i) * idf[used[a : a + 512]][:, None]
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()]), pa.array([passages])], ["part", "n"])

    def add(batches: Iterator) -> Iterator:
        total, passages = np.zeros(shape), 0
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, dtype=np.float32).reshape(shape)
            passages += int(column(batch, "n").sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()]), pa.array([passages])], ["part", "n"])

    parts = hits.mapInArrow(multiply, "part binary, n long").repartition(16).mapInArrow(add, "part binary, n long").collect()
    return np.sum([np.frombuffer(p["part"], dtype=np.float32).reshape(shape) for p in parts], axis=0, dtype=np.float64), sum(p["n"] for p in parts)


def _scan(rows: DataFrame, items: list[tuple[int, bytes, bytes]]) -> tuple[DataFrame, list[np.ndarray], np.ndarray]:
    """Of items (id, text, answer): the places of all their words in all documents (a work table), each text's and then each answer's words by number, and how many documents have each word."""
    spark = rows.sparkSession
    words, begins = terms([*(t for _, t, _ in items), *(a for _, _, a in items)])
    vocabulary, numbers = np.unique(words, return_inverse=True)
    known, size = spark.sparkContext.broadcast(vocabulary), len(vocabulary)

    def hit(batches: Iterator) -> Iterator:
        for batch, data in chunks(batches, "data", HASHED_BYTES):
            words, begins = terms(data)
            at, w = _locate(words, known.value)
            cut = np.searchsorted(at, begins)
            out = [(k, e - b, (at[i:j] - b).astype(np.int32).tobytes(), w[i:j].astype(np.int32).tobytes()) for k, b, e, i, j in zip(column(batch, "key").tolist(), begins.tolist(), begins[1:].tolist(), cut[:-1], cut[1:], strict=False) if j > i]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "length", "at", "word"])

    hits = work_table(rows.mapInArrow(hit, "key long, length long, at binary, word binary"))

    def frequency(batches: Iterator) -> Iterator:
        total = np.zeros(size, dtype=np.int64)
        for _, data in chunks(batches, "word", CHUNK_HITS):
            word = np.frombuffer(b"".join(data), dtype=np.int32).astype(np.int64)
            doc = np.repeat(np.arange(len(data)), [len(x) // 4 for x in data])
            total += np.bincount(np.unique(doc * size + word) % size, minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["word", "n"])

    df = np.zeros(size)
    for r in hits.select("word").mapInArrow(frequency, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        df[r[0]] = r[1]
    return hits, [numbers[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)], df


def _block(hits: DataFrame, ids: list, texts: list[np.ndarray], answers: list[np.ndarray], df: np.ndarray, n_docs: int) -> DataFrame:
    """Matches of one block of items; texts and answers by the scan's numbers of words."""
    spark = hits.sparkSession
    own = np.unique(np.concatenate([*texts, *answers]))
    size, local = len(own), np.full(len(df), -1, dtype=np.int32)
    local[own] = np.arange(size)
    texts, answers, df = [local[t] for t in texts], [local[a] for a in answers], df[own]
    answers = [a if len(a) else t[-ANSWER_WORDS:] for t, a in zip(texts, answers, strict=True)]
    # items of common words only keep them; else common words say nothing, nor do words of answers alone
    kept = (df <= COMMON_SHARE * n_docs) & np.isin(np.arange(size), np.concatenate(texts))
    needed = [t for t in texts if len(t) and not kept[t].any()]
    if needed:
        kept[np.concatenate(needed)] = True
    idf = np.log((n_docs + 1) / (df[kept] + 1)) + 0.1
    rare = np.where(kept, np.cumsum(kept) - 1, -1)
    vectors, owner = [], []
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - PASSAGE // 2), PASSAGE - STRIDE // 2):
            w = rare[t[lo : lo + PASSAGE]]
            w = w[w >= 0]
            v = np.zeros(len(idf))
            v[w] = idf[w]
            if v.any():
                owner.append((i, float(np.linalg.norm(v))))
                vectors.append(v / owner[-1][1])
    if not vectors:
        return spark.createDataFrame([], "key long, item_id long, cosine double, lcs double, answer double")
    queries = np.array(vectors)
    basis = np.random.default_rng(5).standard_normal((len(idf), min(RANK, len(idf))))
    for _ in range(2):
        gram, passages = _gram(hits, local, rare, idf, basis)
        basis = np.linalg.qr(gram + max(1.0, passages / len(queries)) * (queries.T @ (queries @ basis)))[0]
    latent = queries @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    least = LEAST_COSINE * min(n for _, n in owner)
    model = spark.sparkContext.broadcast((local, rare, idf.astype(np.float32), basis.astype(np.float32), latent.astype(np.float32), np.array([i for i, _ in owner])))
    wanted = spark.sparkContext.broadcast((texts, answers, ids))

    def search(batches: Iterator) -> Iterator:
        local, rare, idf, basis, latent, owners = model.value
        texts, answers, ids = wanted.value
        settler = Settler(texts, answers, size)
        for batch, _ in chunks(batches, "word", CHUNK_HITS):
            begins, places, words = _hits(batch, local)
            row, at, number, word = _passages(begins, places, words, rare, STRIDE)
            mass = np.sqrt(np.bincount(number, idf[word] ** 2, minlength=len(row)))
            strong = mass >= least * 0.999  # with weights of presence, a cosine of t needs t times the query's length
            keep = strong[number]
            number, word, row, at = (np.cumsum(strong) - 1)[number[keep]], word[keep], row[strong], at[strong]
            found: dict[int, list] = {}
            for i in range(0, len(row), 4096):
                a, b = np.searchsorted(number, [i, min(len(row), i + 4096)])
                p = _project(number[a:b] - i, word[a:b], idf, basis, min(4096, len(row) - i))
                cosine = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)) @ latent.T
                x, y = np.nonzero(cosine >= LEAST_COSINE)
                for r, *candidate in zip(row[i + x].tolist(), owners[y].tolist(), at[i + x].tolist(), cosine[x, y].tolist(), strict=True):
                    found.setdefault(r, []).append(candidate)
            keys, lengths, out = column(batch, "key"), column(batch, "length"), []
            for r, listed in found.items():
                own = slice(begins[r], begins[r + 1])
                matches = settler.best(places[own], words[own], int(lengths[r]), listed)
                out += [(int(keys[r]), ids[i], c, s, a) for i, (s, a, c) in matches.items() if s >= ALIKE or (s >= ALIKE_WITH_ANSWER and a >= ANSWER_FOUND)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["key", "item_id", "cosine", "lcs", "answer"])

    return work_table(hits.mapInArrow(search, "key long, item_id long, cosine double, lcs double, answer double"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words in order) and answer (share of the answer's): one row for each document that has an item, in full or paraphrased.

    Null, empty or white texts and items match nothing. A document with a null doc_id is compared and returned with null. Rows of one doc_id are one document: the best of their
    matches counts for each. Items repeated with one item_id and text are taken once; null item_id is returned as null. Other columns are ignored. One scan of the documents serves all items
up to SCAN_WORDS words of them; the items of a scan go through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(_NO_ID)).cast("long").alias("key"), F.col(text).cast("binary").alias("data"))
    n_docs = rows.count()
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t"), (F.col(answer) if answer else F.lit(None)).cast("binary").alias("a")).where("t is not null").distinct().orderBy("i", "t")
    out, scan, size = None, [], 0

    def add(out, scan):
        hits, parts, df = _scan(rows, scan)
        for lo in range(0, len(scan), BLOCK_ITEMS):
            hi = min(len(scan), lo + BLOCK_ITEMS)
            found = _block(hits, [i for i, _, _ in scan[lo:hi]], parts[lo:hi], parts[len(scan) + lo : len(scan) + hi], df, n_docs)
            out = found if out is None else out.union(found)
        drop_table(hits)
        return out

    for r in items.toLocalIterator():
        scan.append((r["i"], bytes(r["t"]), bytes(r["a"] or b"")))
        size += len(terms([scan[-1][1] + b" " + scan[-1][2]])[0])
        if size >= SCAN_WORDS:
            out, scan, size = add(out, scan), [], 0
    if scan:
        out = add(out, scan)
    if out is None:
        out = spark.createDataFrame([], "key long, item_id long, cosine double, lcs double, answer double")
    best = out.groupBy("key", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("best"))
    return best.select(F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), "item_id", "best.cosine", "best.lcs", "best.answer")
