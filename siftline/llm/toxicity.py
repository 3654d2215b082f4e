"""Toxicity: a learnt lexicon in a trie, met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon (words, and stems of word beginnings) is learnt from labelled texts by smoothed log odds. Scoring walks the trie with a Levenshtein automaton of
the text's word: states are a place in the word and whether the edit is spent (a letter more, less or another, or two neighbours swapped), so misspelled terms are found in
one walk over all terms. Exact terms and stems need no walk. A misspelled term counts as the term itself, at a little less weight; what clean texts of the sample have as a word of their own
is none. The words around each hit (a window) say whether it is quoted or spoken about. A logistic model over the counts gives the score; it is fitted on
features whose lexicon was learnt from the other half of the sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import chunks, column

#: Bounds of what training brings to the driver: labelled texts looked at, lexicon entries, and the texts' feature rows.
MOST_LABELLED, MOST_TERMS = 20_000, 2048
LEAST_RATIO = 11.0
N_FEATURES = 7
#: The weight of a misspelled term, as a share of the term's.
MISSPELLED = 0.9
STEMS = (5, 6, 7)
THRESHOLD = 0.3
WINDOW = 6
# Marks and words that introduce quotation or mention, in the languages at hand.
QUOTES = "\"“”„«»‘’‹›"
MENTIONS = {"said", "says", "wrote", "writes", "called", "quote", "quoted", "word", "term", "sagte", "schrieb", "nannte", "wort", "zitat", "dit", "écrit", "mot", "citation", "dijo", "escribió", "llamó", "palabra", "cita"}
_STRIP = ".,;:!?()[]{}<>*_-#/\\|'" + QUOTES
#: Tokens looked up that a worker remembers, and counts that a task adds up before it sends them.
_CACHE, _COUNTED = 60_000, 150_000


def core(token: str) -> str:
    return token.strip(_STRIP)


def units_of(word: str) -> list[str]:
    """The word itself and the stems ("abcde*") it begins with."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


class Lexicon:
    """Terms with weights; those that are whole words of five letters or more also within one edit, by an automaton over the trie."""

    def __init__(self, weights: dict[str, float], own: frozenset[str] = frozenset()):
        """own: words near a term that are no misspellings of it."""
        self.weights, self.own = weights, own
        self.trie: dict = {}
        self.reach: set[str] = set()
        self.longest = 0
        for term in weights:
            if term[-1] != "*" and len(term) >= 5:
                node = self.trie
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = term
                self.reach |= self.shortened(term)
                self.longest = max(self.longest, len(term))
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    @staticmethod
    def shortened(word: str) -> set[str]:
        """The word, and it without any one letter: two words within one edit have one of these in common, so most words need no walk."""
        return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}

    def near(self, word: str) -> str | None:
        """A term within one edit. The word's automaton has a state for each letter read with no edit yet, where the walk is a single path, and for each read after the edit, from where only the rest as it is leads on."""

        def rest(node: dict, at: int) -> str | None:
            for c in word[at:]:
                node = node.get(c)
                if node is None:
                    return None
            return node.get("")

        node = self.trie
        for i in range(len(word) + 1):
            found = node.get("") if i >= len(word) - 1 else None  # the word's last letter too many, or none
            found = found or (rest(node, i + 1) if i < len(word) else None)
            if found:
                return found
            for c, child in node.items():
                if c and (found := rest(child, i + 1) if i < len(word) and c != word[i] else None) is None:
                    found = rest(child, i)
                if found:
                    return found
            if i + 1 < len(word) and (swapped := node.get(word[i + 1], {}).get(word[i])) is not None and (found := rest(swapped, i + 2)):
                return found
            node = node.get(word[i]) if i < len(word) else None
            if node is None:
                return None
        return None

    def look(self, token: str) -> tuple | None:
        """(unit, weight, kind) for a token of the text in lower case; kind 0 word, 1 stem, 2 misspelled."""
        word = core(token)
        hits = [(u, self.weights[u]) for u in units_of(word) if u in self.weights] if word else []
        if hits:
            unit, weight = max(hits, key=lambda x: x[1])
            return unit, weight, int(unit[-1] == "*")
        if word not in self.own and (term := self.misspelled(word)) is not None:
            return term, self.weights[term], 2
        return None

    def misspelled(self, word: str) -> str | None:
        if 4 <= len(word) <= self.longest + 1 and not self.reach.isdisjoint(self.shortened(word)):
            return self.near(word)
        return None

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        if len(self.known) > _CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for t in {*tokens}:
            if t not in known:
                known[t] = older[t] if t in older else self.look(t)
        hits = [(i, h) for i, h in enumerate(map(known.__getitem__, tokens)) if h]
        if not hits:
            return [0.0] * (N_FEATURES - 1) + [float(np.log1p(len(tokens)))]
        best: dict[str, float] = {}
        quoted = 0
        for i, (unit, weight, kind) in hits:
            quoted += self.is_quoted(tokens, i)
            best[unit] = max(weight * (MISSPELLED if kind == 2 else 1.0), best.get(unit, 0.0))
        sure = len(hits) - quoted
        return [
            min(sum(best.values()), 15.0), float(min(len(best), 4)), max(best.values()), float(np.log1p(sure)),
            float(np.log1p(100 * sure / len(tokens))), quoted / len(hits), float(np.log1p(len(tokens))),
        ]

    @staticmethod
    def is_quoted(tokens: list[str], i: int) -> bool:
        """Quotation marks open before and close after within the window, or a word of mention stands before."""
        before, after = " ".join([*tokens[max(0, i - WINDOW) : i], tokens[i]]), " ".join(tokens[i : i + WINDOW + 1])
        marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        return marked or any(core(t) in MENTIONS for t in tokens[max(0, i - 3) : i])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and coefficients (the last: intercept) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        keep = np.full(len(w), ridge)
        keep[-1] = 1e-3
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def select_terms(counts: list, toxic: float, clean: float) -> dict[str, float]:
    """counts: (unit, toxic texts, clean texts). Weights (smoothed log odds) of the units whose texts are toxic in most cases, by a likelihood ratio no chance word reaches."""
    base, out = (toxic + 1) / (toxic + clean + 2), {}
    for unit, t, c in counts:
        share = (t + 0.5 * base) / (t + c + 0.5)
        if t >= 3 and share > 0.5:
            ratio = t * np.log(share / base) + c * np.log((1 - share) / (1 - base))
            if ratio > LEAST_RATIO:
                out[unit] = float(min(np.log(share / (1 - share)) - np.log(base / (1 - base)), 6.0))
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:MOST_TERMS])


def train(docs: DataFrame, labels: DataFrame, allowed, doc_id: str, text: str) -> tuple[dict[str, float], frozenset[str], tuple]:
    """Lexicon, words of their own near it, and model from at most MOST_LABELLED labelled rows that `allowed` (a condition on doc_id) admits, taken by a hash of doc_id."""
    picked = labels.where(allowed & F.col("toxic").isNotNull()).groupBy(doc_id).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(doc_id), doc_id).limit(MOST_LABELLED)
    rows = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).join(F.broadcast(picked), doc_id).select(F.col(doc_id).cast("string").alias("id"), "toxic", (F.abs(F.xxhash64(F.lit(7), doc_id)) % 2).cast("int").alias("half"), "data")

    def count(batches: Iterator) -> Iterator:
        sums: dict[tuple, Counter] = {(t, h): Counter() for t in (0, 1) for h in (0, 1)}
        for batch, texts in chunks(batches, "data"):
            for t, h, data in zip(column(batch, "toxic").tolist(), column(batch, "half").tolist(), texts, strict=True):
                words = {core(w) for w in {*data.decode("utf-8", "replace").lower().split()}} - {""}
                sums[t, h].update({u for w in words if len(w) <= 40 for u in units_of(w)})
                sums[t, h][""] += 1
            if sum(map(len, sums.values())) > _COUNTED:
                yield from written(sums)
                sums = {k: Counter() for k in sums}
        yield from written(sums)

    def written(sums: dict) -> Iterator:
        """Every unit that was met, however seldom here: what is seldom in one task may be frequent in all."""
        units = list(set().union(*sums.values()))
        for i in range(0, len(units), 50_000):
            part = units[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([sums[k][u] for u in part], pa.int64()) for k in ((1, 0), (0, 0), (1, 1), (0, 1)))], ["unit", "t0", "c0", "t1", "c1"])

    sums = rows.mapInArrow(count, "unit string, t0 long, c0 long, t1 long, c1 long").groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")))
    worth = (F.col("unit") == "") | ((F.col("t0") + F.col("t1") >= 3) & ((F.col("t0") + F.col("t1")) * 8 > F.col("c0") + F.col("c1")))
    found = sums.where(worth).orderBy(F.col("unit") != "", F.desc(F.col("t0") + F.col("t1") - (F.col("c0") + F.col("c1")) / 8), "unit").limit(16 * MOST_TERMS).collect()
    total = next((r for r in found if r["unit"] == ""), None)
    if total is None or not total["t0"] + total["t1"]:
        return {}, frozenset(), (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), -3.0))
    of = lambda t, c: select_terms([(r["unit"], sum(r[k] for k in t), sum(r[k] for k in c)) for r in found if r["unit"]], sum(total[k] for k in t), sum(total[k] for k in c))
    halves = [of(["t1"], ["c1"]), of(["t0"], ["c0"])]  # features of half 0 by the lexicon of half 1, and so on

    whole = of(["t0", "t1"], ["c0", "c1"])
    terms = Lexicon({t: w for x in (*halves, whole) for t, w in x.items()})

    def neighbours(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data"):
            met: Counter = Counter()
            for t, data in zip(column(batch, "toxic").tolist(), texts, strict=True):
                for w in {core(w) for w in {*data.decode("utf-8", "replace").lower().split()}}:
                    if w and (hit := terms.look(w)) and hit[2] == 2:
                        met[w] += 1 if t == 0 else -1
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "clean"])

    # at most the sample's words within one edit of a term: those that clean texts have as often as toxic ones, or more often
    near = rows.mapInArrow(neighbours, "word string, clean long").groupBy("word").agg(F.sum("clean").alias("clean")).where("clean >= 0")
    own = frozenset(r["word"] for r in near.collect())

    def describe(batches: Iterator) -> Iterator:
        lexicons = [Lexicon(h, own) for h in halves]
        for batch, texts in chunks(batches, "data"):
            x = [lexicons[h].features(d.decode("utf-8", "replace")) for h, d in zip(column(batch, "half").tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "toxic")), pa.array(x, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    table = sorted(rows.mapInArrow(describe, "id string, toxic int, x array<double>").collect())  # sums of floats depend on their order
    return whole, own, fit_logistic(np.array([r["x"] for r in table]), np.array([float(r["toxic"]) for r in table]))


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.3) of every row, and its columns.

    Learns from labels (doc_id, toxic) of rows that aren't held out (crc32 of doc_id as text, modulo 4, is 2). Only the text enters a score. Null or empty text:
    that of a text without hits or words. Null doc_id: not held out, never learnt from. Labels without document, or without toxic, are ignored; repeated ones count as toxic if one is.
    No label of a toxic text: a low constant score. Columns named held_out, score or predicted are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    weights, own, (mean, scale, coefficients) = train(docs, labels, ~held_out(doc_id), doc_id, text)
    model = docs.sparkSession.sparkContext.broadcast((weights, own, mean, scale, coefficients))
    names = docs.columns

    def emit(batches: Iterator) -> Iterator:
        weights, own, mean, scale, coefficients = model.value
        lexicon = Lexicon(weights, own)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            x = np.array([lexicon.features(t or "") for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, len(mean))
            z = ((x - mean) / scale) @ coefficients[:-1] + coefficients[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, "score"])

    out = docs.select(*names).mapInArrow(emit, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("held_out", held_out(doc_id)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
