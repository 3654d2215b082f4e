"""Misspelled terms of the learnt lexicon: they raise the score as the terms do, and nothing else does."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import toxicity

SF = "/root/testdata/sf0.1"
#: English words of the lexicon, which no stem of its own reaches when a letter at the front is wrong.
TERMS = ("idiot", "moron", "clown", "loser", "trash", "stupid", "pathetic", "worthless", "disgusting")


def wrong(word, rng):
    k = rng.randrange(len(word) - 1)
    other = rng.choice("bcdfghjkmpqvwxyz".replace(word[k], ""))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + other + word[k:], word[:k] + other + word[k + 1 :], word[:k] + word[k + 1] + word[k] + word[k + 2 :] if word[k] != word[k + 1] else word[:k] + other + word[k + 1 :]])


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, toxicity.train(docs, labels, ~toxicity.held_out("doc_id"), "doc_id", "text")


def scores_of(spark, model, texts):
    docs, labels, trained = model
    before = toxicity.train
    toxicity.train = lambda *_: trained  # the model as it was fitted, for other texts
    try:
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(rows, labels).collect()}
    finally:
        toxicity.train = before
    return [got[i] for i in range(len(texts))]


def plants(model):
    """(neutral text, with a term, with the term misspelled) at three lengths; the neutral words have neither terms nor what is near one."""
    rng = random.Random(4)
    lexicon = toxicity.Lexicon(model[2][0], model[2][1])
    words = sorted({w for r in model[0].where("doc_id < 300 and lang = 'en'").select("text").collect() for w in r[0].lower().split() if w.isalpha() and lexicon.look(w) is None and w not in toxicity.MENTIONS})
    for size in (5, 60, 300):
        for _ in range(40):
            base = [rng.choice(words) for _ in range(size)]
            # two insults, as the texts that the labels call toxic have
            at, terms = sorted(rng.sample(range(size), 2)), rng.sample(TERMS, 2)
            exact, bad = list(base), list(base)
            for k, term in zip(at, terms):
                exact[k], bad[k] = term, wrong(term, rng)
            yield size, " ".join(base), " ".join(exact), " ".join(bad)


def test_misspelled_terms_raise_the_score(spark, model):
    rows = list(plants(model))
    got = scores_of(spark, model, [t for _, *texts in rows for t in texts])
    neutral, exact, bad = got[::3], got[1::3], got[2::3]
    assert all(b[0] > n[0] for n, b in zip(neutral, bad))
    for size in (5, 60, 300):
        found = [b[1] for (s, *_), b, e in zip(rows, bad, exact) if s == size and e[1]]
        assert sum(found) >= 0.9 * len(found), size
    assert sum(e[1] for e in exact) > 60 and sum(n[1] for n in neutral) == 0


def test_without_the_automaton_they_are_missed(spark, model, monkeypatch):
    class Blind(toxicity.Lexicon):
        def misspelled(self, word):
            return None

    rows = list(plants(model))
    monkeypatch.setattr(toxicity, "Lexicon", Blind)
    got = scores_of(spark, model, [t for _, *texts in rows for t in texts])
    assert sum(b[1] for b, e in zip(got[2::3], got[1::3]) if e[1]) < 0.5 * sum(e[1] for e in got[1::3])


def test_held_out_texts(spark, model):
    docs, labels, _ = model
    got = toxicity.score_toxicity(docs, labels).where("held_out").select("doc_id", "predicted").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 114 and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_swaps_and_own_words():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "moron": 2.0}, frozenset({"oron"}))
    assert [lexicon.look(w) for w in ("idoit", "mroon", "diiot", "idito", "oron", "morom", "idoti")]  # the last: swapped at the end == [("idiot", 3.0, 2), ("moron", 2.0, 2), ("idiot", 3.0, 2), ("idiot", 3.0, 2), None, ("moron", 2.0, 2), ("idiot", 3.0, 2)]
    rng = random.Random(1)
    for term in ("idiot", "moron"):
        for _ in range(200):
            assert (w := wrong(term, rng)) == "oron" or lexicon.look(w)[0] == term


def test_own_words_come_from_clean_texts(spark):
    rows = [(i, f"you blockhead number {i} fellow") if i % 2 else (i, f"a good day near blockheat number {i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    weights, own, _ = toxicity.train(docs, labels, F.lit(True), "doc_id", "text")
    assert "blockhead" in weights and "blockheat" in own and "blockhead" not in own
