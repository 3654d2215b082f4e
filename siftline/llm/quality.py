"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model over plain measures of a text (repetition, case, marks, word and line shapes) gives each document its evidence: the log
odds by which it departs from the average. Grouped aggregation of all documents' probabilities gives every host and every path (here: source, and source with
language) a sum and a count. A host's mean is shrunk towards the global one and a path's towards its host's, by Beta priors whose strength is estimated from the spread between
hosts, and between paths of a host; the fewer documents, the more. A document's posterior log odds are its path's (without itself) plus its own evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import work_table
from ._text import chunks, column
from .toxicity import fit_logistic, held_out

#: Bounds of what training brings to the driver: rows of N_MEASURES numbers.
MOST_LABELLED = 20_000
N_MEASURES = 14


def measures(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len({*words})
    upper = sum(map(str.isupper, words))
    again = sum(map(str.__eq__, words, words[1:]))
    ends = text.count(".") + text.count("!") + text.count("?")
    letters = sum(map(str.isalpha, words))
    n1 = max(1, n)
    return [
        float(np.log1p(n)), len(text) / n1, distinct / n1, upper / n1, again / n1, len({*lines}) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        text.count("!") / n1, text.count("|") / n1, float(np.log1p(n / max(1, ends))), letters / n1, sum(map(text.count, "0123456789")) / chars, text.count("http") / n1, sum(map(text.count, "@#$%&*{}<>=_~^")) / chars,
    ]


def _describe(rows: DataFrame, schema: str, carry: list[str], score) -> DataFrame:
    """rows (..., data) to the carried columns and score(matrix of measures)."""

    def emit(batches: Iterator) -> Iterator:
        for batch, texts in chunks(batches, "data"):
            x = np.array([measures(t.decode("utf-8", "replace")) for t in texts]).reshape(len(texts), N_MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), score(x)], [*carry, "out"])

    return rows.mapInArrow(emit, schema)


def _beta_strength(means: DataFrame, parent: str) -> float:
    """Strength of the Beta prior from the spread of groups' means (mean, n) around their parents', beyond what n draws would give; 2 to 10000."""
    n, p = F.col("n"), F.col(parent)
    noise = p * (1 - p)
    r = means.where("n > 1").agg(F.sum(n * (F.col("mean") - p) ** 2).alias("spread"), F.sum(noise).alias("within"), F.sum(n * noise).alias("total")).first()
    if not r or not r["total"]:
        return 20.0
    rho = max(0.0, (r["spread"] - r["within"]) / r["total"])
    return float(min(10_000.0, max(2.0, 1 / rho - 1 if rho > 0 else 10_000.0)))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, text_probability, host_mean, path_mean, score (posterior probability of good quality) and keep (score of 0.5 or more) of every row.

    Learns from at most MOST_LABELLED labels (doc_id, quality) of rows whose doc_id isn't held out (see toxicity), taken by a hash of doc_id. Null or empty text: the measures
    of a text without words. Null host or path: one of its own. Null doc_id: scored, never learnt from. Repeated rows: each is scored and counts. Labels of one class only, or none: the text says nothing, and scores
    are near that class's share (0.5). Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    picked = labels.where(~held_out(doc_id) & F.col("quality").isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min("quality").cast("int").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    known = _describe(rows.join(F.broadcast(picked), "doc_id"), "good int, out array<double>", ["good"], lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))).collect()
    y = np.array([float(r["good"]) for r in known])
    base = (y.sum() + 1) / (len(y) + 2)
    if 0 < y.sum() < len(y):
        mean, scale, w = fit_logistic(np.array([r["out"] for r in known]), y)
    else:
        mean, scale, w = np.zeros(N_MEASURES), np.ones(N_MEASURES), np.append(np.zeros(N_MEASURES), np.log(base / (1 - base)))

    def probability(x: np.ndarray) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -12, 12))))

    scored = work_table(_describe(rows, "doc_id long, host string, path string, out double", ["doc_id", "host", "path"], probability).withColumnRenamed("out", "p"))
    paths = work_table(scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("mean", F.col("s") / F.col("n"))
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0] or base
    k_host = _beta_strength(hosts.withColumn("all", F.lit(total)), "all")
    hosts = hosts.select("host", ((F.col("s") + k_host * total) / (F.col("n") + k_host)).alias("host_mean"))
    paths = paths.join(hosts, "host")
    k_path = _beta_strength(paths.withColumn("mean", F.col("s") / F.col("n")), "host_mean")
    logit = lambda c: F.ln(c / (1 - c))
    others = (F.col("s") - F.col("p") + k_path * F.col("host_mean")) / (F.col("n") - 1 + k_path)
    joined = scored.join(paths, ["host", "path"]).withColumn("path_mean", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others)))
    odds = logit(F.col("p")) - float(np.log(total / (1 - total))) + logit(F.col("path_mean"))
    known_name = lambda c: F.when(F.col(c) != "\0", F.col(c)).alias(c)
    out = joined.select("doc_id", known_name("host"), known_name("path"), F.col("p").alias("text_probability"), "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("score"))
    return out.withColumn("keep", F.col("score") >= 0.5)
