"""Line scorers by name: (lines, question) -> array of scores. Register further ones, such as an Arrow UDF around a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Scorer = Callable[[Column, Column], Column]
_scorers: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    _scorers[name] = scorer


def get(name: str) -> Scorer:
    return _scorers[name]


register("lexical", lambda lines, question: T.let(T.query_tokens(question), lambda known: F.transform(lines, lambda x: F.when(T.is_relevant(x, known), 1.0).otherwise(0.0))))
register("constant", lambda lines, question: F.transform(lines, lambda x: F.lit(1.0)))
register("drop", lambda lines, question: F.transform(lines, lambda x: F.when(F.replace(x, F.lit(" the"), F.lit("")) == x, 1.0).otherwise(0.0)))


def score_batches(df: DataFrame, text: str, score: Callable[[list], list], schema: str, size: int, retryable: tuple[type[Exception], ...]) -> DataFrame:
    """df with the columns of schema (one, which score gives for each text of a batch of up to `size`) and retried.

    A batch that fails with a retryable error is scored text by text, and its rows are marked; another error, or a text's own, ends the task with what was asked and done. Batches are made of the
    rows that stand together in a partition, so which rows are marked depends on how they are dealt; scores don't.
    """
    from .repair import with_retries

    name = schema.split()[0]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), schema, "retried boolean"])

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            texts = pdf[text].tolist()
            done = list(with_retries([texts[i : i + size] for i in range(0, len(texts), size)], score, lambda e: isinstance(e, retryable)))
            yield pdf.assign(**{name: [s for s, _ in done], "retried": [r for _, r in done]})

    return df.mapInPandas(run, fields)
