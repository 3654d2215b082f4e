"""Gates before pruning: the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_CHARS = 200
MIN_BUDGET = 100
MAX_ORIGINAL_BYTES = 4 << 20
MAX_FRAME_BYTES = 16 << 20
_RETRYABLE = "out of memory|oom|insufficient memory|resource exhausted|failed to allocate|cannot allocate|allocation failed"


def decision(text: Column, question: Column, verbatim: Column, budget: Column, least: int = MIN_CHARS) -> Column:
    """small, verbatim, missing-focus-question, query-too-long, empty (which only shows with least 0, as when the kernel is called directly) or prune."""
    return (
        F.when(text.isNull() | (T.utf16_length(text) < least), "small")
        .when(verbatim, "verbatim")
        .when(question.isNull() | T.is_blank(question), "missing-focus-question")
        .when(budget < MIN_BUDGET, "query-too-long")
        .when(text == "", "empty")
        .otherwise("prune")
    )


def after_scoring(scores: Column, error: Column) -> Column:
    """Why a scored text passes through after all: batch-resource-error, no-scored-chunks, or null."""
    return F.when(is_retryable(error), "batch-resource-error").when(scores.isNull() | (F.size(F.filter(scores, lambda s: s.isNotNull())) == 0), "no-scored-chunks")


def split_by_gate(df: DataFrame, gate: str = "gate") -> tuple[DataFrame, DataFrame]:
    """Rows to score and the rest. Apart, since a scorer in a CASE would still run on the rest."""
    return df.where(F.col(gate) == "prune"), df.where(F.col(gate) != "prune")


def is_retryable(message: Column) -> Column:
    return F.lower(message).rlike(_RETRYABLE)


def original_fits(text: Column) -> Column:
    return F.octet_length(text) <= MAX_ORIGINAL_BYTES
