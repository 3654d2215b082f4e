"""Status texts of a session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import compact_count, dollar_range

MODES = ("chars", "tokens", "cost", "compact")
_DOT = " · "


def is_mode(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(*MODES)


def next_mode(mode: Column) -> Column:
    return F.element_at(F.lit(list(MODES)), (F.pmod(F.array_position(F.lit(list(MODES)), mode), F.lit(len(MODES))) + 1).cast("int"))


def visual_state(on: Column, backend: Column, busy: Column) -> Column:
    return F.when(~on, "off").when(backend == "failed", "failed").when(busy > 0, "busy").when(backend == "resident", "resident").otherwise("loading")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def fitting(columns: Column, *forms: Column) -> Column:
    """The first form that fits the columns with an indicator before it, else the last."""
    out = forms[-1]
    for form in reversed(forms[:-1]):
        out = F.when(F.length(form) + 2 <= columns - 1, form).otherwise(out)
    return out


def status_line(name: Column, saved_chars: Column, calls: Column, columns: Column) -> Column:
    count = compact_count(saved_chars)
    full = F.concat_ws(_DOT, name, F.concat(count, F.lit(" chars trimmed")), plural(calls, "prune"))
    return fitting(columns, full, F.concat_ws(_DOT, name, F.concat(count, F.lit("c")), F.concat(calls.cast("string"), F.lit("p"))), name)


def token_line(name: Column, saved_tokens: Column, calls: Column, columns: Column) -> Column:
    count = F.concat(F.lit("~"), compact_count(saved_tokens))
    full = F.concat_ws(_DOT, name, F.concat(count, F.lit(" input tokens avoided")), plural(calls, "prune"))
    return fitting(columns, full, F.concat_ws(_DOT, name, F.concat(count, F.lit("t")), F.concat(calls.cast("string"), F.lit("p"))), name)


def compact_line(name: Column, saved_chars: Column, calls: Column, columns: Column) -> Column:
    return fitting(columns, F.concat_ws(_DOT, name, F.concat(compact_count(saved_chars), F.lit("c")), F.concat(calls.cast("string"), F.lit("p"))), name)


def cost_line(name: Column, low: Column, high: Column, calls: Column, columns: Column) -> Column:
    """As token_line, for costs; the name alone as long as nothing has a price."""
    cost = dollar_range(low, high)
    full = F.concat_ws(_DOT, name, F.concat(cost, F.lit(" input cost avoided")), plural(calls, "prune"))
    return F.when(cost.isNull(), name).otherwise(fitting(columns, full, F.concat_ws(_DOT, name, cost), name))


def summary(decision: Column, reason: Column, before: Column, after: Column, millis: Column, backend: Column) -> Column:
    """decision (reason) · in -> out chars · ms · backend; what is null is left out."""
    sizes = F.concat(before.cast("string"), F.lit(" -> "), after.cast("string"), F.lit(" chars"))
    return F.concat_ws(_DOT, F.when(reason.isNotNull(), F.concat(decision, F.lit(" ("), reason, F.lit(")"))).otherwise(decision), sizes, F.concat(millis.cast("string"), F.lit(" ms")), backend)


def failure_text(error: Column) -> Column:
    return F.concat(F.lit("pruning failed: "), error, F.lit("; original output follows"))
