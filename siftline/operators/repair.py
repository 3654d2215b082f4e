"""Repair of line masks of Python sources, so that what is kept still parses; and tag decoding. Both are procedural: Arrow batches of pandas.

A source's tree is turned into rules once: kept lines in a range, or a name among the kept lines' identifiers, call for further lines. The mask
grows by them until nothing changes. All rules only add lines, so their order doesn't matter.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import by_stretches

_NAME = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b")
_CONTINUES = re.compile(r"\s*(?:elif|else|except|finally)(?:\s*$|[ :(])")
_SCOPES = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith)
_TRIES = (ast.Try, ast.TryStar)
MARKER = "[pruned]"


@dataclass
class Rule:
    first: int
    last: int
    lines: set[int] = field(default_factory=set)
    reason: str = ""
    name: str | None = None  # instead of lines in the range: this identifier is kept somewhere


def _top(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def _head(node: ast.stmt, first: int) -> set[int]:
    return set(range(first, max(node.lineno, node.body[0].lineno - 1) + 1))


def _span(node: ast.stmt) -> set[int]:
    return set(range(node.lineno, node.end_lineno + 1))


def _shell(node: ast.ClassDef, reason: str) -> list[tuple[set[int], str]]:
    """A class's head, fields and passes, each with its reason."""
    kinds = {"field": (ast.Assign, ast.AnnAssign), "pass": (ast.Pass,)}
    inner = [(set().union(*(_span(c) for c in node.body if isinstance(c, types))), f"{reason}:{kind}") for kind, types in kinds.items()]
    return [(_head(node, _top(node)), reason), *(x for x in inner if x[0])]


def parsed(code: str | None) -> ast.Module | None:
    """The tree of a source; None for null, for what doesn't parse, and for what is nested too deep for the parser."""
    try:
        return None if code is None else ast.parse(code)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None


def keyword_line(lines: list[str], block: list[ast.stmt], word: str) -> int | None:
    """The line above a block that begins with the word and a colon."""
    return next((n for n in range(block[0].lineno - 1, 0, -1) if re.match(rf"\s*{word}\s*:", lines[n - 1])), None)


def _word_above(lines: list[str], block: list[ast.stmt], word: str) -> set[int]:
    return {n for n in [keyword_line(lines, block, word) if block else None] if n}


def rules_of(tree: ast.Module, lines: list[str]) -> list[Rule]:
    rules = []
    for node in ast.walk(tree):
        if not isinstance(node, ast.stmt):
            continue
        if isinstance(node, ast.ClassDef):
            rules += [Rule(_top(node), node.end_lineno, *part) for part in _shell(node, "enclosing_class")]
        elif isinstance(node, _SCOPES):
            rules.append(Rule(_top(node), node.end_lineno, _head(node, _top(node)), "enclosing_definition"))
        elif isinstance(node, _FLOW):
            rules.append(Rule(node.lineno, node.end_lineno, _head(node, node.lineno), "enclosing_control_flow"))
        elif isinstance(node, _TRIES):
            parts = {"control_flow": {node.lineno}, "try:except": set().union(*(_head(h, h.lineno) for h in node.handlers)), "try:else": _word_above(lines, node.orelse, "else"), "try:finally": _word_above(lines, node.finalbody, "finally")}
            rules += [Rule(node.lineno, node.end_lineno, found, f"enclosing_{kind}") for kind, found in parts.items() if found]
        elif node.end_lineno > node.lineno:
            rules.append(Rule(node.lineno, node.end_lineno, _span(node), "statement_integrity"))
    symbols: dict[str, ast.stmt] = {}
    for node in tree.body:
        for target in node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []:
            if isinstance(target, ast.Name):
                symbols[target.id] = node
        if isinstance(node, _SCOPES):
            symbols[node.name] = node
    for name, node in symbols.items():
        reason = f"referenced_top_level:{name}"
        if not isinstance(node, ast.ClassDef):
            rules.append(Rule(0, 0, set(range(_top(node), node.lineno + 1)), reason, name))
            continue
        rules += [Rule(0, 0, *part, name) for part in _shell(node, reason)]
        for child in node.body:
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                whole = set(range(_top(child), child.end_lineno + 1))
                own = (0, 0) if child.name == "__init__" else (child.lineno, child.end_lineno)
                rules.append(Rule(*own, whole, f"{reason}:method", name))
    return rules


def grow(kept: set[int], lines: list[str], tree: ast.Module) -> dict[int, set[str]]:
    """All lines to keep, with reasons."""
    reasons = {n: {"semantic"} for n in kept}
    open_rules, grew = rules_of(tree, lines), True
    while grew:
        grew, waiting = False, []
        names = {x for n in reasons for x in _NAME.findall(lines[n - 1])}
        for rule in open_rules:
            if (rule.name is None or rule.name in names) and (not rule.last or any(rule.first <= n <= rule.last for n in reasons)):
                grew = grew or not rule.lines <= reasons.keys()
                for n in rule.lines:
                    reasons.setdefault(n, set()).add(rule.reason)
            else:
                waiting.append(rule)
        open_rules = waiting
    names = {x for n in reasons for x in _NAME.findall(lines[n - 1])}
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            plain = isinstance(node, ast.Import)
            if names & {a.asname or (a.name.split(".")[0] if plain else a.name) for a in node.names}:
                for n in _span(node):
                    reasons.setdefault(n, set()).add("referenced_import")
    return reasons


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def render(lines: list[str], kept: set[int]) -> str:
    """Kept lines; a gap becomes an indented [pruned] unless its own lines are shorter. Every gap follows one rule, the last too."""
    out, before = [], 0
    numbers = sorted(kept)
    for k, n in enumerate([*numbers, len(lines) + 1]):
        gap = lines[before : n - 1]
        if gap:
            upper = lines[before - 1] if before else None
            lower = next((lines[m - 1] for m in numbers[k:] if lines[m - 1].strip()), lines[n - 1] if n <= len(lines) else None)
            if upper is not None and upper.split("#", 1)[0].rstrip().endswith(":"):
                indent = _indent(upper) + "    "
            elif lower is not None and not _CONTINUES.match(lower):
                indent = _indent(lower)
            else:
                indent = _indent(upper) if upper is not None else ""
            out += [indent + MARKER] if sum(map(len, gap)) + len(gap) >= len(indent + MARKER) else gap
        if n <= len(lines):
            out.append(lines[n - 1])
        before = n
    return "\n".join(out)


def _parses(code: str | None) -> bool:
    return parsed(code) is not None


def repair(code: str, kept: list[int]) -> dict:
    """kept, reasons (line: sorted list), code and parses; status ok, input-parse-failed or repair-parse-failed. On failure, null code included, callers use the unrepaired text."""
    lines = (code or "").splitlines()
    start = {int(n) for n in kept if n is not None and 1 <= n <= len(lines)}
    tree = parsed(code)
    if tree is None:
        return {"kept": sorted(start), "reasons": {}, "code": None, "parses": False, "status": "input-parse-failed"}
    reasons = grow(start, lines, tree)
    out = render(lines, set(reasons))
    ok = _parses(out)
    return {"kept": sorted(reasons), "reasons": {n: sorted(r) for n, r in reasons.items()}, "code": out, "parses": ok, "status": "ok" if ok else "repair-parse-failed"}


def nodes(code: str) -> list[tuple[int, int, str, str | None]]:
    """first line, last line, kind and name of every statement of a source, outermost first; none if it is null or doesn't parse."""
    tree = parsed(code)
    if tree is None:
        return []
    return [(_top(n), n.end_lineno, type(n).__name__, getattr(n, "name", None)) for n in ast.walk(tree) if isinstance(n, ast.stmt)]


def nodes_udf(code: Column | str) -> Column:
    """nodes() on columns: explode it for a row a node."""
    return F.pandas_udf(lambda codes: codes.map(nodes), "array<struct<first:int,last:int,kind:string,name:string>>")(code)


_REPAIRED = pa.struct([("kept", pa.list_(pa.int32())), ("reasons", pa.map_(pa.int32(), pa.list_(pa.string()))), ("code", pa.string()), ("parses", pa.bool_()), ("status", pa.string())])


def _repairs(code: pa.Array, kept: pa.Array) -> pa.Array:
    found = (repair(c, k or []) for c, k in zip(code.to_pylist(), kept.to_pylist(), strict=True))
    return pa.array([r | {"reasons": list(r["reasons"].items())} for r in found], _REPAIRED)


def repair_udf(code: Column | str, kept: Column | str) -> Column:
    """repair() on columns, stretch by stretch of a batch: reasons are many times as long as the code."""

    def repairs(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return by_stretches(_repairs, columns)

    return F.arrow_udf(repairs, "struct<kept:array<int>,reasons:map<int,array<string>>,code:string,parses:boolean,status:string>")(code, kept)


def may_be_python(text: Column) -> Column:
    """A cheap test before the tree is built."""
    return text.contains("def ") | text.contains("class ") | text.contains("import ")


def _all_parse(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and _parses("\n".join(_indent(x) + "pass" if x.strip().startswith((MARKER[:-1], "(filtered ")) else x for x in t.splitlines())))


def parses_udf(text: Column | str) -> Column:
    """Python, with marker lines read as pass. Filter by may_be_python first."""
    return F.pandas_udf(_all_parse, "boolean")(text)


def viterbi(emissions, transitions, start, end) -> list[int]:
    """The best tag sequence of a linear-chain field; of equal ones the lower tag."""
    e, t = np.array([list(x) for x in emissions]), np.array([list(x) for x in transitions])
    if not len(e):
        return []
    score, back = np.asarray(start) + e[0], []
    for row in e[1:]:
        paths = score[:, None] + t
        back.append(paths.argmax(0))
        score = paths.max(0) + row
    tags = [int((score + np.asarray(end)).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class BatchFailed(RuntimeError):
    """An item of a retried batch failed on its own: how many items there were, how many had been scored, and both errors."""

    def __init__(self, size: int, done: int, first: Exception, last: Exception):
        super().__init__(f"item {done + 1} of a batch of {size} failed alone: {last!r}; the batch before: {first!r}")
        self.size, self.done, self.first, self.last = size, done, first, last


def with_retries(batches: list[list], score, is_retryable) -> Iterator[tuple[object, bool]]:
    """Scores of items batch by batch; a batch that fails retryably is scored item by item. Yields (score, whether it was retried); other errors are raised, and an item's own as BatchFailed."""
    for batch in batches:
        try:
            results = [(r, False) for r in score(batch)]
        except Exception as error:
            if len(batch) < 2 or not is_retryable(error):
                raise
            results = []
            for x in batch:
                try:
                    results.append((score([x])[0], True))
                except Exception as own:
                    raise BatchFailed(len(batch), len(results), error, own) from own
        yield from results
