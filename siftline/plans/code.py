"""Queries over Python sources: their statements as rows, the scopes that hold a line, and the closure of a mask.

The tables have no sources, so each document gives a module: a definition, class, assignment or import with a try statement for every line, named after words of
the line, so that modules differ as documents do and refer to themselves as words recur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, repair, syntax
from .catalog import LINES, query, text_lines, texts

#: A line's source lines by kind; {a} and {b} are its first two words.
UNITS = (
    ("@mark", "def f_{a}(x,", "        y):", "    if x:", "        return f_{b}(y)", "    return v_{b}", ""),
    ("class c_{a}(Base):", "    size = f_{b}", "    note: int = (1,", "        2)", "    def __init__(self):", "        self.x = 0", "    def run(self):", "        return c_{b}", ""),
    ("v_{a} = call(", "    f_{b},", "    c_{b})", ""),
    ("import m_{a} as g_{a}", "try:", "    f_{b}()", "except (A,", "        B):", "    pass", "else:", "    g_{b}()", "finally:", "    done()"),
)
#: SQL: a row a unit: document, number, kind, words and the lines before it.
_UNITS = f"""{LINES},
U0 AS (SELECT doc_id, n, (n + doc_id) % 4 AS kind, regexp_extract(lower(line), '[a-z]{{{{3,}}}}') AS w, regexp_extract(lower(line), '[a-z]{{{{3,}}}}[^a-z]+([a-z]{{{{3,}}}})', 1) AS v FROM L),
U AS (SELECT doc_id, n AS i, kind, CASE WHEN w = '' THEN 'none' ELSE w END AS a, CASE WHEN v = '' THEN 'other' ELSE v END AS b,
  CAST(coalesce(sum({list(map(len, UNITS))}[kind + 1]) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS o FROM U0)""".replace("{{", "{").replace("}}", "}")


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def modules(spark, sf_dir):
    """source (the document's id), code and size (lines)."""
    rows = texts(spark, sf_dir).select("doc_id", F.transform(text_lines(), lambda x, i: F.struct(F.lower(x).alias("x"), ((i + 1 + F.col("doc_id")) % 4).alias("kind"))).alias("units"))
    word = lambda x, pattern, group, default: F.coalesce(F.nullif(F.regexp_extract(x, pattern, group), F.lit("")), F.lit(default))

    def written(u):
        a, b = word(u["x"], "[a-z]{3,}", 0, "none"), word(u["x"], "[a-z]{3,}[^a-z]+([a-z]{3,})", 1, "other")
        body = F.element_at(F.lit(["\n".join(x) for x in UNITS]), (u["kind"] + 1).cast("int"))
        return F.replace(F.replace(body, F.lit("{a}"), a), F.lit("{b}"), b)

    code = F.array_join(F.transform("units", written), "\n")
    return rows.select(F.col("doc_id").alias("source"), code.alias("code"), F.size(T.lines(code)).alias("size"))


def _asked(sources):
    """The lines asked for: one of 23."""
    return sources.select("source", F.explode(F.filter(F.sequence(F.lit(1), "size"), lambda n: (n * 7 + F.col("source")) % 23 == 0)).alias("n"))


#: a last empty line is none
_ASKED = "A AS (SELECT doc_id, n FROM (SELECT doc_id, unnest(range(1, CAST(sum(" + str(list(map(len, UNITS))) + "[kind + 1]) AS BIGINT) + CASE WHEN arg_max(kind, i) = 3 THEN 1 ELSE 0 END)) AS n FROM U GROUP BY doc_id) WHERE (n * 7 + doc_id) % 23 = 0)"
#: kind, part, statement, name, first, line, head, last: the statements of each kind of unit.
_NODES = _values("N", "kind, part, stmt, name, first, line, head, last", [
    (0, "statement", "FunctionDef", "f_", 1, 2, 3, 6), (0, "statement", "If", None, 4, 4, 4, 5), (0, "statement", "Return", None, 5, 5, None, 5), (0, "statement", "Return", None, 6, 6, None, 6),
    (1, "statement", "ClassDef", "c_", 1, 1, 1, 8), (1, "statement", "Assign", None, 2, 2, None, 2), (1, "statement", "AnnAssign", None, 3, 3, None, 4), (1, "statement", "FunctionDef", "__init__", 5, 5, 5, 6),
    (1, "statement", "Assign", None, 6, 6, None, 6), (1, "statement", "FunctionDef", "run", 7, 7, 7, 8), (1, "statement", "Return", None, 8, 8, None, 8), (2, "statement", "Assign", None, 1, 1, None, 3),
    (3, "statement", "Import", None, 1, 1, None, 1), (3, "statement", "Try", None, 2, 2, 2, 10), (3, "statement", "Expr", None, 3, 3, None, 3), (3, "statement", "Pass", None, 6, 6, None, 6),
    (3, "statement", "Expr", None, 8, 8, None, 8), (3, "statement", "Expr", None, 10, 10, None, 10), (3, "except", "Try", None, 4, 4, 5, 6), (3, "else", "Try", None, 7, 7, 7, 7), (3, "finally", "Try", None, 9, 9, 9, 9),
])
_PLACED = "T AS (SELECT doc_id, part, stmt AS kind, CASE WHEN suffix(name, '_') AND NOT prefix(name, '_') THEN name || a ELSE name END AS name, first + o AS first, line + o AS line, head + o AS head, last + o AS last FROM U JOIN N USING (kind))"


@query(f"WITH {_UNITS}, {_NODES}, {_PLACED} SELECT doc_id, part, kind, name, first, line, head, last FROM T")
def python_nodes(spark, sf_dir):
    found = syntax.python_nodes(modules(spark, sf_dir))
    return found.select(F.col("source").alias("doc_id"), "part", "kind", "name", "first", "line", "head", "last")


@query(f"WITH {_UNITS}, {_NODES}, {_PLACED}, {_ASKED} SELECT T.doc_id, first, last, kind, count(*) AS lines FROM T JOIN A ON A.doc_id = T.doc_id AND A.n BETWEEN first AND last WHERE part = 'statement' AND kind <> 'Return' GROUP BY ALL")
def scope_lines(spark, sf_dir):
    sources = modules(spark, sf_dir)
    scopes = syntax.python_nodes(sources).where("part = 'statement' AND kind <> 'Return'")
    found = intervals.interval_counts(scopes, _asked(sources), ["source"], ["first", "last", "kind"])
    return found.select(F.col("source").alias("doc_id"), "first", "last", "kind", F.col("points").alias("lines"))


#: kind, the lines that call for it, the lines that are kept, why. A class's own head has its name, so its methods with a kept line are always whole, if it is the last of its name.
_RANGES = _values("RR", "kind, first, last, lo, hi, reason", [
    (0, 1, 6, 1, 3, "enclosing_definition"), (0, 4, 5, 4, 4, "enclosing_control_flow"),
    (1, 1, 8, 1, 1, "enclosing_class"), (1, 1, 8, 2, 2, "enclosing_class:field"), (1, 1, 8, 3, 4, "enclosing_class:field"), (1, 3, 4, 3, 4, "statement_integrity"), (1, 5, 6, 5, 5, "enclosing_definition"), (1, 7, 8, 7, 7, "enclosing_definition"),
    (2, 1, 3, 1, 3, "statement_integrity"),
    (3, 2, 10, 2, 2, "enclosing_control_flow"), (3, 2, 10, 4, 5, "enclosing_try:except"), (3, 2, 10, 7, 7, "enclosing_try:else"), (3, 2, 10, 9, 9, "enclosing_try:finally"),
])
#: kind, prefix of the name that calls for it, lines, and what follows the name in the reason.
_NAMED = _values("RN", "kind, mark, lo, hi, tail", [(0, "f_", 1, 2, ""), (1, "c_", 1, 1, ""), (1, "c_", 2, 2, ":field"), (1, "c_", 3, 4, ":field"), (1, "c_", 5, 6, ":method"), (2, "v_", 1, 1, "")])
#: kind, line, prefix and which word: the names that lines have.
_USES = _values("RU", "kind, at, mark, which", [(0, 2, "f_", 0), (0, 5, "f_", 1), (0, 6, "v_", 1), (1, 1, "c_", 0), (1, 2, "f_", 1), (1, 8, "c_", 1), (2, 1, "v_", 0), (2, 2, "f_", 1), (2, 3, "c_", 1), (3, 1, "g_", 0), (3, 3, "f_", 1), (3, 8, "g_", 1)])
_CLOSURE = f"""WITH RECURSIVE {_UNITS}, {_ASKED}, {_RANGES}, {_NAMED}, {_USES},
W AS (SELECT doc_id, kind, a, max(i) AS i FROM U WHERE kind < 3 GROUP BY ALL),
NR AS (SELECT U.doc_id, mark || U.a AS name, lo + o AS lo, hi + o AS hi, 'referenced_top_level:' || mark || U.a || tail AS reason FROM U JOIN W ON W.doc_id = U.doc_id AND W.i = U.i JOIN RN ON RN.kind = U.kind),
RG AS (SELECT doc_id, first + o AS first, last + o AS last, lo + o AS lo, hi + o AS hi, reason FROM U JOIN RR USING (kind)
  UNION ALL SELECT U.doc_id, 7 + o, 8 + o, 7 + o, 8 + o, 'referenced_top_level:c_' || U.a || ':method' FROM U JOIN W ON W.doc_id = U.doc_id AND W.i = U.i WHERE U.kind = 1),
LN AS (SELECT doc_id, at_ + o AS n, mark || CASE WHEN which = 0 THEN a ELSE b END AS name FROM U JOIN (SELECT kind, "at" AS at_, mark, which FROM RU) USING (kind)),
E AS (SELECT doc_id, unnest(range(first, last + 1)) AS n, lo, hi, reason FROM RG UNION ALL SELECT LN.doc_id, n, lo, hi, reason FROM LN JOIN NR ON NR.doc_id = LN.doc_id AND NR.name = LN.name),
S AS (SELECT DISTINCT doc_id, n, unnest(range(lo, hi + 1)) AS m FROM E),
K AS (SELECT doc_id, n FROM A UNION SELECT S.doc_id, S.m FROM K JOIN S ON S.doc_id = K.doc_id AND S.n = K.n),
Z AS (SELECT doc_id, n, 'semantic' AS reason FROM A
  UNION SELECT E.doc_id, unnest(range(lo, hi + 1)), reason FROM E JOIN K ON K.doc_id = E.doc_id AND K.n = E.n
  UNION SELECT U.doc_id, 1 + o, 'referenced_import' FROM U JOIN LN ON LN.doc_id = U.doc_id AND LN.name = 'g_' || a JOIN K ON K.doc_id = LN.doc_id AND K.n = LN.n WHERE kind = 3)
SELECT doc_id, n, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM Z GROUP BY ALL""".replace('kind, at, mark, which', 'kind, "at", mark, which')


@query(_CLOSURE)
def repair_closure(spark, sf_dir):
    sources = modules(spark, sf_dir)
    return syntax.closure(sources, _asked(sources)).select(F.col("source").alias("doc_id"), F.col("n").cast("long"), F.array_join("reasons", ",").alias("reasons"))


_KEPT = _CLOSURE[: _CLOSURE.index("\nSELECT doc_id, n, string_agg")] + ", KK AS (SELECT DISTINCT doc_id, n FROM Z)"


def _repaired(spark, sf_dir):
    """The same masks, repaired source by source."""
    asked = F.filter(F.sequence(F.lit(1), "size"), lambda n: (n * 7 + F.col("source")) % 23 == 0)
    rows = modules(spark, sf_dir).where("size > 0").select(F.col("source").alias("doc_id"), "code", asked.alias("asked"))
    return rows.withColumn("r", repair.repair_udf("code", "asked"))


@query(f"{_KEPT} SELECT doc_id, count(A.n) AS asked, count(KK.n) AS kept, true AS parsed FROM (SELECT DISTINCT doc_id FROM U) LEFT JOIN KK USING (doc_id) LEFT JOIN A USING (doc_id, n) GROUP BY doc_id")
def repair_python(spark, sf_dir):
    return _repaired(spark, sf_dir).select("doc_id", F.size("asked").cast("long").alias("asked"), F.size("r.kept").cast("long").alias("kept"), (F.col("r.status") != "input-parse-failed").alias("parsed"))


_TEXTS = _values("CT", "kind, pos, t", [(k, i, line.replace("'", "''")) for k, unit in enumerate(UNITS) for i, line in enumerate(unit, 1)])


@query(f"""{_KEPT}, {_TEXTS},
C0 AS (SELECT doc_id, pos + o AS n, replace(replace(t, '{{a}}', a), '{{b}}', b) AS line FROM U JOIN CT USING (kind)),
C1 AS (SELECT C0.*, KK.n IS NOT NULL AS k FROM C0 JOIN (SELECT doc_id, max(n) AS m, arg_max(line, n) AS z FROM C0 GROUP BY doc_id) USING (doc_id) LEFT JOIN KK ON KK.doc_id = C0.doc_id AND KK.n = C0.n WHERE C0.n < m OR z <> ''),
C2 AS (SELECT *, sum(CASE WHEN k THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island, regexp_extract(line, '^\\s*') AS indent,
  min(CASE WHEN k AND trim(line) <> '' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS anchor,
  min(CASE WHEN k THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM C1),
GP AS (SELECT doc_id, island, sum(length(line)) + count(*) AS chars, string_agg(line, chr(10) ORDER BY n) AS body, min(CASE WHEN nxt IS NULL THEN NULL ELSE coalesce(anchor, nxt) END) AS anchor FROM C2 WHERE NOT k GROUP BY ALL),
MK AS (SELECT GP.*, CASE WHEN suffix(rtrim(p.line), ':') THEN p.indent || '    ' WHEN q.line IS NOT NULL AND NOT regexp_matches(trim(q.line), '^(elif|else|except|finally)($|[ :(])') THEN q.indent WHEN p.line IS NOT NULL THEN p.indent ELSE '' END || '[pruned]' AS mark
  FROM GP LEFT JOIN C2 p ON p.doc_id = GP.doc_id AND p.island = GP.island AND p.k LEFT JOIN C2 q ON q.doc_id = GP.doc_id AND q.n = GP.anchor),
PC AS (SELECT doc_id, island * 2 AS pos, line AS s, 0 AS marks FROM C2 WHERE k UNION ALL SELECT doc_id, island * 2 + 1, CASE WHEN chars >= length(mark) THEN mark ELSE body END, CASE WHEN chars >= length(mark) THEN 1 ELSE 0 END FROM MK)
SELECT doc_id, sha256(string_agg(s, chr(10) ORDER BY pos)) AS sha, CAST(sum(marks) AS BIGINT) AS markers FROM PC GROUP BY doc_id""")
def repair_gap_render(spark, sf_dir):
    code = F.col("r.code")
    return _repaired(spark, sf_dir).select("doc_id", F.sha2(code, 256).alias("sha"), F.regexp_count(code, F.lit(r"\[pruned\]")).cast("long").alias("markers"))
