"""Documents without text: queries over lines against their SQL twins, for which an empty text has an empty line and null has none."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

TEXTS = ["", None, "", "  ", "\n", "\n\n", "a\n\nthanea b c", "  \nshouha\n", "x\n" * 9 + "says ration\n", "ration " * 600, ""]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def plain(value):
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", [
    "gap_islands", "line_index", "mask_compare", "mask_summary", "prune_kernel", "prune_lexical", "prune_report", "prune_stats", "repair_gap_render", "repair_python", "scorer_matrix", "threshold_mask", "viterbi_blocks",
    "gap_bridge", "line_scores", "merge_overlap_scores", "must_contain", "prune_trace_render", "python_nodes", "repair_closure", "report_merge", "scope_lines", "viterbi_decode",
])
def test_as_sql(spark, odd, name):
    got = __spark_entry__.queries()[name](spark, odd)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    at = [got.columns.index(d[0]) for d in found.description]
    want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    assert want and Counter(tuple(plain(r[k]) for k in at) for r in got.collect()) == want


def test_tokenizer_windows(spark, odd):
    rows = __spark_entry__.queries()["tokenizer_windows"](spark, odd).collect()
    empty = [tuple(r)[1:] for r in rows if r["doc_id"] in (0, 2, 10)]
    assert empty == [("char", 0, 0, 0, 0)] * 3
    assert {r["doc_id"] for r in rows if r["tokenizer"] == "word"} == {6, 7, 8, 9} and not [r for r in rows if r["doc_id"] == 1]
