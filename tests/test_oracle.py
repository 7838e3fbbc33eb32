"""Every registered query of the library against its SQL on DuckDB, at the smallest size."""

from __future__ import annotations

import os

import duckdb
import pytest

from lexmill.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


#: Queries that SQL cannot express here, and the test that holds them against expected results or brute force.
ELSEWHERE = {
    "cor_check_text": "test_span_resolution_is_greedy_and_disjoint", "cor_severity": "test_severity_and_apply", "dml_batch_correct": "test_severity_and_apply", "src_html": "test_parsers", "src_web_extract": "test_parsers", "win_greedy_nonoverlap": "test_span_resolution_is_greedy_and_disjoint",
    "txt_normalize": "test_structure", "con_check": "test_consistency_and_headings_read_whole_texts", "win_budget": "test_budgets_by_force", "win_heading_chain": "test_consistency_and_headings_read_whole_texts", "fn_amount_cn": "test_numerals", "fn_cn_numbers": "test_numerals",
    "fn_clean": "test_clean_and_control_characters", "sim_hash64": "test_similarity", "sim_pairs": "test_sim_pairs_reads_documents_of_any_length", "sim_diff_lines": "test_sim_diff_lines_reads_every_id", "sim_jaccard": "test_similarity_by_force", "txt_genre_rank": "test_genres_by_force",
}


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    if name not in SQL:
        assert f"def {ELSEWHERE[name]}(" in open(f"{os.path.dirname(__file__)}/test_library.py").read()
        assert len(set(cols)) == len(cols)
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)
