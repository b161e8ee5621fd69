"""A sample of registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tools.check_oracle import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "vector_topk", "rrf_fusion", "retrieval_evaluation_by_question", "coarse_clean", "split_children",
    "history_newest_that_fit", "exact_answer_reuse", "daily_quota", "message_feedback", "parent_integrity", "validation_errors",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want


def test_registry_is_consistent():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 180
