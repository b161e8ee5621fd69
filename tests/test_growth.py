"""Work that must not grow faster than the tables: what is left out, not moved twice, or done in the row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import chunking as C
from askloom.operators import pages as P
from askloom.operators import similar as S
from askloom.operators import vectors as VS


def test_only_documents_of_several_parents_are_compared(spark, monkeypatch):
    seen = []

    def spy(df, *args):
        seen.extend(r.document_id for r in df.collect())
        return df

    monkeypatch.setattr(C, "keep_first", spy)
    two = "# 标题一\n" + "甲" * 120 + "\n# 标题二\n" + "乙" * 120
    docs = spark.createDataFrame([(1, "one plain parent"), (2, two), (3, " ")], "document_id bigint, text string")
    got = sorted((r.document_id, r.parent_no) for r in C.parent_table(docs).collect())
    assert got == [(1, 0), (2, 0), (2, 1)] and set(seen) == {2}


@pytest.mark.parametrize("white", [" ", "　", "\x85", " ", " \r\n"])
def test_strip_and_hints_know_every_white_space(one, white):
    assert one(f"{white}a{white}b{white}", X.strip) == f"a{white}b"
    assert one(f"x\n{white}（一）y", lambda c: X.may_start(c, ["^[（(][一二]+[）)]\\s*"]))
    assert not one("x （一）y", lambda c: X.may_start(c, ["^[（(][一二]+[）)]\\s*"]))


def test_distinct_parents_take_texts_once(spark):
    chunks = spark.createDataFrame([(1, "p0"), (1, "p0"), (2, "p0")], "document_id bigint, parent_id string")
    parents = spark.createDataFrame([(1, "p0", "a"), (2, "p0", "b"), (3, "p0", "c")], "document_id bigint, parent_id string, parent_content string")
    got = C.distinct_parents(chunks, parents)
    assert sorted(map(tuple, got.collect())) == [(1, "p0", "a"), (2, "p0", "b")]


def test_extraction_is_chosen_in_the_row(spark):
    good, long = "学" * 60, "x1 " * 40
    rows = [(1, "短", good, long), (2, "短", "1", long), (3, None, None, None), (4, good, good + "习", long)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string").select("id", P.pick_extraction([F.col("a"), F.col("b"), F.col("c")]).alias("t"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.t for r in df.collect()} == {1: good, 2: long, 3: None, 4: good}


@pytest.mark.parametrize("block", [2, 64])
def test_similarity_to_previous_with_gaps(spark, block):
    rows = [(1, "abcd"), (2, "abcd"), (5, "bcd"), (300, None), (301, "abc"), (900, "😀😀😀x"), (901, "😀😀x"), (902, "ab")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.similarity for r in S.similarity_to_previous(texts, "doc_id", "text", block).collect()}
    assert got == {2: 1.0, 5: 0.5, 300: None, 900: 0.0, 901: 0.5, 902: 0.0}


def test_few_wants_of_groups_move_no_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    kinds = "document_id bigint, parent_id string, child_id string, split_group_id string, embedding array<float>"
    rows = [(i, "p0", f"c{i}", ("a", "b", None)[i % 3], [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(200)]
    chunks = spark.createDataFrame(rows, kinds)
    wants = [(q, g, [float(x) for x in rng.integers(-2, 3, 4)]) for q in range(6) for g in "ab"]
    wanted = spark.createDataFrame(wants, "query_id bigint, split_group_id string, qvec array<float>")
    hits = spark.createDataFrame([(q, d) for q in range(5) for d in range(q, 200, 7)], "query_id bigint, document_id bigint")
    keys = ["document_id", "parent_id", "child_id"]
    run = lambda: sorted(map(tuple, VS.search_groups(wanted, chunks, hits, 4, keys).select("query_id", "split_group_id", *keys, "score", "rank").collect()))
    monkeypatch.setattr(VS, "BROADCAST_ROWS", 0)
    dealt = run()
    monkeypatch.undo()
    monkeypatch.setattr(VS, "_scored_groups", None)  # not called
    assert run() == dealt and len(dealt) == 48
