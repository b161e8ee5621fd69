"""The stored index and its search against loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.operators import lexical as L
from askloom.operators import postings as P

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, n):
    out = []
    for i in range(n):
        size = 400 if i % 50 == 7 else rng.randint(0, 12)
        out.append((i, " ".join(["common"] * (rng.random() < 0.6) + [rng.choice(WORDS[: rng.choice([5, 60])]) for _ in range(size)]) or None))
    return out


def brute(docs, questions, k):
    toks = {i: re.findall(r"\w{2,}", (t or "").lower()) for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / max(len(toks), 1)
    df = Counter(t for ts in toks.values() for t in set(ts))
    out = []
    for q, text in questions:
        found = []
        for i, ts in toks.items():
            tf, s = Counter(ts), 0.0
            for t in re.findall(r"\w{2,}", (text or "").lower()):
                if tf[t]:
                    s += math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            if round(s, 4) > 0:
                found.append((-round(s, 4), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def asked(spark, questions):
    return spark.createDataFrame(questions, "query_id long, question string")


def found(rows):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in rows.collect())


@pytest.mark.parametrize("tile, terms, passes", [(1024, 2048, 10**6), (7, 3, 40)])
def test_search_against_loops(spark, monkeypatch, tile, terms, passes):
    """With small limits there are many tiles, blocks of terms and passes over the questions."""
    monkeypatch.setattr(P, "TILE_ROWS", tile)
    monkeypatch.setattr(P, "TERM_BLOCK", terms)
    monkeypatch.setattr(L, "BROADCAST_TERMS", passes)
    rng = random.Random(1)
    docs = texts(rng, 400)
    questions = [(q, " ".join(rng.choice([*WORDS, "common", "unseen"]) for _ in range(rng.randint(1, 8)))) for q in range(25)]
    questions += [(90, None), (91, ""), (92, "unseen"), (93, "common common common")]
    index = P.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ["doc_id"])
    assert (index.n_docs, round(index.avg_dl, 9)) == (400, round(sum(len(re.findall(r"\w{2,}", t or "")) for _, t in docs) / 400, 9))
    for k in (1, 5, 1000):
        assert found(P.search(index, asked(spark, questions), k)) == brute(docs, questions, k)
    assert found(P.search(index, asked(spark, []), 3)) == []


def test_index_of_nothing_and_of_blank_texts(spark):
    empty = P.build_index(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"])
    blank = P.build_index(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), ["doc_id"])
    assert (empty.n_docs, empty.avg_dl, blank.n_docs, blank.avg_dl) == (0, 0, 2, 0)
    for index in (empty, blank):
        assert found(P.search(index, asked(spark, [(1, "common")]), 3)) == []


def test_postings_lie_in_ranges_of_their_term(spark):
    docs = spark.range(20_000).select("id", F.concat(F.lit("common w"), (F.col("id") % 500).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = P.build_index(docs.repartition(4), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = index.table("postings").groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("a"), F.max("term").alias("b")).collect()
    spans = sorted((r.a, r.b) for r in files)
    assert len(spans) > 2 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    plan = P.search(index, asked(spark, [(1, "w77")]), 3)._jdf.queryExecution().toString()
    assert plan.count("regexp_extract_all") == 0 and index.table("terms").where("term = 'common'").first()["df"] == 20_000


def test_tiles_below_the_bound_are_passed_by():
    """One question, a first tile with many good rows, later tiles whose term weighs too little to matter."""
    weights = P.Weights.of(pa.table({"query_id": [1, 1], "term": ["good", "dull"], "w": [5.0, 0.1]}))
    scorer = P.Scorer(weights, 2, 10.0)
    at, ones = np.arange(4), np.ones(4)
    row = lambda n: [(n + i,) for i in range(4)]
    scorer.add(row(0), np.full(4, 10.0), ["good"], [at], [ones], np.array([1.0]), np.array([10.0]))
    for n in range(4, 40, 4):
        scorer.add(row(n), np.full(4, 10.0), ["dull"], [at], [ones], np.array([1.0]), np.array([10.0]))
    scorer.add(row(40), np.full(4, 10.0), ["good", "dull"], [at[:1], at], [ones[:1], ones], np.ones(2), np.full(2, 10.0))
    assert (scorer.met, scorer.scored) == (11, 2)
    assert scorer.rows() == [(1, (40,), 5.1), (1, (0,), 5.0)]


def test_token_counts_stay_in_their_row(spark):
    rows = [(1, "ab ab cd"), (1, "ab"), (2, None), (3, " "), (None, "ab")]
    df = L.postings(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert sorted(((r.doc_id, r.dl, r.term, r.tf) for r in df.collect()), key=str) == sorted([(1, 3, "ab", 2), (1, 3, "cd", 1), (1, 1, "ab", 1), (None, 1, "ab", 1)], key=str)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
