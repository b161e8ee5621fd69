"""Tokens of Arrow batches against those of the JVM, and BM25 by scans against the index."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.functions import words as W
from askloom.operators import postings as P
from askloom.operators import retrieval as R
from askloom.operators import vectors as VS
from askloom.operators import lexical as L


def bags(spark, texts):
    """(tokens here, tokens of the JVM) of each text, sorted."""
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = df.select("t", W.spare(F.col("t")).alias("s"), F.coalesce(X.tokens(F.col("t")), F.array().cast("array<string>")).alias("j")).toArrow()
    mine = [[] for _ in texts]
    for b in rows.combine_chunks().to_batches():
        for part, row, code, words in W.coded(b.column("t"), b.column("s")):
            for r, c in zip(row, code):
                mine[part.start + r].append(words[int(c)].as_py())
    return list(zip(map(sorted, mine), map(sorted, rows.column("j").to_pylist())))


def test_every_character_is_cut_as_in_the_jvm(spark):
    points = [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600, 0x20000, 0x10400]
    texts = [f"{a}{c}B {c}{c} 1{c}" for c in map(chr, points) for a in ("x",)]
    wrong = [(hex(p), a, b) for p, (a, b) in zip(points, bags(spark, texts)) if a != b]
    assert not wrong, wrong[:5]


def test_mixed_texts_are_cut_as_in_the_jvm(spark, monkeypatch):
    rng = random.Random(4)
    parts = ["Le été", "ÉCOLE", "数据库", "没有", "如果说", "a", "x_1", "\n", " ", "“问”", "ПРИВЕТ мир", "İstanbul", "ΟΔΟΣ", "🙂ok", "ſtrange", "12", "é", "", "中", "A中B文字"]
    texts = [None, "", *["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 12))) for _ in range(400)]]
    for size in (1_000_000, 40):
        monkeypatch.setattr(W, "BYTES", size)
        got = bags(spark, texts)
        assert all(a == b for a, b in got) and sum(len(a) for a, _ in got) > 1000


def test_scans_give_what_the_index_gives(spark, monkeypatch):
    rng = random.Random(8)
    word = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    line = lambda n: " ".join(word[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    docs = spark.createDataFrame([(i, "p0", f"c{i % 3}", line(rng.randint(0, 30)) if i % 50 else "") for i in range(600)], "document_id long, parent_id string, child_id string, child_content string").repartition(4)
    asked = spark.createDataFrame([(i, line(rng.randint(0, 9))) for i in range(25)] + [(99, "nothing такое"), (100, "")], "query_id long, question string")
    monkeypatch.setattr(L, "QUESTION_BLOCK", 10)
    monkeypatch.setattr(L, "TILE_ROWS", 37)
    scanned = L.bm25_scan(asked, docs, 8, R.CHILD_KEY, "child_content")
    indexed = P.search(P.build_index(docs, R.CHILD_KEY, "child_content"), asked, 8)
    got, want = ({tuple(r[c] for c in ("query_id", *R.CHILD_KEY, "rank")): r.score for r in x.collect()} for x in (scanned, indexed))
    assert got.keys() == want.keys() and len(got) > 150 and all(abs(got[k] - want[k]) < 2e-4 for k in got)
    assert not L.bm25_scan(asked.where("query_id = 100"), docs, 8, R.CHILD_KEY, "child_content").count()
    assert not L.bm25_scan(asked, docs.limit(0), 8, R.CHILD_KEY, "child_content").count()


def test_a_computed_vector_is_made_once(spark):
    """The scan of the vectors holds one call of the embedder; empty and null vectors are no hits."""
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(30)], "document_id long, t string")
    asked = spark.createDataFrame([(1, "word3 text")], "query_id long, q string").select("query_id", V.hashed_embedding(F.col("q")).alias("qvec"))
    hits = VS.vector_scores_topk(asked, docs.withColumn("embedding", V.hashed_embedding(F.col("t"))), 3, ["document_id"])
    assert hits.first().document_id == 3
    assert hits._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [count_slots") == 1
    some = docs.withColumn("embedding", F.when(F.col("document_id") % 3 == 0, V.hashed_embedding(F.col("t"))).when(F.col("document_id") % 3 == 1, F.array().cast("array<float>")))
    assert {r.document_id % 3 for r in VS.vector_scores_topk(asked, some, 99, ["document_id"]).collect()} == {0}


def test_paths_of_a_multi_path_search_share_scans(spark, monkeypatch):
    """One vector search for questions and their expansions, no index made, and query ids of any kind."""
    chunks = spark.createDataFrame([(i, "p0", f"c{i}", f"topic{i % 9} alpha beta{i}", f"g{i % 3}") for i in range(60)], "document_id long, parent_id string, child_id string, child_content string, split_group_id string")
    chunks = chunks.withColumn("embedding", V.hashed_embedding(F.col("child_content")))
    asked = spark.createDataFrame([("1:a", "topic3 alpha"), ("b", "beta7")], "query_id string, question string")
    calls, search = [], VS.vector_scores_topk
    monkeypatch.setattr(VS, "vector_scores_topk", lambda *a, **b: calls.append(a) or search(*a, **b))
    monkeypatch.setattr(P, "build_index", None)
    found = R.multi_path(asked, chunks, 5, expand=lambda q: F.concat(q, F.lit(" topic5"))).collect()
    assert len(calls) == 1 and {r.query_id for r in found} == {"1:a", "b"} and len(found) == 10
