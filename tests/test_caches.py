"""Similar-question reuse, fragments in the corpus and versioned rebuilds against loops."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.functions import vector as V
from askloom.operators import caches as C
from askloom.operators import evaluation as E
from askloom.operators import maintenance as M
from askloom.session import scratch_path

START = datetime(2024, 1, 1)


def brute(asks, entries, threshold, ttl):
    out = {}
    for i, at, v in asks:
        best = []
        for e, stored, w in entries:
            if stored < at < stored + ttl and v and w and len(v) == len(w):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                s = round(float(np.dot(v, w) / n), 6) if n else 0.0
                if s >= threshold:
                    best.append((-s, stored, e))
        out[i] = min(best, default=(None, None, None))[2]
    return out


@pytest.mark.parametrize("rows", [4096, 3])
def test_similar_reuse(spark, monkeypatch, rows):
    """With small blocks every time bucket is split on both sides."""
    monkeypatch.setattr(C, "SIDE_ROWS", rows)
    rng = random.Random(1)
    vec = lambda: [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]
    asks = [(i, rng.randrange(5000), vec()) for i in range(60)] + [(900, 100, None), (901, 0, [1.0, 1.0, 1.0]), (902, 99_999, vec())]
    entries = [(1000 + i, rng.randrange(5000), vec()) for i in range(80)] + [(2000, 50, None), (2001, 60, [0.0, 0.0, 0.0])]
    frame = lambda rows, key, at: spark.createDataFrame([(i, START + timedelta(seconds=t), v) for i, t, v in rows], f"{key} long, {at} timestamp, embedding array<float>")
    got = C.reuse_similar(frame(asks, "ask_id", "asked_at"), frame(entries, "entry_id", "stored_at"), 0.7, 600)
    assert {r.ask_id: r.entry_id for r in got.collect()} == brute(asks, entries, 0.7, 600)
    assert len(got.collect()) == len(asks)
    none = C.reuse_similar(frame(asks, "ask_id", "asked_at"), frame([], "entry_id", "stored_at"), 0.7, 600)
    assert {r.entry_id for r in none.collect()} == {None}


def test_times_are_the_join_key(spark):
    df = spark.range(10).select("id", F.timestamp_seconds("id").alias("t"), F.array(F.lit(1.0)).alias("embedding"))
    got = C.reuse_similar(df.select(F.col("id").alias("ask_id"), F.col("t").alias("asked_at"), "embedding"), df.select(F.col("id").alias("entry_id"), F.col("t").alias("stored_at"), "embedding"), 0.5, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r.ask_id: r.entry_id for r in got.collect()} == {i: (max(i - 2, 0) if i else None) for i in range(10)}


@pytest.mark.parametrize("limit", [4_000_000, 12])
def test_fragments_in_corpus(spark, limit):
    """A small limit makes several automata; fragments inside others, repeated, blank and in other case."""
    docs = [(1, "Die alte  Stadt\nam Fluss"), (2, None), (3, ""), (4, "abcabd 中文 内容 İx"), (5, "x" * 5000 + "needle")]
    words = ["alte stadt", "STADT AM", "Fluss", "fluss am", "bcabd", "文内", "needle", "xneedle", "xx", "no", " ", "", None, "a", "q", "stadtamfluss"]
    frag = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)] + [("again", "Fluss")], "fragment_id string, fragment string")
    text = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    squeeze = lambda t: re.sub(r"\s+", "", t or "").lower()
    got = E.fragments_in_corpus(frag, text, limit)
    want = {str(i): bool(squeeze(w)) and any(squeeze(w) in squeeze(t) for _, t in docs) for i, w in enumerate(words)} | {"again": True}
    assert {r.fragment_id: r.found for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no text is cut into n-grams
    assert {r.found for r in E.fragments_in_corpus(frag, text.limit(0), limit).collect()} == {False}
    assert E.fragments_in_corpus(frag.limit(0), text, limit).count() == 0


def test_rebuilds_move_one_pointer(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e")], "document_id bigint, text string")
    path = scratch_path(spark, "rebuild")
    one = lambda x: x.select("document_id", F.lit("c0").alias("child_id"), F.col("text").alias("child_content"))
    embed = V.hashed_embedding(F.col("child_content"))
    assert M.active_version(spark, path) is None
    with pytest.raises(ValueError):
        M.active_vectors(spark, path)
    run = lambda chunk, version, dim=64: tuple(M.rebuild(docs, chunk, embed, dim, path, version).first())
    assert run(lambda x: one(x.where("document_id <> 2")), "v0") == (3, 1, None)
    assert [r.document_id for r in M.failed_documents(spark, path, "v0").collect()] == [2]
    assert run(one, "v1") == (3, 0, "v1")
    assert run(one, "v2", dim=63) == (3, 3, "v1")
    assert {r.version for r in M.active_vectors(spark, path).collect()} == {"v1"} and M.active_vectors(spark, path).count() == 3
    assert run(lambda x: one(x).unionByName(one(x).withColumn("child_id", F.lit("c1"))), "v3") == (3, 0, "v3")
    assert M.active_vectors(spark, path).count() == 6


# ------------------------------------------------------------------------------ layer checks, split files
def test_layer_checks(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = frame([("completed",), ("pending",), (None,)], "status string")
    chunks = frame([(i, "p0", "abcd" + "x" * (i % 2)) for i in range(20)], "document_id long, parent_id string, child_content string")
    hits = frame([(1, 0), (2, 3)], "query_id long, hits long")
    intents = frame([("fact", "fact"), ("fact", "fact"), ("unknown", "policy")], "intent string, expected string")
    changed = frame([("a", "a b"), ("c", "c")], "question string, expanded string")
    found = frame([(1, 0), (2, 0), (3, 4)], "query_id long, results long")
    got = {(r.layer, r.metric): (r.value, r.passed) for r in E.layer_checks(docs, chunks, hits, intents, changed, found).collect()}
    assert got == {
        ("documents", "completed"): (1.0, True), ("chunks", "parents"): (20.0, True), ("chunks", "mean child size"): (4.0, True), ("lexical", "mean hits"): (1.5, True),
        ("intent", "accuracy"): (0.666667, True), ("expansion", "changed share"): (0.5, True), ("retrieval", "answered share"): (0.333333, False),
    }
    empty = E.layer_checks(*[df.limit(0) for df in (docs, chunks, hits, intents, changed, found)]).collect()
    assert len(empty) == 7 and not any(r.passed for r in empty)


def test_split_files_are_chunked_under_their_place(spark):
    from askloom.operators import chunking as CH

    rows = [(5, "a", "第一章 总则\n正文内容一。"), (7, "a", " "), (9, "a", "正文内容二。"), (6, "b", "正文内容三。")]
    files = spark.createDataFrame(rows, "document_id long, source string, text string")
    got = CH.chunk_split_files(files, "source", "document_id").collect()
    assert {(r.source, r.document_id, r.file_index) for r in got} == {("a", 5, 0), ("a", 9, 2), ("b", 6, 0)}
    assert all(r.parent_id.startswith(f"s{r.file_index}_p") and r.child_id.startswith(r.parent_id + "_c") for r in got)
    plain = {(r.document_id, r.child_content) for r in CH.chunk_documents(files.where("document_id <> 7").select("document_id", "text")).collect()}
    assert {(r.document_id, r.child_content) for r in got} == plain
