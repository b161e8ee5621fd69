import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askloom.operators import caches as CA
from askloom.operators import history as H
from askloom.operators import maintenance as M
from askloom.operators import usage as U
from askloom.session import scratch_path
from askloom.streaming import jobs as J
from askloom.streaming import stateful as SF


def test_history_budget_keeps_suffix(spark):
    rows = [(1, 0, "user", "A" * 2000), (1, 1, "assistant", "B" * 2000), (1, 2, "user", "C" * 500)]
    df = spark.createDataFrame(rows, "session_id int, turn int, role string, content string")
    assert sorted(r["turn"] for r in H.newest_that_fit(df, 2000).collect()) == [1, 2]
    assert sorted(r["turn"] for r in H.newest_that_fit(df, 100).collect()) == []


def test_semantic_newest_cap(spark):
    rows = [("a", 1, 1), ("b", 2, 2), ("a", 9, 3), ("c", 4, 4), ("d", 5, 5)]
    df = spark.createDataFrame(rows, "content_key string, stored_at int, entry_id int")
    assert [r["content_key"] for r in CA.newest_entries(df, 3).collect()] == ["d", "c", "b"]


def test_exact_reuse_ttl_edges(spark):
    ts = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    asked = spark.createDataFrame([(1, "q", ts(10)), (2, "q", ts(20)), (3, "q", ts(21)), (4, "x", ts(20))], "ask_id int, question string, asked_at timestamp_ntz")
    stored = spark.createDataFrame([(7, "q", ts(10)), (8, "q", ts(11))], "entry_id int, question string, stored_at timestamp_ntz")
    got = {r["ask_id"]: r["entry_id"] for r in CA.reuse_exact(asked, stored, 10).collect()}
    assert got == {1: 7, 2: 8, 3: None, 4: None}


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("50%",), ("500",), ("a_b",), ("axb",)], "t string")
    assert [r[0] for r in U.search(df, "0%", ["t"]).collect()] == ["50%"]
    assert [r[0] for r in U.search(df, "A_B", ["t"]).collect()] == ["a_b"]


def test_two_documents_with_parent_p0(spark):
    p = spark.createDataFrame([(1, "p0"), (2, "p0")], "document_id int, parent_id string")
    v = spark.createDataFrame([(1, "p0"), (3, "p0")], "document_id int, parent_id string")
    got = {(r[0], r[2]) for r in M.parent_integrity(p, v).collect()}
    assert got == {(2, "no vectors"), (3, "no parent row")}


def write_batches(spark, frame, folder, parts):
    size = -(-len(frame) // parts)
    for i in range(parts):
        part = frame.iloc[i * size:(i + 1) * size]
        if len(part):
            spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("parts", [1, 4])
def test_rate_limit_any_batching(spark, parts):
    base = pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({"client": "c", "request_id": range(1, 8), "ts": [base + pd.Timedelta(seconds=s) for s in (0, 10, 20, 30, 59, 60, 75)]})
    folder = scratch_path(spark, "rate-in")
    write_batches(spark, frame, folder, parts)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.run_to_table(SF.rate_limit(stream, 3, 60), "rate-out")
    got = {r["request_id"]: (r["accepted"], r["retry_after"]) for r in out.collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (True, None), 4: (False, 30), 5: (False, 1), 6: (True, None), 7: (True, None)}


@pytest.mark.parametrize("parts", [1, 3])
def test_semantic_cache_cap_and_ttl(spark, parts):
    base = pd.Timestamp("2024-01-01")
    e = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0]}
    seq = ["a", "a", "b", "c", "a", "c"]
    frame = pd.DataFrame({"tenant": "t", "question_id": range(1, 7), "ts": [base + pd.Timedelta(minutes=i) for i in range(6)], "embedding": [e[s] for s in seq]})
    folder = scratch_path(spark, "cache-in")
    write_batches(spark, frame, folder, parts)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.run_to_table(SF.semantic_cache(stream, 0.9, cap=2), "cache-out")
    # a stored, hit, b stored, c evicts a, a evicts b, c is still there
    assert {r["question_id"]: r["hit_id"] for r in out.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 4}


def test_question_counts_replay_is_idempotent(spark):
    folder, src, ckpt = (scratch_path(spark, n) for n in ("counts", "counts-in", "counts-ckpt"))
    base = pd.Timestamp("2024-01-01")
    write_batches(spark, pd.DataFrame({"content": ["q ", "q", "r", " q"], "asked_at": [base] * 4}), src, 2)
    stream = lambda: spark.readStream.schema("content string, asked_at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        J.maintain_question_counts(stream(), folder, ckpt).awaitTermination()
    assert {r["content"]: r["count"] for r in J.latest_version(spark, folder).collect()} == {"q": 3, "r": 1}


def test_ingestion_skips_done_and_fails_late(spark):
    folder = scratch_path(spark, "ingest")
    docs = spark.createDataFrame([(1, "正文内容。", "approved", "g"), (2, " ", "approved", None), (3, "x", "pending", None)], "document_id bigint, text string, review_status string, split_group_id string")
    for batch in range(4):
        J.ingest_batch(docs, batch, folder)
    J.ingest_batch(docs, 3, folder)  # a replay changes nothing
    got = {r["document_id"]: (r["status"], r["attempts"]) for r in J.document_status(spark, folder).collect()}
    assert got == {1: ("completed", 1), 2: ("failed", 3)}


def test_rebuild_switches_only_when_complete(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "document_id bigint, text string")
    vec = F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))
    whole = lambda x: x
    ok = M.rebuild(docs, whole, vec, 2, scratch_path(spark, "rb"), "v2").first()
    bad = M.rebuild(docs, lambda x: x.where("document_id = 1"), vec, 2, scratch_path(spark, "rb"), "v3").first()
    assert ok["active_version"] == "v2" and bad["active_version"] is None and bad["failed"] == 1


def test_ingestion_tries_again(spark, tmp_path):
    """A document that fails twice and then works ends completed with three attempts; one that never works fails."""
    from pyspark.sql import functions as F

    from askloom.streaming import jobs as J

    docs = spark.createDataFrame([(1, "a text of some length. " * 9, "approved", ""), (2, " ", "approved", "")], "document_id long, text string, review_status string, split_group_id string")
    good = lambda c: F.array_repeat(F.lit(1.0), 64)
    bad = lambda c: F.array_repeat(F.lit(1.0), 3)
    empty = docs.limit(0)
    for number, (batch, embed) in enumerate([(docs, bad), (empty, bad), (empty, good), (empty, good)]):
        J.ingest_batch(batch, number, str(tmp_path), embed=embed)
        J.ingest_batch(batch, number, str(tmp_path), embed=embed)  # a replay changes nothing
    got = {r.document_id: (r.status, r.attempts) for r in J.document_status(spark, str(tmp_path)).collect()}
    assert got == {1: ("completed", 3), 2: ("failed", 3)}
    assert spark.read.parquet(f"{tmp_path}/parents").count() >= 1
    assert "parent_content" not in spark.read.parquet(f"{tmp_path}/chunks").columns
    with pytest.raises(Exception, match="queue"):
        J.ingest_batch(docs, 9, str(tmp_path), embed=good)
