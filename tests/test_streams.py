"""Streams: windows with late rows kept apart, and state that expires."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from askloom.session import scratch_path
from askloom.streaming import jobs as J
from askloom.streaming import stateful as SF
from askloom.streaming import windows as W

EVENTS = "event_id long, user_id long, ts timestamp"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def at(seconds):
    return None if seconds is None else datetime(2024, 1, 1) + timedelta(seconds=seconds)


def state_rows(spark, checkpoint, name):
    """What a state variable holds after the last batch."""
    key, store = SF.STORE
    spark.conf.set(key, store)
    try:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()
    finally:
        spark.conf.unset(key)


# ------------------------------------------------------------------------------ windows
def dealt(spark, batches, delay_s):
    feed, folder, ckpt = (scratch_path(spark, n) for n in ("feed", "dealt", "ckpt"))
    for rows in batches:
        put(spark, feed, [(i, u, at(s)) for i, u, s in rows], EVENTS)
        W.deal(spark.readStream.schema(EVENTS).parquet(feed), folder, ckpt, delay_s).awaitTermination()
    return folder, spark.read.schema(EVENTS).parquet(feed).schema


def test_kept_and_late_rows_are_the_input(spark):
    rng = random.Random(1)
    batches = [[(100 * b + i, rng.randrange(4), max(0, 1000 * b - rng.randrange(3000))) for i in range(40)] for b in range(4)]
    batches[2] += [(900, 1, None), (901, None, 2500), (902, 1, 0), (902, 1, 0)]
    folder, schema = dealt(spark, batches, 600)
    newest, late = None, []
    for b, rows in enumerate(batches):
        late += [(i, b) for i, _, s in rows if s is None or newest is not None and s < newest - 600]
        newest = max([newest or 0] + [s for _, _, s in rows if s is not None])
    got = W.late_rows(spark, folder, schema)
    assert sorted((r.event_id, r.batch) for r in got.collect()) == sorted(late) and len(late) > 20
    kept = spark.read.schema(schema).parquet(f"{folder}/rows/batch=*/late=false")
    both = sorted(r.event_id for r in kept.collect()) + sorted(r.event_id for r in got.collect())
    assert sorted(both) == sorted(i for rows in batches for i, _, _ in rows)


def test_replayed_batch_overwrites(spark):
    folder, schema = dealt(spark, [[(1, 1, 0), (2, 1, 5000)], [(3, 1, 100), (4, 1, 6000)]], 600)
    again = spark.createDataFrame([(3, 1, at(100)), (4, 1, at(6000))], schema)
    W.deal_batch(again, 1, folder, 600)
    assert [r.event_id for r in W.late_rows(spark, folder, schema).collect()] == [3]
    assert spark.read.parquet(f"{folder}/newest/batch=1").count() == 1
    with pytest.raises(Exception):
        W.deal_batch(again, 7, folder, 600)  # the batch before is missing


def brute_sessions(rows, gap):
    out, last = [], {}
    for u, s in sorted((u, s) for _, u, s in rows):
        if u in last and s - last[u][1] <= gap:
            last[u][1:] = [s, last[u][2] + 1]
        else:
            last[u] = [s, s, 1]
            out.append((u, last[u]))
    return sorted((u, a, b + gap, n) for u, (a, b, n) in out)


def test_windows_against_loops(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(40_000)) for i in range(300)]
    folder, schema = dealt(spark, [rows[:150], rows[150:]], 100_000)
    W.close(spark, folder, schema, 400_000)
    count = [F.count("*").alias("n")]
    sec = lambda c: F.unix_seconds(c) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))

    def run(make):
        t = W.windows_to_table(spark, folder, schema, 100_000, make, "windows", maxFilesPerTrigger=1)
        return sorted(tuple(r) for r in t.select("user_id", sec(F.col("window_start")), sec(F.col("window_end")), "n").collect())

    assert run(lambda s: W.sessions(s, "500 seconds", ["user_id"], count)) == brute_sessions(rows, 500)
    fixed = pd.Series([(u, s // 3600 * 3600) for _, u, s in rows]).value_counts()
    assert run(lambda s: W.tumbling(s, "1 hour", ["user_id"], count)) == sorted((u, a, a + 3600, n) for (u, a), n in fixed.items())
    over = pd.Series([(u, s // 1800 * 1800 - k) for _, u, s in rows for k in (0, 1800)]).value_counts()
    assert run(lambda s: W.sliding(s, "1 hour", "30 minutes", ["user_id"], count)) == sorted((u, a, a + 3600, n) for (u, a), n in over.items())


def test_windows_of_nothing(spark):
    folder, schema = dealt(spark, [[(1, 1, None)]], 60)
    W.close(spark, folder, schema, 1000)
    assert W.windows_to_table(spark, folder, schema, 60, lambda s: W.tumbling(s, "1 hour", ["user_id"], [F.count("*").alias("n")]), "none").count() == 0


# ------------------------------------------------------------------------------ keyed state
def brute_limit(rows, limit, window):
    times, out = {}, {}
    for s, i, c in sorted((s, i, c) for i, c, s in rows):
        t = [x for x in times.get(c, []) if s - x < window]
        if len(t) < limit:
            t.append(s)
            out[i] = (True, None)
        else:
            out[i] = (False, window - (s - t[0]))
        times[c] = t
    return out


def test_rate_limit_over_batches_and_expiry(spark):
    """In-time rows of four arrivals: same decisions as a loop, and an idle client leaves no state."""
    rng = random.Random(3)
    batches = [[(100 * b + i, rng.choice([1, 1, 1, 2, 3 + b]), 1000 * b + rng.randrange(900)) for i in range(60)] for b in range(3)] + [[(999, 50, 90_000)], [(1000, 51, 180_000)]]
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    for rows in batches:
        put(spark, feed, [(i, c, at(s)) for i, c, s in rows], "request_id long, client long, ts timestamp")
        stream = spark.readStream.schema("request_id long, client long, ts timestamp").parquet(feed)
        J.append_to(SF.rate_limit(stream, 3, 300, "2000 seconds"), out, ckpt)
    got = {r.request_id: (r.accepted, r.retry_after) for r in spark.read.parquet(out).collect()}
    assert got == brute_limit([r for b in batches for r in b], 3, 300)
    assert state_rows(spark, ckpt, "times") <= 2  # only clients 50 and 51, whose windows are not over


def test_late_requests_reach_the_side_table(spark):
    batches = [[(1, 7, 0), (2, 7, 5000)], [(3, 7, 100), (4, 7, 5100), (5, 8, 4500)]]
    feed, folder, ckpt = (scratch_path(spark, n) for n in ("feed", "dealt", "ckpt"))
    for rows in batches:
        put(spark, feed, [(i, c, at(s)) for i, c, s in rows], "request_id long, client long, ts timestamp")
        W.deal(spark.readStream.schema("request_id long, client long, ts timestamp").parquet(feed), folder, ckpt, 600).awaitTermination()
    schema = spark.read.parquet(feed).schema
    limited = J.run_to_table(SF.rate_limit(W.in_time(spark, folder, schema, maxFilesPerTrigger=1), 1, 60, "600 seconds"), "limited")
    kept, late = {r.request_id for r in limited.collect()}, {r.request_id for r in W.late_rows(spark, folder, schema).collect()}
    assert (kept, late) == ({1, 2, 4, 5}, {3})


def test_daily_quota_state_ends_with_the_day(spark):
    schema = "user_id long, request_id long, ts timestamp"
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    for rows in ([(1, i, at(1000 * i)) for i in range(5)], [(1, 9, at(9000)), (1, 10, at(90_000))], [(2, 11, at(864_000))], [(2, 12, at(950_000))]):
        put(spark, feed, rows, schema)
        J.append_to(SF.daily_quota(spark.readStream.schema(schema).parquet(feed), 4, "1 day"), out, ckpt)
    got = {r.request_id: r.accepted for r in spark.read.parquet(out).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 9: False, 10: True, 11: True, 12: True}
    assert state_rows(spark, ckpt, "used") == 1  # user 2's last day


def brute_cache(rows, threshold, cap, ttl):
    held, out = {}, {}
    for s, i, t, v in sorted((s, i, t, tuple(v)) for t, i, s, v in rows):
        entries = [e for e in held.get(t, []) if s < e[1] + ttl]
        u = np.array(v) / np.linalg.norm(v)
        best = max(((round(float(e[2] @ u), 6), -k, e[0]) for k, e in enumerate(entries)), default=None)
        if best and best[0] >= threshold:
            out[i] = best[2]
        else:
            entries = entries[1:] if len(entries) >= cap else entries
            entries.append((i, s, u))
            out[i] = None
        held[t] = entries
    return out


def test_semantic_cache_over_batches(spark):
    rng = random.Random(4)
    schema = "tenant long, question_id long, ts timestamp, embedding array<float>"
    rows = [(rng.randrange(2), i, 30 * i, [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(120)] + [(9, 500, 90_000, [1.0, 0.0, 0.0]), (9, 501, 180_000, [1.0, 0.0, 0.0])]
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    for part in (rows[:50], rows[50:90], rows[90:120], rows[120:121], rows[121:]):
        put(spark, feed, [(t, i, at(s), v) for t, i, s, v in part], schema)
        J.append_to(SF.semantic_cache(spark.readStream.schema(schema).parquet(feed), 0.9, 5, 600), out, ckpt)
    got = {r.question_id: r.hit_id for r in spark.read.parquet(out).collect()}
    want = brute_cache([(t, i, s, [np.float32(x) for x in v]) for t, i, s, v in rows], 0.9, 5, 600)
    assert got == want and sum(h is not None for h in want.values()) > 20
    assert state_rows(spark, ckpt, "entries") <= 2  # tenant 9's alone


def test_semantic_cache_without_cap_and_expiry_keeps_every_entry(spark):
    """1500 unlike questions over 25 hours a day apart from their repeats: each repeat hits the first of its kind."""
    schema = "tenant long, question_id long, ts timestamp, embedding array<float>"
    unit = lambda i: [float(np.cos(i / 300)), float(np.sin(i / 300)), 0.0]
    rows = [(1, i, at(60 * i), unit(i)) for i in range(1500)] + [(1, 5000 + i, at(60 * (20_000 + i)), unit(i)) for i in range(0, 1500, 50)]
    feed = scratch_path(spark, "feed")
    put(spark, feed, rows, schema)
    out = J.run_to_table(SF.semantic_cache(spark.readStream.schema(schema).parquet(feed), 0.999999, None, None), "kept")
    got = {r.question_id: r.hit_id for r in out.collect()}
    assert all(got[5000 + i] == i for i in range(0, 1500, 50)) and all(got[i] is None for i in range(1500))


def test_daily_quota_against_a_loop(spark):
    """Users that share a key, null users and two micro-batches: same decisions as a loop, in few keys."""
    rng = random.Random(8)
    schema = "user_id long, request_id long, ts timestamp"
    batches = [[(None if rng.random() < 0.1 else rng.randrange(300) + 2**60, 10_000 * b + i, at(40_000 * b + rng.randrange(100_000))) for i in range(2500)] for b in range(2)]
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    want, used = {}, {}
    for rows in batches:
        put(spark, feed, rows, schema)
        J.append_to(SF.daily_quota(spark.readStream.schema(schema).parquet(feed), 4, "3 days"), out, ckpt)
        for u, i, t in sorted(rows, key=lambda r: r[2:0:-1]):
            used[u, t.date()] = n = used.get((u, t.date()), 0) + 1
            want[i] = (u, n <= 4)
    got = {r.request_id: (r.user_id, r.accepted) for r in spark.read.parquet(out).collect()}
    assert got == want and 200 < sum(not ok for _, ok in want.values())
    assert state_rows(spark, ckpt, "used") == len(used)


def test_daily_quota_meets_few_keys(spark, monkeypatch):
    """Thousands of users of one day are decided key by key of at most ``QUOTA_SLOTS``."""
    keyed = []
    monkeypatch.setattr(SF, "_keyed", lambda rows, keys, *_: keyed.append(rows.select(*keys)) or rows)
    rows = spark.createDataFrame([(i, i, at(1)) for i in range(3000)], "user_id long, request_id long, ts timestamp")
    SF.daily_quota(rows, 4)
    assert keyed[0].distinct().count() <= 128


def test_expiring_cache_over_batches(spark):
    schema = "key string, command_id long, is_set boolean, value string, ts timestamp"
    batches = [
        [("a", 1, False, None, 0), ("a", 2, True, "x", 10), ("a", 3, False, None, 69), ("b", 4, True, None, 20)],
        [("a", 5, False, None, 70), ("b", 6, False, None, 30), ("a", 7, True, "y", 75), ("a", 8, True, "z", 75), ("a", 9, False, None, 75)],
        [("a", 10, False, None, 130), ("a", 11, False, None, 135), ("c", 12, True, "c", 90_000)], [("d", 13, False, None, 180_000)],
    ]
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))
    for rows in batches:
        put(spark, feed, [(*r[:4], at(r[4])) for r in rows], schema)
        J.append_to(SF.expiring_cache(spark.readStream.schema(schema).parquet(feed), 60, "100 seconds"), out, ckpt)
    got = {r.command_id: r.value for r in spark.read.parquet(out).collect()}
    assert got == {1: None, 3: "x", 5: None, 6: None, 9: "z", 10: "z", 11: None, 13: None}
    assert state_rows(spark, ckpt, "value") == 0  # the watermark has passed every end


def test_store_drops_entries_after_their_time(spark):
    schema = "key string, item string"
    feed, out, ckpt = (scratch_path(spark, n) for n in ("feed", "out", "ckpt"))

    def run(rows):
        put(spark, feed, rows, schema)
        J.append_to(SF.recently_seen(spark.readStream.schema(schema).parquet(feed), 20), out, ckpt, idle_batches=False)

    run([("k", "p"), ("k", "p"), ("k", "q")])
    run([("k", "p")])
    assert sorted((r.item, r.seen) for r in spark.read.parquet(out).collect()) == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]
    time.sleep(21)
    run([("k", "p"), ("j", "r")])
    assert sorted((r.item, r.seen) for r in spark.read.parquet(out).collect())[:2] == [("p", 1), ("p", 1)]
    assert state_rows(spark, ckpt, "seen") == 2  # q is gone without having been asked for


# ------------------------------------------------------------------------------ counters
def test_counters_rewrite_only_their_buckets(spark):
    from pathlib import Path

    schema = "content string, asked_at timestamp"
    feed, folder, ckpt = (scratch_path(spark, n) for n in ("feed", "counts", "ckpt"))
    first = [(f"question {i}", at(i)) for i in range(200)]
    batches = [first, [("question 7", at(500)), (" question 7 ", at(400))], [("question 7", at(600))], [("new", at(700)), ("question 9", at(1))]]
    for n, rows in enumerate(batches):
        put(spark, feed, rows, schema)
        J.maintain_question_counts(spark.readStream.schema(schema).parquet(feed), folder, ckpt, 16).awaitTermination()
        written = list(Path(folder, f"data/version={n}").glob("bucket=*"))
        assert len(written) == (16, 1, 1, len({p.name for p in written}))[n] and len(written) in (1, 2, 16)
    got = {r["content"]: (r["count"], r["created_at"], r["updated_at"]) for r in J.latest_version(spark, folder).collect()}
    assert len(got) == 201 and got["question 7"] == (4, at(7), at(600)) and got["new"] == (1, at(700), at(700)) and got["question 9"] == (2, at(1), at(9))
    held = {(p.parent.name, p.name) for p in Path(folder, "data").glob("version=*/bucket=*")}
    seven = next(b for v, b in held if v == "version=2")
    assert ("version=0", seven) not in held and ("version=1", seven) not in held  # no replay needs them any more
