"""The corpus-wide similarity join against loops."""

import random

import pytest

from askloom.operators import similar as S


def grams(t):
    t = t or ""
    return {t[i : i + 3] for i in range(len(t) - 2)}


def brute(rows, threshold):
    sets = {}
    for k, t in rows:
        if grams(t):
            sets.setdefault(frozenset(grams(t)), []).append(k)
    ids = {min(v): (g, len(v)) for g, v in sets.items()}
    out = {}
    for a, (g, n) in ids.items():
        like = [(len(g & h) / len(g | h), -b) for b, (h, _) in ids.items() if b != a and len(g & h) >= threshold * len(g | h) - 1e-9]
        best = max(like, default=(None, None))
        out[a] = (n, len(like), None if best[1] is None else -best[1], best[0])
    return out


@pytest.mark.parametrize("block, threshold", [(256, 0.95), (3, 0.95), (3, 0.6), (2, 1.0)])
def test_similar_texts(spark, monkeypatch, block, threshold):
    """A small block splits every bucket of a few rows: no pair is lost and none comes twice."""
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(1, None), (2, ""), (3, "ab"), (4, "abc"), (5, "abc"), (6, "aaaaaaa"), (7, "aaaa")]
    for g in range(8):
        base = [word() for _ in range(rng.randint(3, 60))]
        for c in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 * (g + 1) + c, "zzz common start " + " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.copies, r.links, r.nearest, r.similarity) for r in S.similar_texts(df, "doc_id", "text", threshold).collect()}
    want = brute(rows, threshold)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(v[3] is None or abs(v[3] - got[k][3]) < 1e-12 for k, v in want.items())
    assert threshold == 1.0 or sum(v[1] for v in want.values()) >= (8 if threshold > 0.9 else 40)


def test_similar_texts_of_nothing(spark):
    assert S.similar_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_a_bucket_of_many_rows_is_dealt_in_blocks(spark, monkeypatch):
    """All sets share their prefix: the rows of one key are never together in one group beyond two blocks."""
    monkeypatch.setattr(S, "BLOCK", 10)
    sets = spark.createDataFrame([(i, 1, [7, 1000 + i]) for i in range(95)], "id long, copies long, s array<long>").selectExpr("id", "copies", "size(s) AS n", "s")
    got = S.candidates(sets, 0.3)
    assert got.count() == 95 * 94 // 2
    seen = {(r.a, r.b) for r in got.collect()}
    assert len(seen) == 95 * 94 // 2 and all(a < b for a, b in seen)


def test_few_trigrams_are_ordered_without_a_shuffle(spark, monkeypatch):
    """Rarest first, ties by hash, as by the join that serves corpora of very many trigrams."""
    rows = [(i, " ".join(f"word{(i * j) % 17}" for j in range(i % 9))) for i in range(200)] + [(900, "abc"), (901, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = S.ranked_sets(df, "doc_id", "text")
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(S, "GRAMS_BROADCAST", 0)
    joined = S.ranked_sets(df, "doc_id", "text")
    assert "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sets.collect())) == sorted(map(tuple, joined.collect())) and sets.count() > 50


def test_sets_of_trigrams_are_not_stored(spark, monkeypatch, tmp_path):
    """What is settled on the way to the answer is smaller than the texts, and the answer is that of a loop."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(600))) for i in range(60)]
    for i in range(60, 90):
        copy = rows[i % 20][1].split(" ")
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    kept, settle = [], S.settle
    monkeypatch.setattr(S, "settle", lambda df: kept.append(done := settle(df)) or done)
    got = {r.doc_id: (r.copies, r.links, r.nearest) for r in S.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {k: v[:3] for k, v in brute(rows, 0.95).items()} and sum(v[1] for v in got.values()) > 20
    wide = lambda v: len(v) if isinstance(v, (bytes, bytearray, str)) else sum(map(wide, v)) if isinstance(v, (list, tuple)) else 8
    assert sum(wide(tuple(r)) for df in kept for r in df.collect()) < sum(len(t) for _, t in rows)


def test_every_pair_at_the_threshold_shares_a_part():
    """Sets of many sizes that just reach the threshold, with all their differences on one side or on both."""
    import numpy as np

    rng = np.random.default_rng(11)
    met = 0
    for threshold in (0.6, 0.8, 0.95):
        for n in [*range(1, 60), 100, 333, 1000, 4097]:
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            for lost in range(int(n * (1 - threshold)) + 2):
                for added in {0, lost, int(n / threshold) - n}:
                    b = np.concatenate([a[lost:], rng.integers(0, 2**63, added).astype(np.uint64)])
                    if len(b) and lost + added and n - lost >= threshold * (n + added) - 1e-9:
                        met += 1
                        assert len(np.intersect1d(S._parts(a, threshold), S._parts(b, threshold)))
    assert met > 500


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_links_are_gathered_to_components(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LINKS_LOCAL", limit)
    links = [(i, i - 1) for i in range(1, 200) if i % 40] + [(500 + i, 500) for i in range(1, 30)] + [(900, 199)]
    got = S._components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    want = {i: i // 40 * 40 for i in range(200)} | {500 + i: 500 for i in range(30)} | {900: 160}
    assert len(got) == len(want) and {r.id: r.root for r in got} == want


def test_large_parts_and_components_are_compared_in_blocks(spark, monkeypatch):
    """No group of texts holds more than about two blocks, and other alphabets and wide characters count as they are."""
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(9)
    base = ["".join(rng.choice("的一是了我abc😀é") for _ in range(5)) for _ in range(80)]
    rows = []
    for i in range(70):
        copy = list(base)
        copy[rng.randrange(80)] = f"{i:05d}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.copies, r.links, r.nearest) for r in S.similar_texts(df, "doc_id", "text").collect()}
    want = brute(rows, 0.95)
    assert got == {k: v[:3] for k, v in want.items()} and max(v[1] for v in want.values()) > 30
