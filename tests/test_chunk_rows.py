"""Documents are cut, cleaned and freed of near-copies in their own row, once."""

import random

import pytest
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.operators import chunking as C


def test_a_document_is_cleaned_and_cut_once_and_not_moved(spark):
    docs = spark.createDataFrame([(1, "## One\n" + "alpha beta " * 30 + "\n## Two\nmore")], "document_id long, text string").withColumn("text", X.coarse_clean(F.col("text")))
    chunks = C.chunk_documents(docs)
    assert chunks.count()
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("最终解释权归") == 1 and "Exchange" not in plan and "Window" not in plan


def grams(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


@pytest.mark.parametrize("few", [24, 0])
def test_near_copies_of_parents_go_as_in_a_loop(spark, monkeypatch, few):
    """Chains of near-copies, equal ones and short ones; by direct comparison and by shared parts."""
    monkeypatch.setattr(C, "FEW_PARENTS", few)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh é文") for _ in range(7)).strip() or "x"
    rows, dropped = [], 0
    for d in range(25):
        base, cut = [word() for _ in range(120)], []
        for _ in range(rng.randint(1, 30)):
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(120)] = word()
            cut.append(rng.choice([" ".join(base), " ".join(base), "ab", "abc", " ".join(word() for _ in range(90))]))
        rows.append((d, cut))
    monkeypatch.setattr(C, "split_parents", lambda text: F.col("cut"))
    df = spark.createDataFrame(rows, "document_id long, cut array<string>")
    got = {}
    for r in C.parent_table(df, "cut").orderBy("document_id", "parent_no").collect():
        assert r.parent_no == len(got.setdefault(r.document_id, []))
        got[r.document_id].append(r.parent_content)
    clean = df.select("document_id", F.transform("cut", lambda t: F.coalesce(X.fine_clean(t), t)).alias("c")).collect()
    for d, cut in clean:
        kept = []
        for t in cut:
            g = grams(t)
            if not g or not any(grams(o) and len(g & grams(o)) / len(g | grams(o)) >= 0.95 for o in kept):
                kept.append(t)
        assert got[d] == kept
        dropped += len(cut) - len(kept)
    assert dropped > 40


def test_very_many_parents_are_not_compared_all_with_all():
    """5 000 different parents of one document: in seconds, where all pairs would take minutes."""
    import time

    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**60, 300)) for _ in range(5000)]
    sets += sets[:100]
    began = time.process_time()
    stay = C._first_ones(sets, 0.95)
    assert stay == [True] * 5000 + [False] * 100 and time.process_time() - began < 30


def test_special_white_space_of_latin_and_other_texts(one):
    for given, want in {"a b": "a b", "a­b": "a b", "é x": "é x", "中　x": "中 x", "plain": "plain", "a​b c": "a b c", " ": ""}.items():
        assert one(given, X.coarse_clean) == want


def test_an_alternation_of_beginnings_matches_as_its_branches(spark):
    from askloom import constants as K

    texts = ["第3页", "第 三 页 / 共 9 页", "page 3 of 9", "x Page 3 of 9", "- 4 -", "12 / 40", "1234", "12345", "(7)", "第一章 总则", "a 第一章", "二、要点", "3. Point", "\n3. Point", "## T", "(2) x", "b、y", "* z", "", "1.2 Title"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in (K.PAGE_NUMBER_PATTERNS, K.HEADING_PATTERNS, K.CLAUSE_PATTERNS, K.LIST_PATTERNS):
        plain = "|".join(f"(?:{p})" for p in patterns)
        rows = df.select("t", F.col("t").rlike(X.any_of(patterns)).alias("a"), F.col("t").rlike(plain).alias("b")).collect()
        assert X.any_of(patterns).startswith("^(?:") and all(r.a == r.b for r in rows) and any(r.b for r in rows)
