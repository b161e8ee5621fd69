"""Scoring of retrieval and generation against a golden set."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.functions.folds import let
from askloom.session import settle


# ------------------------------------------------------------------------------ retrieval
def relevance(golden: DataFrame, hits: DataFrame, text: str = "text") -> DataFrame:
    """Adds the matched keywords and content fragments (case-folded substrings) to each hit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda arr: F.filter(arr, lambda k: low.contains(F.lower(k)))
    return hits.join(golden.select("query_id", "expected_keywords", "expected_content"), "query_id").withColumn(
        "matched",
        F.array_union(
            found(F.col("expected_keywords")),
            found(F.col("expected_content")),
        ),
    ).withColumn("relevant", F.size("matched") > 0)


def question_metrics(golden: DataFrame, judged: DataFrame) -> DataFrame:
    """Recall, precision, reciprocal rank, hit and pass per question; every question has a row."""
    # only matches of a question are gathered: at most its expected items per hit, top-k hits
    agg = judged.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count_if("relevant").alias("relevant_count"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"),
        F.array_distinct(F.flatten(F.collect_list("matched"))).alias("_m"),
    )
    expected = F.size("expected_keywords") + F.size("expected_content")
    m = F.coalesce("_m", F.array().cast("array<string>"))
    rel = F.coalesce("relevant_count", F.lit(0))
    needed = F.greatest(F.lit(2), F.floor(expected * 0.5))
    wanted = F.concat("expected_keywords", "expected_content")
    return golden.join(agg, "query_id", "left").select(
        "query_id", "difficulty", "category",
        F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
        rel.cast("bigint").alias("relevant_count"),
        F.when(expected > 0, F.least(F.lit(1.0), F.size(m) / expected)).otherwise(0.0).alias("recall"),
        F.when(F.col("retrieved") > 0, rel / F.col("retrieved")).otherwise(0.0).alias("precision"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        (rel > 0).alias("is_hit"),
        F.when(expected <= 2, rel > 0).otherwise(F.size(m) >= needed).alias("passed"),
        F.array_except(wanted, m).alias("missing"),
    )


def retrieval_report(metrics: DataFrame) -> DataFrame:
    """Totals and one row per difficulty (null difficulty is the total)."""
    return metrics.rollup("difficulty").agg(
        F.count("*").alias("questions"), F.count_if("passed").alias("passed"), F.count_if("is_hit").alias("hits"),
        F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"),
    )


# ------------------------------------------------------------------------------ generation
def groundedness(answer: Column, context: Column) -> Column:
    """Share of distinct answer tokens, stop words aside, that the context has."""
    a = F.array_distinct(X.tokens(answer, K.ANSWER_STOP_WORDS))
    c = X.tokens(context, K.ANSWER_STOP_WORDS)
    return let(
        a, lambda t: F.when(F.size(t) > 0, F.size(F.array_intersect(t, c)) / F.size(t)).otherwise(0.0)
    )


def _grams_in(word: Column, answer: Column, n: int, stride: int = 1, skip_filler: bool = False) -> Column:
    grams = X.ngrams(word, n)
    if stride > 1:
        grams = F.filter(grams, lambda g, i: i % stride == 0)
    if skip_filler:
        grams = F.filter(grams, lambda g: ~g.rlike(f"^[{K.FILLER_CHARS}]+$"))
    return F.exists(grams, lambda g: answer.contains(g))


def keyword_hits_trigram(keywords: Column, answer: Column) -> Column:
    """Keywords found whole, or by any trigram when they have four characters."""
    return F.size(
        F.filter(keywords, lambda k: answer.contains(k) | ((F.length(k) >= 4) & _grams_in(k, answer, 3)))
    )


def keyword_hits_tokens(keywords: Column, answer: Column) -> Column:
    """Keywords found whole, or with at least half of their tokens among the answer's."""
    return let(
        X.tokens(answer, ()),
        lambda have: F.size(
            F.filter(
                keywords,
                lambda k: answer.contains(k)
                | (
                    (F.size(X.tokens(k, ())) > 0)
                    & (
                        F.size(F.filter(X.tokens(F.lower(k), ()), lambda t: F.array_contains(have, t)))
                        >= F.greatest(F.lit(1.0), F.size(X.tokens(k, ())) * 0.5)
                    )
                ),
            )
        ),
    )


def content_hits(fragments: Column, answer: Column) -> Column:
    """Fragments with any four-gram (every second one, filler aside) in the answer."""
    n = lambda f: F.length(f)
    return F.size(
        F.filter(
            fragments,
            lambda f: F.when(n(f) >= 4, _grams_in(f, answer, 4, 2, True)).otherwise((n(f) >= 2) & answer.contains(f)),
        )
    )


def ratio(hits: Column, items: Column, digits: int = 3) -> Column:
    return F.when(F.size(items) > 0, F.round(hits / F.size(items), digits)).otherwise(0.0)


def pass_flags(scores: DataFrame) -> DataFrame:
    """Pass flags by difficulty. Needs grounded, keyword_ratio, content_ratio, n_content, latency,
    context_count, source_count, difficulty."""
    pick = lambda i, default: F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(x) for k, v in K.GENERATION_THRESHOLDS.items() for x in (k, v[i])]),
            F.col("difficulty"),
        ),
        F.lit(default),
    )
    content = (F.col("content_ratio") >= pick(1, 0.20)) | (F.col("n_content") == 0)
    excused = (F.col("difficulty") == "hard") & (F.col("grounded") >= 0.30) & (F.col("keyword_ratio") >= 0.50)
    out = scores.withColumns(
        {
            "pass_grounded": F.col("grounded") >= pick(0, 0.30),
            "pass_keyword": F.col("keyword_ratio") >= K.KEYWORD_RATIO_THRESHOLD,
            "pass_content": content | excused,
            "pass_latency": F.col("latency") <= K.LATENCY_THRESHOLD_S,
            "pass_source": (F.col("context_count") == 0) | (F.col("source_count") > 0),
        }
    )
    flags = ["pass_grounded", "pass_keyword", "pass_content", "pass_latency", "pass_source"]
    all_ok = F.lit(True)
    for f in flags:
        all_ok = all_ok & F.col(f)
    return out.withColumn("passed", all_ok)


def generation_summary(flags: DataFrame) -> DataFrame:
    """Overall row and one per difficulty."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6).alias(c + "_rate")
    return flags.rollup("difficulty").agg(
        F.count("*").alias("questions"), rate("passed"), rate("pass_grounded"), rate("pass_keyword"),
        rate("pass_content"), rate("pass_latency"), rate("pass_source"),
        F.round(F.avg("grounded"), 6).alias("grounded_avg"), F.min("grounded").alias("grounded_min"),
        F.max("grounded").alias("grounded_max"), F.round(F.avg("semantic"), 6).alias("semantic_avg"),
        F.round(F.avg("latency"), 6).alias("latency_avg"), F.max("latency").alias("latency_max"),
    )


def run_gates(scores: DataFrame) -> DataFrame:
    """Run-level gates: mean groundedness, micro keyword accuracy, mean and p99 latency.

    p99 is the value at position floor(0.99 n) of the ascending latencies. Latencies are counted by
    tenths of a second first, so one pass over those few counts finds the tenth that holds the
    position, and only its own values are ordered.
    """
    late = scores.where("latency > 0").select("latency", F.floor(F.col("latency") * 10).alias("_tenth"))
    counts = late.groupBy("_tenth").agg(F.count("*").alias("c"))
    cum = counts.withColumn("_cum", F.sum("c").over(Window.orderBy("_tenth")))
    place = F.floor(F.sum("c").over(Window.partitionBy()) * 0.99)
    held = cum.withColumn("_place", place).where(F.col("_cum") > F.col("_place")).agg(
        F.min(F.struct("_tenth", (F.col("_place") - F.col("_cum") + F.col("c")).alias("_at"))).alias("h")
    ).select("h.*")
    inside = late.join(F.broadcast(held), "_tenth").groupBy("latency", "_at").agg(F.count("*").alias("c"))  # held is one row
    upto = inside.withColumn("_cum", F.sum("c").over(Window.orderBy("latency")))
    p99 = upto.where(F.col("_cum") > F.col("_at")).agg(F.min("latency").alias("p")).select("p").scalar()
    base = scores.agg(
        F.round(F.avg("grounded"), 6).alias("avg_grounded"), F.round(F.avg("latency"), 6).alias("avg_latency"),
        F.round(F.sum("keyword_hits") / F.sum("keyword_total"), 6).alias("keyword_accuracy"),
    )
    return base.withColumn("p99_latency", F.coalesce(p99, F.lit(0.0))).withColumn(
        "passed",
        (F.col("avg_grounded") >= 0.5) & (F.col("keyword_accuracy") >= 0.3) & (F.col("avg_latency") <= 30.0) & (F.col("p99_latency") <= 45.0),
    )


def correctly_rejected(answer: Column, context_count: Column) -> Column:
    phrase = X.contains_any(F.coalesce(answer, F.lit("")), K.REJECTION_PHRASES)
    return phrase | ((context_count == 0) & (F.length(F.coalesce(answer, F.lit(""))) < 50))


def edge_input_ok(should_fail: Column, status: Column, answer: Column) -> Column:
    empty = F.coalesce(answer, F.lit("")) == ""
    return F.when(should_fail, (status == 400) | empty).otherwise(((status == 200) & ~empty) | (status == 400))


def multi_turn(turns: DataFrame) -> DataFrame:
    """Second answers against expected keywords: (session_id, expected_keywords, answer)."""
    hit = F.size(F.filter("expected_keywords", lambda k: F.col("answer").contains(k)))
    return turns.withColumn("keyword_ratio", ratio(hit, F.col("expected_keywords"), 6)).withColumn(
        "passed", (F.col("keyword_ratio") >= K.MULTI_TURN_THRESHOLD) & (F.length("answer") > 0)
    )


# ------------------------------------------------------------------------------ golden set
AUTOMATON_CHARS = 4_000_000  # characters of fragments that one automaton, some fifty bytes each, is built of
_BUILT: dict = {}


def _automaton(name: str, words: list[str]):
    """The worker's automaton for a broadcast list of fragments, built once."""
    if name not in _BUILT:
        _BUILT.clear()
        machine = ahocorasick.Automaton()
        for i, word in enumerate(words):
            machine.add_word(word, i)
        machine.make_automaton()
        _BUILT[name] = machine
    return _BUILT[name]


def fragments_in_corpus(fragments: DataFrame, docs: DataFrame, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """Adds ``found``: the fragment occurs in some document, white space aside, case-folded.

    ``fragments`` is (fragment_id, fragment). One Aho-Corasick automaton of all distinct fragments goes
    to every worker, and each document is read once through it; only fragments that were found, once
    a task, leave it. Fragments of more than ``limit`` characters in all take several automata, one pass
    of the documents each.
    """
    spark = docs.sparkSession
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    frag = fragments.select("fragment_id", squeeze(F.col("fragment")).alias("_f")).where(F.length("_f") > 0)
    words = settle(frag.select("_f").distinct())
    passes = max(1, -(-(words.agg(F.sum(F.length("_f"))).first()[0] or 0) // limit))
    text = docs.select(squeeze(F.col("text")).alias("_t")).where(F.length("_t") > 0)
    hit = None
    for p in range(passes):
        held = [r["_f"] for r in words.where(F.pmod(F.xxhash64("_f"), F.lit(passes)) == p).collect()]
        if not held:
            continue
        told = spark.sparkContext.broadcast((uuid.uuid4().hex, held))

        def find(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            name, known = told.value
            machine, seen = _automaton(name, known), set()
            for b in batches:
                for t in b.column("_t").to_pylist():
                    if len(seen) < len(known):
                        seen.update(i for _, i in machine.iter(t))
            yield pa.RecordBatch.from_arrays([pa.array([known[i] for i in sorted(seen)], pa.string())], names=["_f"])

        one = text.mapInArrow(find, "_f string")
        hit = one if hit is None else hit.unionByName(one)
    if hit is None:
        return fragments.withColumn("found", F.lit(False))
    good = frag.join(hit.distinct(), "_f").select("fragment_id").distinct()
    return fragments.join(good.withColumn("found", F.lit(True)), "fragment_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def golden_stats(golden: DataFrame) -> DataFrame:
    return golden.groupingSets([[], [F.col("difficulty")], [F.col("category")]], "difficulty", "category").agg(
        F.count("*").alias("items")
    )


# ------------------------------------------------------------------------------ layer checks
def layer_checks(
    documents: DataFrame, chunks: DataFrame, lexical: DataFrame, intents: DataFrame, expansions: DataFrame, retrieved: DataFrame,
) -> DataFrame:
    """(layer, metric, value, passed): six layers of the pipeline, each from its own table.

    ``documents`` (status), ``chunks`` (document_id, parent_id, child_content), ``lexical`` (query_id, hits) of
    every probe question, ``intents`` (intent, expected), ``expansions`` (question, expanded),
    ``retrieved`` (query_id, results) of every question. A layer without rows fails.
    """
    one = lambda df, layer, metric, value, ok: df.agg(value.cast("double").alias("value")).select(
        F.lit(layer).alias("layer"), F.lit(metric).alias("metric"), F.round("value", 6).alias("value"), F.coalesce(ok(F.col("value")), F.lit(False)).alias("passed")
    )
    share = lambda c: F.avg(c.cast("int"))
    parents = chunks.select("document_id", "parent_id").distinct()
    low, high = K.LAYER_PARENTS
    rows = [
        one(documents, "documents", "completed", F.count_if(F.col("status") == "completed"), lambda v: v > 0),
        one(parents, "chunks", "parents", F.count(F.lit(1)), lambda v: v.between(low, high)),
        one(chunks, "chunks", "mean child size", F.floor(F.avg(F.length("child_content"))), lambda v: v > 0),
        one(lexical, "lexical", "mean hits", F.avg("hits"), lambda v: v > 0),
        one(intents, "intent", "accuracy", share(F.col("intent") == F.col("expected")), lambda v: v >= 2 / 3),
        one(expansions, "expansion", "changed share", share(F.col("expanded") != F.col("question")), lambda v: v >= 0.5),
        one(retrieved, "retrieval", "answered share", share(F.col("results") > 0), lambda v: v >= 0.5),
    ]
    return reduce(DataFrame.unionByName, rows)
