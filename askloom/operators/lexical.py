"""BM25 over tables: postings, statistics and top-k search for a whole table of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.functions import words as W
from askloom.operators.sizes import broadcast_if

BROADCAST_TERMS = 1_000_000
QUESTION_BLOCK = 512
TILE_ROWS = 4096
TILE_TOKENS = 1_000_000


def tokenized(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, toks, dl) with one row per text."""
    return docs.select(*keys, X.tokens(F.col(text)).alias("toks")).withColumn(
        "dl", F.size("toks").cast("bigint")
    )


def postings(docs: DataFrame, keys: list[str], text: str = "text", vocabulary: DataFrame | None = None):
    """(keys, dl, term, tf), counted inside each row's own tokens: nothing is shuffled."""
    rows = tokenized(docs, keys, text).where(F.col("dl") > 0)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = b.column("toks")
            coded = toks.flatten().dictionary_encode()
            words = max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(b.num_rows), toks.value_lengths().to_numpy(zero_copy_only=False))
            pair, tf = np.unique(row * words + np.asarray(coded.indices), return_counts=True)
            at = pa.array(pair // words)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(at) for c in (*keys, "dl")], coded.dictionary.take(pa.array(pair % words)), pa.array(tf, pa.int64())],
                names=[*keys, "dl", "term", "tf"],
            )

    out = rows.mapInArrow(count, f"{fields}, dl bigint, term string, tf bigint")
    return out if vocabulary is None else out.join(vocabulary, "term", "left_semi")


def document_frequency(docs: DataFrame, keys: list[str], text: str = "text", vocabulary=None):
    rows = tokenized(docs, keys, text).select(F.explode(F.array_distinct("toks")).alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row (n_docs, avg_dl)."""
    return tokenized(docs, keys, text).agg(
        F.count("*").alias("n_docs"),
        (F.sum("dl") / F.greatest(F.count("*"), F.lit(1))).alias("avg_dl"),
    )


def question_terms(questions: DataFrame, text: str = "question") -> DataFrame:
    """(query_id, term, qtf); repeated terms count as often as they occur."""
    return (
        questions.select("query_id", F.explode(X.tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def idf(n_docs, df):
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_weight(tf, dl, avg_dl, k1: float = K.BM25_K1, b: float = K.BM25_B):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def top_k(scored: DataFrame, k, by: list, group: str = "query_id") -> DataFrame:
    """Adds ``rank`` and keeps the first k rows of each group (k is a number or a column)."""
    w = Window.partitionBy(group).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _pack_tokens(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Tiles of rows with their tokens end to end; at most TILE_ROWS rows and about TILE_TOKENS tokens."""
    rows = docs.select(*keys, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    fields = ",".join(f"{k}:{docs.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("toks")
            sizes = np.diff(col.offsets.to_numpy())
            ends = np.cumsum(sizes)
            start = 0
            while start < b.num_rows:
                base = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, base + TILE_TOKENS, side="right"))
                stop = min(max(stop, start + 1), start + TILE_ROWS, b.num_rows)
                part = b.slice(start, stop - start)
                toks = part.column("toks").flatten()
                ids = pa.StructArray.from_arrays([part.column(k) for k in keys], names=keys)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [one(ids), one(pa.array(sizes[start:stop], pa.int32())), one(toks)], names=["ids", "dl", "toks"]
                )
                start = stop

    return rows.mapInArrow(pack, f"ids array<struct<{fields}>>, dl array<int>, toks array<string>")


def bm25_search(
    questions: DataFrame, docs: DataFrame, k: int, keys: list[str],
    text: str = "text", question: str = "question",
) -> DataFrame:
    """(query_id, keys, score, rank): BM25 top-k per question, scores to 4 decimals, ties by key.

    Document frequencies of question terms are combined map-side. Then each tile of texts meets each
    block of questions once and leaves at most k rows per question behind: a table of scored
    (question, text) pairs is never shuffled. Question blocks are broadcast when the counted
    terms are few; beyond that the join shuffles by block.
    """
    terms = question_terms(questions, question)
    counted = questions.agg(
        F.count("*"), F.coalesce(F.sum(F.size(X.tokens(F.col(question)))), F.lit(0))
    ).first()
    n_questions, n_terms = counted
    blocks = max(1, -(-n_questions // QUESTION_BLOCK))
    vocabulary = broadcast_if(terms.select("term").distinct(), n_terms, BROADCAST_TERMS)
    stats = corpus_stats(docs, keys, text)
    n_docs, avg_dl = stats.select("n_docs").scalar(), stats.select("avg_dl").scalar()
    packed = (
        terms.join(document_frequency(docs, keys, text, vocabulary), "term")
        .select(
            F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("bigint")).alias("block"), "term",
            F.struct("query_id", (F.col("qtf") * idf(n_docs, F.col("df"))).alias("w")).alias("q"),
        )
        .groupBy("block", "term").agg(F.collect_list("q").alias("q"))
        .groupBy("block").agg(F.collect_list(F.struct("term", "q")).alias("terms"))
        .withColumn("avg_dl", avg_dl)
    )
    tiles = _pack_tokens(docs, keys, text).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )
    joined = tiles.join(broadcast_if(packed, n_terms, BROADCAST_TERMS), "block").select(
        "terms", "avg_dl", "ids", "dl", "toks"
    )
    qtype = questions.schema["query_id"].dataType.simpleString()
    fields = ",".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                term, lists = b.column("terms")[r].values.flatten()  # flatten respects slices
                ids = b.column("ids")[r].values
                dl = b.column("dl")[r].values.to_numpy().astype(np.float64)
                tid = pc.index_in(b.column("toks")[r].values, value_set=term)
                tid = pc.fill_null(tid, -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(dl)), dl.astype(np.int64))
                seen = tid >= 0
                pair, tf = np.unique(tid[seen].astype(np.int64) * len(dl) + row[seen], return_counts=True)
                which, at = pair // len(dl), pair % len(dl)
                part = term_weight(tf, dl[at], b.column("avg_dl")[r].as_py())
                off = lists.offsets.to_numpy()
                asked, w = lists.flatten().flatten()
                qids, qix = np.unique(asked.to_numpy(zero_copy_only=False), return_inverse=True)
                w = w.to_numpy()
                sums = np.zeros((len(qids), len(dl)))
                cuts = np.flatnonzero(np.diff(which, prepend=-1))
                for lo, hi in zip(cuts, np.append(cuts[1:], len(which))):
                    t = which[lo]
                    mine = slice(off[t] - off[0], off[t + 1] - off[0])
                    sums[np.ix_(qix[mine], at[lo:hi])] += np.outer(w[mine], part[lo:hi])
                sums = np.round(sums, 4)
                yield from best_rows(qids, sums, sums > 0, ids, keys, k, asked.type)

    scored = joined.mapInArrow(score, f"query_id {qtype}, {fields}, score double")
    return top_k(scored, k, [F.desc("score"), *keys])


def _counted(docs: DataFrame, text: str, asked: list[str]) -> tuple[int, float, dict[str, int]]:
    """(number of texts, mean length, texts that hold each of the asked terms), by one scan."""
    told = docs.sparkSession.sparkContext.broadcast(pa.array(asked, pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(asked), np.int64), 0, 0
        for b in batches:
            n += b.num_rows
            for rows, row, code, words in W.coded(b.column("text"), b.column("spared")):
                total += len(code)
                place = pc.fill_null(pc.index_in(words, value_set=told.value), -1).to_numpy(zero_copy_only=False)[code]
                df += np.bincount(np.unique(row[place >= 0] * len(asked) + place[place >= 0]) % max(len(asked), 1), minlength=len(asked))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held], pa.int64()), pa.array([n, total, *df[held]], pa.int64())], names=["at", "n"])

    rows = docs.select(F.col(text).alias("text"), W.spare(F.col(text)).alias("spared")).mapInArrow(count, "at bigint, n bigint")
    sums = {r["at"]: r["n"] for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(-2, 0)
    return n, sums.get(-1, 0) / max(n, 1), {t: sums[i] for i, t in enumerate(asked) if i in sums}


def bm25_scan(questions: DataFrame, docs: DataFrame, k: int, keys: list[str], text: str = "text", question: str = "question") -> DataFrame:
    """(query_id, keys, score, rank) as ``bm25_search``, for at most ``BROADCAST_TERMS`` terms of questions and without an index.

    One scan counts the texts that hold the questions' terms, a second one scores. Terms and weights are
    broadcast; of a slice of texts only the postings of asked terms are added up, and each task keeps but each
    question's k best scores so far: a row below the k-th of them is not given on.
    """
    qtype = questions.schema["query_id"].dataType.simpleString()
    fields = ",".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"query_id {qtype}, {fields}, score double"
    terms = question_terms(questions, question).toArrow()
    coded = terms.column("term").combine_chunks().dictionary_encode()
    if not len(terms):
        return questions.sparkSession.createDataFrame([], f"{schema}, rank bigint")
    asked = coded.dictionary
    n_docs, avg_dl, df = _counted(docs, text, asked.to_pylist())
    held = np.array([df.get(t, 0) for t in asked.to_pylist()], np.float64)
    who = terms.column("query_id").combine_chunks().dictionary_encode()
    term, number = np.asarray(coded.indices), np.asarray(who.indices)
    weight = terms.column("qtf").to_numpy() * np.log((n_docs - held + 0.5) / (held + 0.5) + 1)[term]
    names, kind = who.dictionary.to_numpy(zero_copy_only=False), who.dictionary.type
    blocks = []
    for lo in range(0, len(names), QUESTION_BLOCK):
        mine = np.flatnonzero((number >= lo) & (number < lo + QUESTION_BLOCK))
        mine = mine[np.argsort(term[mine], kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(term[mine], minlength=len(asked)))))
        blocks.append((names[lo : lo + QUESTION_BLOCK], ends, number[mine] - lo, weight[mine]))
    told = docs.sparkSession.sparkContext.broadcast((asked, blocks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, blocks = told.value
        best = [np.full((len(b[0]), k), 0.0) for b in blocks]
        for whole in batches:
            for start in range(0, whole.num_rows, TILE_ROWS):
                b = whole.slice(start, TILE_ROWS)
                for rows, row, code, words in W.coded(b.column("text"), b.column("spared")):
                    size = rows.stop - rows.start
                    dl = np.bincount(row, minlength=size).astype(np.float64)
                    place = pc.fill_null(pc.index_in(words, value_set=asked), -1).to_numpy(zero_copy_only=False)[code]
                    pair, tf = np.unique(place[place >= 0].astype(np.int64) * size + row[place >= 0], return_counts=True)
                    t, at = pair // size, pair % size
                    part = term_weight(tf, dl[at], avg_dl)
                    for i, (qids, ends, to, w) in enumerate(blocks):
                        times = ends[t + 1] - ends[t]
                        mine = np.repeat(ends[t] - np.cumsum(times) + times, times) + np.arange(times.sum())
                        sums = np.bincount(to[mine] * size + np.repeat(at, times), weights=w[mine] * np.repeat(part, times), minlength=len(qids) * size)
                        sums = np.round(sums, 4).reshape(len(qids), size)
                        ok = (sums > 0) & (sums >= best[i].min(axis=1, keepdims=True))
                        live = np.flatnonzero(ok.any(axis=1))
                        if len(live):
                            both = np.concatenate([best[i][live], sums[live]], axis=1)
                            best[i][live] = np.partition(both, size, axis=1)[:, -k:]
                            ok = ok[live] & (sums[live] >= best[i][live].min(axis=1, keepdims=True))
                            columns = np.flatnonzero(ok.any(axis=0))
                            if len(columns):
                                found = b.slice(rows.start, size).take(pa.array(columns))
                                ids = pa.StructArray.from_arrays([found.column(c) for c in keys], names=keys)
                                yield from best_rows(qids[live], sums[np.ix_(live, columns)], ok[:, columns], ids, keys, k, kind)

    rows = docs.select(*keys, F.col(text).alias("text"), W.spare(F.col(text)).alias("spared"))
    return top_k(rows.mapInArrow(score, schema), k, [F.desc("score"), *keys])


def best_rows(qids, scores, allowed, ids, keys, k, qtype) -> Iterator[pa.RecordBatch]:
    """The k best allowed columns of each score row as (query_id, keys, score) batches, ties by key."""
    key_cols = ids.flatten()
    order = pc.sort_indices(
        pa.table(key_cols, names=keys), sort_keys=[(name, "ascending") for name in keys]
    ).to_numpy()
    tie = np.empty(len(order), dtype=np.int64)
    tie[order] = np.arange(len(order))
    who, picks = [], []
    for i in range(len(qids)):
        cand = np.flatnonzero(allowed[i])
        s = scores[i][cand]
        if len(cand) > k:
            kth = np.partition(s, len(cand) - k)[len(cand) - k]
            cand = cand[s >= kth]
        best = cand[np.lexsort((tie[cand], -scores[i][cand]))][:k]
        who.append(np.full(len(best), i))
        picks.append(best)
    who, picks = np.concatenate(who), np.concatenate(picks)
    take = pa.array(picks)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(qids)[who], qtype), *[col.take(take) for col in key_cols],
            pa.array(scores[who, picks], pa.float64()),
        ],
        names=["query_id", *keys, "score"],
    )


def bm25_within(
    questions: DataFrame, candidates: DataFrame, k, keys: list[str],
    text: str = "text", question: str = "question",
) -> DataFrame:
    """BM25 of each question over its own candidates only (statistics per question).

    ``candidates`` is (query_id, keys, text), already cut to the candidates of each question.
    """
    toks = tokenized(candidates.where(~X.is_blank(F.col(text))), ["query_id", *keys], text)
    stats = toks.groupBy("query_id").agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")
    )
    post = (
        toks.select("query_id", *keys, "dl", F.explode("toks").alias("term"))
        .join(question_terms(questions, question), ["query_id", "term"])
        .groupBy("query_id", *keys, "dl", "term", "qtf")
        .agg(F.count("*").alias("tf"))
    )
    df = post.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = (
        post.join(df, ["query_id", "term"])
        .join(stats, "query_id")
        .groupBy("query_id", *keys)
        .agg(
            F.sum(
                F.col("qtf") * idf(F.col("n_docs"), F.col("df"))
                * term_weight(F.col("tf"), F.col("dl"), F.col("avg_dl"))
            ).alias("s")
        )
        .select("query_id", *keys, F.round("s", 4).alias("score"))
        .where(F.col("score") > 0)
    )
    return top_k(scored, k, [F.desc("score"), *keys])
