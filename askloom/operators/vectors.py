"""Exact cosine search for a table of questions over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.operators.lexical import best_rows, top_k
from askloom.operators.sizes import BROADCAST_ROWS, broadcast_if
from askloom.session import settle

QUESTION_BLOCK = 1024
GROUP_ROWS = 8192  # vectors of a split group scored at once
SCAN_ROWS = 4096  # vectors scored at once where the questions are broadcast


def _packed_questions(questions: DataFrame, vec: str, blocks: int, at: str | None) -> DataFrame:
    """Questions spread over ``blocks`` rows of packed vectors."""
    return (
        questions.where(F.size(vec) > 0)
        .select(
            F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("bigint")).alias("block"), "query_id",
            F.col(vec).alias("v"), (F.col(at) if at else F.lit(0)).cast("bigint").alias("at"),
        )
        .groupBy("block")
        .agg(F.collect_list(F.struct("query_id", "at", "v")).alias("q"))
        .select("block", F.col("q.query_id").alias("qids"), F.col("q.at").alias("qat"), F.flatten("q.v").alias("qmat"))
    )


def _pack_chunks(chunks: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per Arrow batch: key structs and the flattened matrix (no shuffle)."""
    fields = ",".join(f"{k}:{chunks.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"ids array<struct<{fields}>>, cmat array<float>, dim int"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = pa.StructArray.from_arrays([b.column(k) for k in keys], names=keys)
            flat = b.column("v").flatten()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), ids),
                    pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                    pa.array([len(flat) // b.num_rows], pa.int32()),
                ],
                names=["ids", "cmat", "dim"],
            )

    rows = chunks.where(F.size(vec) > 0).select(*keys, F.col(vec).cast("array<float>").alias("v"))
    return rows.mapInArrow(pack, schema)


def unit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors, zero ones as they are; lists of one length."""
    lists = column.combine_chunks()
    return _unit_rows(lists.flatten().to_numpy(zero_copy_only=False), len(lists[0]) if len(lists) else 1)


def _unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, dim)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def vector_scores_topk(
    questions: DataFrame, chunks: DataFrame, k: int, keys: list[str],
    qvec: str = "qvec", vec: str = "embedding", block: int = QUESTION_BLOCK,
    window: tuple[str, str, int] | None = None, minimum: float | None = None,
) -> DataFrame:
    """(query_id, keys, score, rank): exact cosine top-k, ties by key, scores to 6 decimals.

    A block nested loop: vectors are scored by matrix products of bounded size and no pair table is ever
    built. Few questions, as counted, are broadcast to one scan of the vectors (``_scanned``). Beyond that
    each batch of vectors is shuffled to each block of questions, and leaves at most k rows per question.

    ``window`` = (question time, key time, length) keeps vectors with time < question time < time
    + length; ``minimum`` drops lower scores.
    """
    n_questions = questions.count()
    if not n_questions:  # no scan for nothing
        kinds = [f"query_id {questions.schema['query_id'].dataType.simpleString()}", *[f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys]]
        return questions.sparkSession.createDataFrame([], ", ".join([*kinds, "score double", "rank bigint"]))
    if n_questions <= BROADCAST_ROWS:
        scored = _scanned(questions, chunks, k, keys, qvec, vec, block, window, minimum)
        return top_k(scored, k, [F.desc("score"), *keys])
    blocks = max(1, -(-n_questions // block))
    packed = broadcast_if(
        _packed_questions(questions, qvec, blocks, window[0] if window else None), n_questions,
    )
    tiles = _pack_chunks(chunks, keys, vec).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    )
    joined = tiles.join(packed, "block").select("qids", "qat", "qmat", "ids", "cmat", "dim")
    qtype = questions.schema["query_id"].dataType.simpleString()
    fields = ",".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                q = _unit_rows(b.column("qmat")[r].values.to_numpy(zero_copy_only=False), dim)
                c = _unit_rows(b.column("cmat")[r].values.to_numpy(zero_copy_only=False), dim)
                qids, ids = b.column("qids")[r].values, b.column("ids")[r].values
                sims = np.round(q @ c.T, 6) + 0.0
                ok = np.ones(sims.shape, dtype=bool) if minimum is None else sims >= minimum
                if window:
                    at = ids.flatten()[keys.index(window[1])].to_numpy(zero_copy_only=False)
                    asked = b.column("qat")[r].values.to_numpy(zero_copy_only=False)[:, None]
                    ok &= (at < asked) & (asked < at + window[2])
                names = qids.to_numpy(zero_copy_only=False)
                yield from best_rows(names, sims, ok, ids, keys, k, qids.type)

    scored = joined.mapInArrow(score, f"query_id {qtype}, {fields}, score double")
    return top_k(scored, k, [F.desc("score"), *keys])


def _scanned(questions, chunks, k, keys, qvec, vec, block, window, minimum) -> DataFrame:
    """(query_id, keys, score): rows of each task that may be among a question's k best, by one scan.

    A task scores a slice of vectors with a block of questions at a time and keeps nothing but each
    question's k best scores so far; a row below the k-th of them is not given on.
    """
    at = F.col(window[0]) if window else F.lit(0)
    table = questions.where(F.size(qvec) > 0).select("query_id", F.col(qvec).alias("v"), at.cast("bigint").alias("at")).toArrow()
    qids = table.column("query_id").combine_chunks()
    told = questions.sparkSession.sparkContext.broadcast(
        (qids.to_numpy(zero_copy_only=False), unit_matrix(table.column("v")), table.column("at").to_numpy())
    )
    qtype = questions.schema["query_id"].dataType.simpleString()
    fields = ",".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys)
    kind = qids.type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, asked = told.value
        if not len(names):
            return
        best = np.full((len(names), k), -np.inf)
        for whole in batches:
            held = pc.fill_null(pc.greater(pc.list_value_length(whole.column("v")), 0), False)
            whole = whole.filter(held) if held.false_count else whole
            for start in range(0, whole.num_rows, SCAN_ROWS):
                b = whole.slice(start, SCAN_ROWS)
                c = unit_matrix(pa.chunked_array([b.column("v")]))
                since = b.column(window[1]).to_numpy(zero_copy_only=False) if window else None
                for lo in range(0, len(names), block):
                    q = slice(lo, lo + block)
                    sims = np.round(matrix[q] @ c.T, 6) + 0.0
                    ok = np.ones(sims.shape, dtype=bool) if minimum is None else sims >= minimum
                    if window:
                        ok &= (since < asked[q, None]) & (asked[q, None] < since + window[2])
                    held = np.concatenate([best[q], np.where(ok, sims, -np.inf)], axis=1)
                    best[q] = np.partition(held, held.shape[1] - k, axis=1)[:, -k:]
                    ok &= sims >= best[q].min(axis=1, keepdims=True)
                    rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                    if len(rows):
                        part = b.take(pa.array(columns))
                        ids = pa.StructArray.from_arrays([part.column(x) for x in keys], names=keys)
                        yield from best_rows(names[q][rows], sims[np.ix_(rows, columns)], ok[np.ix_(rows, columns)], ids, keys, k, kind)

    # a filter here would make a computed vector twice, so empty ones are left out in the scan
    vectors = chunks.select(*keys, F.col(vec).cast("array<float>").alias("v"))
    return vectors.mapInArrow(scan, f"query_id {qtype}, {fields}, score double")


def best_child_per_parent(hits: DataFrame) -> DataFrame:
    """After the limit: the best-ranked child of each (document, parent) stays."""
    w = Window.partitionBy("query_id", "document_id", "parent_id").orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .drop("_n")
        .withColumn("rank", F.row_number().over(again).cast("bigint"))
    )


def search_groups(
    wanted: DataFrame, chunks: DataFrame, hit_documents: DataFrame, k: int, keys: list[str],
    qvec: str = "qvec", vec: str = "embedding",
) -> DataFrame:
    """Top-k per (question, group) inside given split groups, leaving out documents already hit.

    ``wanted`` is (query_id, split_group_id, qvec); without ``qvec`` every score is 0 and the first rows
    by key are returned. Vectors meet only the questions that want their own group. Few wants, as counted, are
    broadcast to one scan of the vectors; beyond that both sides are dealt by group, large groups and
    groups wanted by very many questions in several parts.
    """
    out = hit_documents.groupBy("query_id").agg(F.collect_set("document_id").alias("_out"))
    asked = wanted.join(out, "query_id", "left").withColumn("_out", F.coalesce("_out", F.array().cast("array<bigint>")))
    if qvec not in wanted.columns:
        scored = _first_of_groups(asked, chunks, k, keys)
    else:
        asked = settle(asked)
        by = _scanned_groups if asked.count() <= BROADCAST_ROWS else _scored_groups
        scored = by(asked, chunks, k, keys, qvec, vec)
    both = F.concat_ws("\u0001", "query_id", "split_group_id")
    return top_k(scored.withColumn("_q", both), k, [F.desc("score"), *keys], "_q").drop("_q")


def _first_of_groups(asked: DataFrame, chunks: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The first rows of each wanted group in key order, without any vector arithmetic.

    A question skips at most as many documents as it has hits, so of each group only the first
    k + that many documents, and of those the first k rows, can be needed; both limits are cut before
    the shuffle.
    """
    most = asked.agg(F.max(F.size("_out")).alias("n")).first()["n"] or 0
    by_document = Window.partitionBy("split_group_id").orderBy("document_id")
    by_key = Window.partitionBy("split_group_id", "document_id").orderBy(*keys)
    rows = chunks.select("split_group_id", *keys).withColumn("_d", F.dense_rank().over(by_document)).where(F.col("_d") <= k + most)
    rows = rows.withColumn("_r", F.row_number().over(by_key)).where(F.col("_r") <= k).drop("_d", "_r")
    met = asked.select("query_id", "split_group_id", "_out").join(rows, "split_group_id")
    return met.where(~F.array_contains("_out", F.col("document_id"))).select(
        "query_id", "split_group_id", *keys, F.lit(0.0).alias("score")
    )


def _scanned_groups(asked: DataFrame, chunks: DataFrame, k: int, keys: list[str], qvec: str, vec: str) -> DataFrame:
    """Rows of each task that may be among the k best of a wanted group, by one scan that moves no vector."""
    table = asked.where(F.size(qvec) > 0).select("query_id", "split_group_id", F.col(qvec).alias("v"), "_out").toArrow()
    names, matrix = table.column("query_id").combine_chunks(), unit_matrix(table.column("v"))
    groups, left_out = {}, {}
    for i, g in enumerate(table.column("split_group_id").to_pylist()):
        groups.setdefault(g, []).append(i)
    for i, out in enumerate(table.column("_out").to_pylist()):
        for x in out:
            left_out.setdefault(x, []).append(i)
    told = asked.sparkSession.sparkContext.broadcast((names.to_numpy(zero_copy_only=False), matrix, groups, left_out))
    fields = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys)
    kind = names.type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, groups, left_out = told.value
        best = np.full((len(names), k), -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows, SCAN_ROWS):
                slice_ = whole.slice(start, SCAN_ROWS)
                coded = slice_.column("split_group_id").dictionary_encode()
                for code, group in enumerate(coded.dictionary.to_pylist()):
                    if group not in groups:
                        continue
                    b = slice_.take(pa.array(np.flatnonzero(np.asarray(coded.indices.fill_null(-1)) == code)))
                    c, documents = unit_matrix(pa.chunked_array([b.column("v")])), b.column("document_id").to_pylist()
                    for lo in range(0, len(groups[group]), QUESTION_BLOCK):
                        q = np.array(groups[group][lo : lo + QUESTION_BLOCK])
                        place = {x: i for i, x in enumerate(q.tolist())}
                        sims = np.round(matrix[q] @ c.T, 6) + 0.0
                        ok = np.ones(sims.shape, dtype=bool)
                        for column, x in enumerate(documents):
                            for i in left_out.get(x, ()):
                                if i in place:
                                    ok[place[i], column] = False
                        held = np.concatenate([best[q], np.where(ok, sims, -np.inf)], axis=1)
                        best[q] = np.partition(held, held.shape[1] - k, axis=1)[:, -k:]
                        ok &= sims >= best[q].min(axis=1, keepdims=True)
                        rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                        if len(rows):
                            part = b.take(pa.array(columns))
                            ids = pa.StructArray.from_arrays([part.column(x) for x in keys], names=keys)
                            for found in best_rows(names[q][rows], sims[np.ix_(rows, columns)], ok[np.ix_(rows, columns)], ids, keys, k, kind):
                                same = pa.array([group] * found.num_rows, pa.string())
                                yield pa.RecordBatch.from_arrays([found.column(0), same, *found.columns[1:]], names=["query_id", "split_group_id", *found.schema.names[1:]])

    qtype = asked.schema["query_id"].dataType.simpleString()
    vectors = chunks.where(F.size(vec) > 0).select("split_group_id", *keys, F.col(vec).cast("array<float>").alias("v"))
    return vectors.mapInArrow(scan, f"query_id {qtype}, split_group_id string, {fields}, score double")


def _scored_groups(asked: DataFrame, chunks: DataFrame, k: int, keys: list[str], qvec: str, vec: str) -> DataFrame:
    """The k best rows of each part of each wanted group, one matrix product per part."""
    sides = asked.groupBy("split_group_id").agg(F.ceil(F.count("*") / QUESTION_BLOCK).alias("_sides"))
    inside = chunks.where(F.size(vec) > 0).select("split_group_id", *keys, F.col(vec).cast("array<float>").alias("_v"))
    parts = inside.groupBy("split_group_id").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("_parts")).join(sides, "split_group_id")
    left = inside.join(parts, "split_group_id").select(
        "split_group_id", F.pmod(F.xxhash64(*keys), F.col("_parts")).alias("_part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_sides") - 1)).alias("_side"), *keys, "_v",
    )
    right = asked.where(F.size(qvec) > 0).join(parts, "split_group_id").select(
        "split_group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"),
        F.pmod(F.xxhash64("query_id"), F.col("_sides")).alias("_side"), "query_id", F.col(qvec).cast("array<float>").alias("_qv"), "_out",
    )
    qtype = asked.schema["query_id"].dataType.simpleString()
    fields = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keys)

    def score(rows: pa.Table, questions: pa.Table) -> pa.Table:
        rows, questions = rows.combine_chunks(), questions.combine_chunks()
        if not len(rows) or not len(questions):
            names = ["query_id", "split_group_id", *keys]
            kinds = [questions.schema.field("query_id").type, rows.schema.field("split_group_id").type, *[rows.schema.field(c).type for c in keys]]
            return pa.table([pa.array([], t) for t in [*kinds, pa.float64()]], names=[*names, "score"])
        first = rows.column("_v")[0].values
        q = _unit_rows(np.concatenate([np.asarray(x.values) for x in questions.column("_qv")]), len(first))
        c = _unit_rows(np.concatenate([np.asarray(x.values) for x in rows.column("_v")]), len(first))
        sims = np.round(q @ c.T, 6) + 0.0
        documents = np.asarray(rows.column("document_id"))
        ok = np.stack([~np.isin(documents, out) for out in questions.column("_out").to_pylist()])
        ids = pa.StructArray.from_arrays([rows.column(x).combine_chunks() for x in keys], names=keys)
        names = questions.column("query_id")
        best = pa.Table.from_batches(best_rows(names.to_numpy(), sims, ok, ids, keys, k, names.type))
        group = pa.array([rows.column("split_group_id")[0].as_py()] * len(best), rows.schema.field("split_group_id").type)
        return best.add_column(1, "split_group_id", group)

    by = ["split_group_id", "_part", "_side"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, f"query_id {qtype}, split_group_id string, {fields}, score double")
