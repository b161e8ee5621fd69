"""Stored inverted index with score bounds, and exact BM25 top-k that skips what cannot win.

The texts are tokenised once. Rows are packed into tiles; of every tile and term the index keeps one
row: which rows of the tile hold the term, how often, and the largest count and smallest length among
them, from which the largest weight of the term in that tile follows for any average length. Postings are
stored in ranges of (term, tile), so a frequent term spans several files and a search reads the files
of its own terms. A search scores tile after tile, adds up the bounds of a question's terms for each, and
passes by those whose bound does not reach the question's k-th score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from askloom.functions import text as X
from askloom.operators import lexical as L
from askloom.operators.sizes import broadcast_if
from askloom.session import scratch_path, settle

TILE_ROWS = 1024
TILE_TOKENS = 1_000_000
TERM_BLOCK = 2048  # terms of a tile that are multiplied at once
SLACK = 1e-6  # far above the error of adding up a bound, far below a score's last digit


@dataclass(frozen=True)
class Index:
    """An index in ``folder``: postings, terms (term, df), tiles (tile, ids, dl), and its two statistics."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    n_docs: int
    avg_dl: float
    raw: StructType

    def table(self, name: str) -> DataFrame:
        """"postings", "terms" or "tiles"; the tiles stay where the scan has put them."""
        if name != "tiles":
            return self.spark.read.parquet(f"{self.folder}/{name}")
        path = f"{self.folder}/raw/kind=tiles"
        rows = self.spark.read.schema(self.raw).parquet(path) if _holds(self.spark, path) else self.spark.createDataFrame([], self.raw)
        return rows.select("tile", "ids", "dl")


def build_index(docs: DataFrame, keys: list[str], text: str = "text", folder: str | None = None) -> Index:
    """Tokenises ``docs`` in one scan and stores its index in ``folder`` (a fresh shared one if none is given)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "postings-index")
    rows = docs.select(*keys, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("toks"))
    fields = ",".join(f"{k}:{docs.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = b.column("toks").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends, start = np.cumsum(sizes), 0
            while start < b.num_rows:
                base = ends[start - 1] if start else 0
                stop = int(np.searchsorted(ends, base + TILE_TOKENS, side="right"))
                stop = min(max(stop, start + 1), start + TILE_ROWS, b.num_rows)
                yield _tile(b.slice(start, stop - start), sizes[start:stop], tile)
                tile += 1
                start = stop

    raw = rows.mapInArrow(
        pack, f"tile long, term string, at array<int>, tf array<int>, max_tf int, min_dl int, ids array<struct<{fields}>>, dl array<int>"
    )
    # The tiles of a task hang on how its rows come in, so they are told from the one stored result.
    raw.withColumn("kind", F.when(F.col("term").isNull(), "tiles").otherwise("postings")).write.partitionBy("kind").parquet(f"{folder}/raw")
    stored = spark.read.schema(raw.schema).parquet
    postings = stored(f"{folder}/raw/kind=postings").drop("ids", "dl") if _holds(spark, f"{folder}/raw/kind=postings") else raw.limit(0).drop("ids", "dl")
    postings.repartitionByRange(F.col("term"), F.col("tile")).sortWithinPartitions("term", "tile").write.parquet(f"{folder}/postings")
    spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.sum(F.size("at")).alias("df")).write.parquet(f"{folder}/terms")
    told = Index(spark, folder, tuple(keys), 0, 0.0, raw.schema).table("tiles").agg(
        F.sum(F.size("dl")).alias("n"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)).alias("s")
    ).first()
    n = told["n"] or 0
    return Index(spark, folder, tuple(keys), n, (told["s"] or 0) / max(n, 1), raw.schema)


def _holds(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _tile(part: pa.RecordBatch, sizes: np.ndarray, tile: int) -> pa.RecordBatch:
    """One row for the tile, then one for each of its terms."""
    coded = part.column("toks").flatten().dictionary_encode()
    code, n_rows = np.asarray(coded.indices), len(sizes)
    pair, tf = np.unique(code.astype(np.int64) * n_rows + np.repeat(np.arange(n_rows), sizes), return_counts=True)
    term, at = pair // n_rows, (pair % n_rows).astype(np.int32)
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0, 0], cuts[1:], [len(pair)] if len(cuts) else [])), pa.int32()), pa.array(values, pa.int32()))
    most = np.maximum.reduceat(tf, cuts) if len(cuts) else []
    least = np.minimum.reduceat(sizes[at], cuts) if len(cuts) else []
    n = len(cuts) + 1
    names = part.schema.names[:-1]
    ids = pa.StructArray.from_arrays([part.column(k) for k in names], names=names)
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0] + [len(values)] * n, pa.int32()), values)
    words = coded.dictionary.take(pa.array(term[cuts])) if len(cuts) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, tile)), pa.concat_arrays([pa.array([None], pa.string()), words.cast(pa.string())]), lists(at), lists(tf),
            pa.array([0, *most], pa.int32()), pa.array([0, *least], pa.int32()), whole(ids), whole(pa.array(sizes, pa.int32())),
        ],
        names=["tile", "term", "at", "tf", "max_tf", "min_dl", "ids", "dl"],
    )


@dataclass(frozen=True)
class Weights:
    """Question terms as arrays: term t is asked by questions ``asked[ends[t]:ends[t + 1]]`` with weights ``w``."""

    number: dict
    ends: np.ndarray
    asked: np.ndarray
    w: np.ndarray
    questions: list

    @classmethod
    def of(cls, rows: pa.Table) -> Weights:
        term, who = rows.column("term").combine_chunks().dictionary_encode(), rows.column("query_id").combine_chunks().dictionary_encode()
        code = np.asarray(term.indices)
        order = np.argsort(code, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(term.dictionary)))))
        names = {t: i for i, t in enumerate(term.dictionary.to_pylist())}
        return cls(names, ends, np.asarray(who.indices)[order], rows.column("w").to_numpy()[order], who.dictionary.to_pylist())


class Scorer:
    """The k best rows of every question over the tiles it is shown, one after another.

    A tile's bound for a question is the sum of its terms' largest weights there. Where that stays
    below the question's k-th score so far, the tile is not scored for it.
    """

    def __init__(self, weights: Weights, k: int, avg_dl: float):
        self.weights, self.k, self.avg_dl = weights, k, avg_dl
        n = len(weights.questions)
        self.best: list[list] = [[] for _ in range(n)]
        self.kth = np.full(n, -np.inf)
        self.met = self.scored = 0

    def add(self, ids: list[tuple], dl: np.ndarray, terms: list[str], at: list, tf: list, max_tf: np.ndarray, min_dl: np.ndarray) -> None:
        w, n = self.weights, len(self.kth)
        t = np.array([w.number[x] for x in terms])
        most = L.term_weight(max_tf, min_dl, self.avg_dl)
        spans = [np.arange(w.ends[i], w.ends[i + 1]) for i in t]
        who, lengths = np.concatenate(spans), np.array([len(s) for s in spans])
        place = np.repeat(np.arange(len(t)), lengths)
        bound = np.bincount(w.asked[who], w.w[who] * most[place], minlength=n)
        live = np.flatnonzero((bound > 0) & (bound + SLACK >= self.kth - 0.00005))
        self.met += int((bound > 0).sum())
        self.scored += len(live)
        if not len(live):
            return
        row = np.full(n, -1)
        row[live] = np.arange(len(live))
        sums = np.zeros((len(live), len(dl)))
        for lo in range(0, len(t), TERM_BLOCK):
            mine = (place >= lo) & (place < lo + TERM_BLOCK) & (row[w.asked[who]] >= 0)
            part = min(TERM_BLOCK, len(t) - lo)
            wanted = np.zeros((len(live), part))
            wanted[row[w.asked[who[mine]]], place[mine] - lo] = w.w[who[mine]]
            held = np.zeros((part, len(dl)))
            for i in range(part):
                held[i, at[lo + i]] = L.term_weight(tf[lo + i], dl[at[lo + i]], self.avg_dl)
            sums += wanted @ held
        sums = np.round(sums, 4)
        for q, s in zip(live, sums, strict=True):
            found = np.flatnonzero((s > 0) & (s >= self.kth[q]))
            if len(found) > self.k:
                found = found[s[found] >= np.partition(s[found], len(found) - self.k)[len(found) - self.k]]
            if len(found):
                self.best[q] = sorted(self.best[q] + [(-s[i], ids[i]) for i in found])[: self.k]
                if len(self.best[q]) == self.k:
                    self.kth[q] = -self.best[q][-1][0]

    def rows(self):
        """(question, key tuple, score) of what was found."""
        return [(q, key, -s) for q, held in zip(self.weights.questions, self.best, strict=True) for s, key in held]


def _by_tile(batches: Iterator[pa.RecordBatch]):
    """(tile's row, postings as a table) of every tile; a tile's rows stand together, the tile's own first."""
    head, parts = None, []
    for b in batches:
        tile, own = b.column("tile").to_numpy(), np.asarray(b.column("term").is_null())
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                part = b.slice(lo, hi - lo)
                if own[lo]:
                    if head is not None and parts:
                        yield head, pa.Table.from_batches(parts)
                    head, parts, part = part.slice(0, 1), [], part.slice(1)
                if part.num_rows:
                    parts.append(part)
    if head is not None and parts:
        yield head, pa.Table.from_batches(parts)


def search(index: Index, questions: DataFrame, k: int, question: str = "question") -> DataFrame:
    """(query_id, keys, score, rank): BM25 top-k of every question, scores to 4 decimals, ties by key.

    The postings of the questions' terms are read and dealt by tile; each task scores its tiles in
    turn and leaves at most k rows a question. Question weights are broadcast, at most
    ``BROADCAST_TERMS`` of them at a time; more questions take further passes.
    """
    spark, keys = index.spark, list(index.keys)
    terms = L.question_terms(questions, question)
    n_terms = questions.agg(F.coalesce(F.sum(F.size(X.tokens(F.col(question)))), F.lit(0))).first()[0]
    weights = index.table("terms").join(broadcast_if(terms, n_terms, L.BROADCAST_TERMS), "term").select(
        "query_id", "term", (F.col("qtf") * L.idf(F.lit(index.n_docs), F.col("df"))).alias("w")
    )
    passes = max(1, -(-n_terms // L.BROADCAST_TERMS))
    weights = settle(weights) if passes > 1 else weights
    schema = index.table("tiles").schema["ids"].dataType.elementType
    full = StructType([questions.schema["query_id"], *[schema[c] for c in keys]]).add("score", DoubleType())
    arrow, avg_dl, tasks = to_arrow_schema(full), index.avg_dl, int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.createDataFrame([], full)
    for p in range(passes):
        part = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()
        if not part.num_rows:
            continue
        told = spark.sparkContext.broadcast(Weights.of(part))

        def run(batches, told=told):
            scorer = Scorer(told.value, k, avg_dl)
            for head, rows in _by_tile(batches):
                ids = list(zip(*[c.to_pylist() for c in head.column("ids")[0].values.flatten()], strict=True))
                lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("at", "tf")]
                scorer.add(ids, head.column("dl")[0].values.to_numpy().astype(np.float64), rows.column("term").to_pylist(), *lists,
                           rows.column("max_tf").to_numpy().astype(np.float64), rows.column("min_dl").to_numpy().astype(np.float64))
            out = scorer.rows()
            columns = [[r[0] for r in out], *[[r[1][i] for r in out] for i in range(len(keys))], [r[2] for r in out]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        asked = spark.createDataFrame(pa.table({"term": part.column("term").unique()}))
        held = index.table("postings").join(F.broadcast(asked), "term", "left_semi")
        rows = held.unionByName(index.table("tiles"), allowMissingColumns=True).repartition(tasks, "tile").sortWithinPartitions("tile", F.asc_nulls_first("term"))
        found = found.unionByName(rows.mapInArrow(run, full))
    return L.top_k(found, k, [F.desc("score"), *keys])
