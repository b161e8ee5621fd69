"""Fusion, hybrid scoring, reranking and filtering of hits for a whole table of questions.

Hits are keyed (query_id, document_id, parent_id); list order is an explicit ``rank``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators import lexical as L
from askloom.operators import postings as P
from askloom.operators import questions as Q
from askloom.operators import vectors as VS
from askloom.operators.sizes import broadcast_if
from askloom.session import settle

KEY = ["document_id", "parent_id"]
CHILD_KEY = ["document_id", "parent_id", "child_id"]


def rerank_rows(hits: DataFrame, by: list) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*by)
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint"))


def group_of(df_group: str = "split_group_id", doc: str = "document_id") -> Column:
    return F.coalesce(
        F.nullif(F.col(df_group), F.lit("")), F.concat(F.lit("doc_"), F.col(doc).cast("string"))
    )


# ------------------------------------------------------------------------------ fusion
def rrf(paths: list[DataFrame], k, constant: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, document_id, parent_id, child_id, rank).

    A parent met by several rows of one list adds one term per row. The child shown is the one
    seen first (path order, then rank). Order is decided on unrounded sums.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            p.select("query_id", *CHILD_KEY, "rank").withColumn("path", F.lit(i))
            for i, p in enumerate(paths)
        ],
    )
    fused = rows.groupBy("query_id", *KEY).agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("s"),
        F.min_by("child_id", F.struct("path", "rank")).alias("child_id"),
    )
    cut = L.top_k(
        fused.withColumn("s", F.round("s", 12)), k, [F.desc("s"), *KEY]
    ).withColumn("rrf_score", F.round("s", 4))
    top = F.max("rrf_score").over(Window.partitionBy("query_id"))
    return cut.withColumn(
        "score", F.when(top > 0, F.round(F.col("rrf_score") / top, 4)).otherwise(1.0)
    ).drop("s")


def diversify(hits: DataFrame, per_group: int = 2) -> DataFrame:
    """First rows of every split group come first, the others follow by score."""
    by_group = Window.partitionBy("query_id", "_g").orderBy("rank")
    in_query = Window.partitionBy("query_id")
    marked = hits.withColumn("_g", group_of()).withColumns(
        {
            "_in": F.row_number().over(by_group),
            "_lo": F.min("_g").over(in_query),
            "_hi": F.max("_g").over(in_query),
            "_first": F.min("rank").over(Window.partitionBy("query_id", "_g")),
        }
    )
    reserved = (F.col("_in") <= per_group) & (F.col("_lo") != F.col("_hi"))
    order = [
        F.when(reserved, 0).otherwise(1),
        F.when(reserved, F.col("_first")),
        F.when(~reserved & (F.col("_lo") != F.col("_hi")), -F.col("score")),
        "rank",
    ]
    return rerank_rows(marked, order).drop("_g", "_in", "_lo", "_hi", "_first")


def within(rows: DataFrame, widths: DataFrame | None, factor: int = 1) -> DataFrame:
    """Ranked rows up to ``factor`` times each question's own width; without widths all rows."""
    if widths is None:
        return rows
    return rows.join(widths, "query_id").where(F.col("rank") <= F.col("width") * factor).drop("width")


def with_children(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with columns of their children; hits, few as counted, go to the scan of the chunks, not the chunks to them."""
    hits = settle(hits)
    return broadcast_if(hits, hits.count()).join(chunks.select(*CHILD_KEY, *columns), CHILD_KEY)


def indexed(chunks: DataFrame, index: P.Index | None) -> P.Index:
    """The index of the chunks, built here unless the caller holds one."""
    return index or P.build_index(chunks, CHILD_KEY, "child_content")


def _lexical(questions: DataFrame, chunks: DataFrame, k: int, index: P.Index | None) -> DataFrame:
    """BM25 by the index, if the caller holds one; without it by scans, or by an index made here for very many terms."""
    if index is None and (questions.agg(F.sum(F.size(X.tokens(F.col("question"))))).first()[0] or 0) <= L.BROADCAST_TERMS:
        return L.bm25_scan(questions, chunks, k, CHILD_KEY, "child_content")
    return P.search(indexed(chunks, index), questions, k)


def expanded_path(
    questions: DataFrame, chunks: DataFrame, k: int, embed=V.hashed_embedding, widths: DataFrame | None = None
) -> DataFrame:
    """The second path: best child per parent for the ``expanded`` text of each question that expansion changed."""
    changed = questions.where(F.col("expanded") != F.col("question"))
    hits = VS.vector_scores_topk(changed.select("query_id", embed(F.col("expanded")).alias("qvec")), chunks, k, CHILD_KEY)
    return VS.best_child_per_parent(within(hits, widths))


def multi_path(
    questions: DataFrame, chunks: DataFrame, k, embed=V.hashed_embedding, diversity_order: bool = False,
    widths: DataFrame | None = None, index: P.Index | None = None, expand=Q.expand,
) -> DataFrame:
    """Three paths (vector, expanded vector, BM25), fused, diversified, cut to k.

    ``questions`` is (query_id, question); ``chunks`` carries CHILD_KEY, child_content,
    split_group_id and embedding. ``widths`` (query_id, width), none above k, narrows every path and
    the fusion to a question's own width.
    """
    wide = max(k, K.MIN_CANDIDATES)
    qs = questions.select(
        "query_id", "question", expand(F.col("question")).alias("expanded")
    )
    # both vector paths in one scan: a question and its expansion are two questions of it
    asked = qs.select(F.concat(F.lit("1:"), F.col("query_id").cast("string")).alias("query_id"), embed(F.col("question")).alias("qvec")).unionByName(
        qs.where(F.col("expanded") != F.col("question")).select(F.concat(F.lit("2:"), F.col("query_id").cast("string")).alias("query_id"), embed(F.col("expanded")).alias("qvec"))
    )
    found = settle(VS.vector_scores_topk(asked, chunks, wide, CHILD_KEY))
    own = F.expr("substring(query_id, 3)").cast(qs.schema["query_id"].dataType)
    vec, vec2 = (VS.best_child_per_parent(within(found.where(F.col("query_id").startswith(p)).withColumn("query_id", own), widths)) for p in ("1:", "2:"))
    lex = within(_lexical(qs, chunks, wide, index), widths)
    fused = with_children(within(rrf([vec, vec2, lex], wide), widths), chunks, "child_content", "split_group_id")
    diverse = diversify(fused)
    if not diversity_order:
        diverse = rerank_rows(diverse, [F.desc("score"), "rank"])
    return diverse.where(F.col("rank") <= k)


# ------------------------------------------------------------------------------ group expansion
def expand_split_groups(
    hits: DataFrame, chunks: DataFrame, question_vectors: DataFrame, top_k: Column
) -> DataFrame:
    """Further files of the groups that were hit, within the free slots of each question.

    Slots = max(0, min(2k, n+10) - n). Groups are visited by id; each may use what is left.
    """
    per_query = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.first(top_k).alias("k"))
    slots = per_query.select(
        "query_id",
        F.greatest(F.lit(0), F.least(F.col("k") * 2, F.col("n") + 10) - F.col("n")).alias("slots"),
    ).where(F.col("slots") > 0)
    wanted = (
        hits.where(F.coalesce(F.col("split_group_id"), F.lit("")) != "")
        .select("query_id", "split_group_id").distinct()
        .join(slots, "query_id")
        .join(question_vectors, "query_id")
    )
    # never more than ten free slots, by the formula above
    cut = VS.search_groups(wanted, chunks, hits, 10, CHILD_KEY).withColumnRenamed("rank", "_r")
    cut = cut.join(slots, "query_id").where(F.col("_r") <= F.col("slots"))
    parent = Window.partitionBy("query_id", "split_group_id", *KEY).orderBy("_r")
    best = cut.withColumn("_p", F.row_number().over(parent)).where("_p = 1")
    used = Window.partitionBy("query_id").orderBy("split_group_id", "_r")
    chosen = best.withColumn("_u", F.row_number().over(used)).where(F.col("_u") <= F.col("slots"))
    return with_children(chosen.drop("_r", "_p", "_u", "slots"), chunks, "child_content")


def merge_hits(originals: DataFrame, extra: DataFrame, k: Column | None = None, discount: float = 1.0):
    """Originals first, then additions with a parent not seen yet; sorted by score, cut to k."""
    cols = [c for c in originals.columns if c in extra.columns and c != "rank"]
    both = originals.select(*cols, F.lit(0).alias("_src")).unionByName(
        extra.select(*cols, F.lit(1).alias("_src")).withColumn("score", F.col("score") * discount)
    )
    w = Window.partitionBy("query_id", *KEY).orderBy("_src", F.desc("score"), "child_id")
    first = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    out = rerank_rows(first, [F.desc("score"), "_src", *KEY]).drop("_n", "_src")
    return out if k is None else out.where(F.col("rank") <= k)


def backfill_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent text by (document, parent); an existing non-empty ``content`` is kept."""
    filled = hits.drop("parent_content").join(
        parents.select(*KEY, "parent_content"), KEY, "left"
    )
    content = F.nullif(F.col("content"), F.lit("")) if "content" in hits.columns else F.lit(None)
    return filled.withColumn("content", F.coalesce(content, F.col("parent_content")))


# ------------------------------------------------------------------------------ hybrid scores
def lexical_weight(intent: Column, question: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in K.LEXICAL_WEIGHTS.items() for x in kv])
    return F.coalesce(
        F.element_at(known, F.coalesce(intent, F.lit(""))),
        F.when(X.cjk_count(question) > 10, 0.5).otherwise(0.4),
    )


def normalized_by_parent(ranked: DataFrame, name: str) -> DataFrame:
    """Scores over the question's best one, then the best child of each parent."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("_s", F.when(top > 0, F.col("score") / top).otherwise(0.0))
        .groupBy("query_id", *KEY)
        .agg(F.max("_s").alias(name))
    )


def hybrid_scores(
    questions: DataFrame, hits: DataFrame, chunks: DataFrame, top_k: int, widths: DataFrame | None = None,
    index: P.Index | None = None,
) -> DataFrame:
    """vector, lexical and combined score of every hit.

    ``questions`` is (query_id, question, intent); ``hits`` carries content/parent_content/score.
    ``widths`` (query_id, width), none above ``top_k``, takes its place question by question.
    """
    full = normalized_by_parent(
        within(P.search(indexed(chunks, index), questions, top_k * 3), widths, 3), "full_bm25"
    )
    texts = hits.select(
        "query_id", *KEY,
        F.coalesce(F.nullif("content", F.lit("")), "parent_content", F.lit("")).alias("text"),
    )
    sizes = texts.where(~X.is_blank(F.col("text"))).groupBy("query_id").count()
    inside = (
        within(L.bm25_within(questions, texts, 2 * top_k, KEY), widths, 2)
        .join(sizes, "query_id")
        .where(F.col("rank") <= F.col("count"))
    )
    parent = normalized_by_parent(inside, "parent_bm25")
    q = questions.select(
        "query_id", lexical_weight(F.col("intent"), F.col("question")).alias("wb")
    )
    joined = (
        hits.join(q, "query_id")
        .join(full, ["query_id", *KEY], "left")
        .join(parent, ["query_id", *KEY], "left")
    )
    fb, pb = F.coalesce("full_bm25", F.lit(0.0)), F.coalesce("parent_bm25", F.lit(0.0))
    total = F.greatest(fb, pb)
    boost = F.when(pb > 0.3, pb * 0.6).otherwise(0.0)
    return joined.withColumns(
        {
            "vector_score": F.round("score", 4),
            "bm25_score": F.round(total, 4),
            "score": F.round((1 - F.col("wb")) * F.col("score") + F.col("wb") * total + boost, 4),
        }
    ).drop("wb", "full_bm25", "parent_bm25", "rank")


def keyword_rescue(
    questions: DataFrame, hits: DataFrame, chunks: DataFrame, terms_used: int = 5, hits_per_term: int = 2, parents_added: int = 1,
    index: P.Index | None = None,
) -> DataFrame:
    """Parents, ``parents_added`` per question, that strong single terms find and the hits lack.

    The first ``terms_used`` terms (length two and more) each bring their BM25 top ``hits_per_term``. A parent's score adds
    0.7 per normalized match, +0.25 from the second match on, capped at 1.5, in term order.
    """
    terms = questions.select(
        "query_id", "question", "intent",
        F.posexplode(F.slice(X.tokens(F.col("question"), ()), 1, terms_used)).alias("pos", "term"),
    )
    single = terms.select(
        F.col("term").alias("query_id"), F.col("term").alias("question")
    ).distinct()
    found = P.search(indexed(chunks, index), single, hits_per_term).withColumnRenamed("query_id", "term")
    top = F.max("score").over(Window.partitionBy("term"))
    ns = found.select("term", *CHILD_KEY, "rank", (F.col("score") / top).alias("ns"))
    steps = (
        terms.join(ns, "term")
        .groupBy("query_id", *KEY)
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "rank", "ns"))).alias("m"),
            F.min_by("child_id", F.struct("pos", "rank")).alias("child_id"),
        )
    )
    score = F.aggregate(
        "m", F.lit(0.0),
        lambda acc, s: F.least(
            F.lit(1.5), acc + F.when(acc > 0, 0.25).otherwise(0.0) + s["ns"] * 0.7
        ),
    )
    strong = steps.select("query_id", *KEY, "child_id", F.round(score, 9).alias("kw")).where("kw >= 0.6")
    missing = strong.join(hits.select("query_id", *KEY), ["query_id", *KEY], "left_anti")
    best = L.top_k(missing, parents_added, [F.desc("kw"), *KEY]).drop("rank")
    q = questions.select(
        "query_id", lexical_weight(F.col("intent"), F.col("question")).alias("wb")
    )
    return best.join(q, "query_id").select(
        "query_id", *KEY, "child_id",
        F.round((1 - F.col("wb")) * 0.05 + F.col("wb") * F.col("kw") * 0.5, 4).alias("score"),
        F.lit(0.0).alias("vector_score"), F.round("kw", 4).alias("bm25_score"),
    )


def heuristic_rerank(questions: DataFrame, hits: DataFrame, k, text: str = "content") -> DataFrame:
    """0.7 × score + 0.3 × share of question tokens found in the text."""
    q = questions.select(
        "query_id", F.array_distinct(X.tokens(F.col("question"), ())).alias("_q")
    )
    words = F.array_distinct(X.tokens(F.col(text), ()))
    share = F.size(F.array_intersect("_q", words)) / F.greatest(F.size("_q"), F.lit(1))
    scored = hits.join(q, "query_id").withColumn(
        "rerank_score", F.round(0.7 * F.col("score") + 0.3 * share, 9)
    ).drop("_q", "rank")
    return L.top_k(scored, k, [F.desc("rerank_score"), *KEY])


def apply_external_scores(hits: DataFrame, scores: DataFrame, k) -> DataFrame:
    """Reranker scores by (query_id, position); rows without text or score drop out."""
    joined = hits.join(scores, (hits["query_id"] == scores["query_id"]) & (hits["rank"] == scores["position"]))
    rows = joined.where(
        ~X.is_blank(F.col("content")) & scores["rerank_score"].isNotNull()
    ).select(hits["*"], scores["rerank_score"]).drop("rank")
    return L.top_k(rows, k, [F.desc("rerank_score"), *KEY])


# ------------------------------------------------------------------------------ filters
def _keep_first(array: Column, element_type, threshold: float) -> Column:
    """Fold over hits in rank order that keeps those unlike every kept one."""
    return F.aggregate(
        array,
        F.array().cast(element_type),
        lambda acc, h: F.when(
            F.exists(acc, lambda k: X.jaccard_of_sets(k["_g"], h["_g"]) > threshold), acc
        ).otherwise(F.concat(acc, F.array(h))),
    )


def _hit_arrays(hits: DataFrame, text: Column, **extra: Column) -> DataFrame:
    """One row per question holding its hits in rank order (at most its top-k)."""
    fields = ["rank", *[c for c in hits.columns if c not in ("query_id", "rank")]]
    marked = hits.withColumns({"_g": X.shingles(F.coalesce(text, F.lit(""))), **extra})
    return marked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields, "_g", *extra))).alias("_h")
    )


def drop_similar_hits(hits: DataFrame, text: str, threshold: float = K.HIT_DUPLICATE_THRESHOLD):
    """Per question, drop hits whose text is nearly that of a kept, higher-ranked one.

    One question holds at most its top-k hits, so the fold works on a short array.
    """
    rows = _hit_arrays(hits, F.col(text))
    kept = _keep_first(F.col("_h"), rows.schema["_h"].dataType, threshold)
    return rows.select("query_id", F.inline(kept)).drop("_g").select(*hits.columns)


def quality_filter(hits: DataFrame, min_chars: int = K.QUALITY_MIN_CHARS) -> DataFrame:
    """Adaptive threshold: the high tier if three hits pass it, else the low one, else the first 3."""
    body = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("content", "parent_content", "child_content") if c in hits.columns],
        F.lit(""),
    )
    score = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    rows = _hit_arrays(hits, body, _s=score, _n=F.length(body))
    kind = rows.schema["_h"].dataType

    def tier(threshold: float) -> Column:
        passing = F.filter("_h", lambda h: (h["_n"] >= min_chars) & (h["_s"] >= threshold))
        return _keep_first(passing, kind, K.HIT_DUPLICATE_THRESHOLD)

    tiers = rows.withColumns({"_hi": tier(K.QUALITY_HIGH), "_lo": tier(K.QUALITY_LOW)})
    chosen = (
        F.when(F.size("_hi") >= K.QUALITY_MIN_RESULTS, F.col("_hi"))
        .when(F.size("_lo") > 0, F.col("_lo"))
        .otherwise(F.slice("_h", 1, K.QUALITY_MIN_RESULTS))
    )
    return tiers.select("query_id", F.inline(chosen)).select(*hits.columns)


def result_quality(questions: DataFrame, hits: DataFrame, text: str = "content") -> DataFrame:
    """Per question: 0.6 × mean score + 0.4 × min(mean length / 500, 1); questions without hits too."""
    agg = hits.groupBy("query_id").agg(
        F.avg("score").alias("s"), F.avg(F.length(F.coalesce(text, F.lit("")))).alias("len"),
        F.count("*").alias("n"),
    )
    return questions.select("query_id").join(agg, "query_id", "left").select(
        "query_id",
        F.coalesce(F.round(0.6 * F.col("s") + 0.4 * F.least(F.col("len") / 500, F.lit(1.0)), 4), F.lit(0.0)).alias("quality_score"),
        F.coalesce(F.round("s", 4), F.lit(0.0)).alias("avg_similarity"),
        F.coalesce(F.round("len", 2), F.lit(0.0)).alias("avg_content_length"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("result_count"),
        F.col("n").isNotNull().alias("has_results"),
    )


def visible_to(role: Column, visibility: Column) -> Column:
    seen = F.coalesce(visibility, F.lit("public"))
    ok = role == "admin"
    for name, allowed in K.ROLE_VISIBILITY.items():
        ok = ok | ((role == name) & seen.isin(allowed))
    return F.coalesce(ok, F.lit(False))


def filter_by_role(hits: DataFrame, role: str = "role", visibility: str = "visibility") -> DataFrame:
    return hits.where(visible_to(F.col(role), F.col(visibility)))


def with_source_names(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """File name of each hit, 文档_{id} where the document is unknown."""
    names = documents.select("document_id", "filename")
    return hits.join(names, "document_id", "left").withColumn(
        "source", F.coalesce("filename", F.concat(F.lit("文档_"), F.col("document_id").cast("string")))
    ).drop("filename")


# ------------------------------------------------------------------------------ driver
MULTI_PATH_FROM = 5  # results from which on a question is searched along three paths


def _texts(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent texts of settled hits; the child's own where the parent is unknown. Texts no hit names stay out of the shuffle."""
    named = broadcast_if(hits.select(*KEY).distinct(), hits.count())
    filled = backfill_parents(hits, parents.join(named, KEY, "left_semi"))
    return settle(filled.withColumn("content", F.coalesce("content", "child_content")))


def retrieve(
    questions: DataFrame, chunks: DataFrame, parents: DataFrame, documents: DataFrame, k: int = 5,
    embed=V.hashed_embedding, expansion: bool = True, use_quality: bool = True, role: str | None = None,
    index: P.Index | None = None,
) -> DataFrame:
    """Contexts for every question: recall, expansion, hybrid score, rerank, filters, final cut.

    Small talk is answered without retrieval and has no contexts. From five results on a question is
    searched along three paths, each as wide as three times its own k and 20 at least; below five
    along the vector path alone, four times its k wide and 30 at least. A hit whose parent is unknown
    shows its child's text. All lexical searches read one index: ``index``, or one built of ``chunks`` here.

    ``questions`` is (query_id, question). The result keeps max(strategy k, k) rows per question.
    """
    index = indexed(chunks, index)
    qs = settle(Q.classify(questions)).where(~F.col("direct_answer")).withColumn("k", F.greatest("strategy_top_k", F.lit(k)))
    if expansion:
        qs = qs.withColumn(
            "question",
            F.when(F.col("use_expansion"), Q.expand(F.col("question"))).otherwise(F.col("question")),
        )
    qs = settle(qs)
    widest = max(k, max(s[0] for s in K.STRATEGIES.values()))
    many = F.col("k") >= MULTI_PATH_FROM
    widths = qs.select(
        "query_id",
        F.when(many, F.greatest(F.col("k") * 3, F.lit(20))).otherwise(F.greatest(F.col("k") * 4, F.lit(30))).alias("width"), many.alias("_many"),
    )
    # The hits of a stage are a few rows per question and feed several branches: settle them.
    hits = multi_path(
        qs.where(many), chunks, max(widest * 3, 20), embed, widths=widths.where("_many").drop("_many"), index=index
    )
    if k < MULTI_PATH_FROM:
        vectors = qs.where(~many).select("query_id", embed(F.col("question")).alias("qvec"))
        alone = within(VS.vector_scores_topk(vectors, chunks, max(4 * MULTI_PATH_FROM, 30), CHILD_KEY), widths.drop("_many"))
        alone = with_children(VS.best_child_per_parent(alone), chunks, "child_content", "split_group_id")
        hits = hits.select(*[c for c in hits.columns if c in alone.columns]).unionByName(alone, allowMissingColumns=True)
    hits = settle(hits.join(qs.select("query_id", "k"), "query_id"))
    vecs = qs.select("query_id", embed(F.col("question")).alias("qvec"))
    extra = expand_split_groups(hits, chunks, vecs, F.col("k"))
    hits = settle(merge_hits(hits.drop("k"), extra))
    hits = _texts(hits, parents)
    wide = F.when(F.col("intent") == "fact", F.greatest("k", F.lit(15))).otherwise(
        F.greatest("k", F.lit(10))
    )
    limits = settle(qs.select("query_id", "k", wide.alias("wide")))
    scored = hybrid_scores(qs, hits, chunks, max(widest, 15), limits.select("query_id", F.col("wide").alias("width")), index)
    rescued = keyword_rescue(qs, hits, chunks, index=index)
    cols = ["query_id", *CHILD_KEY, "score", "vector_score", "bm25_score"]
    both = scored.select(*cols).unionByName(rescued.select(*cols))
    both = _texts(settle(with_children(both, chunks, "child_content", "split_group_id")), parents)
    ranked = heuristic_rerank(qs, both.join(limits, "query_id"), F.col("wide"))
    if use_quality:
        ranked = quality_filter(ranked)
    named = with_source_names(ranked, documents)
    if role is not None:
        vis = documents.select("document_id", "visibility")
        named = filter_by_role(named.join(vis, "document_id", "left").withColumn("role", F.lit(role)))
    return L.top_k(
        named.withColumn("score", F.col("rerank_score")), F.col("k"), [F.desc("score"), *KEY]
    ).select(
        "query_id", "rank", *KEY, "child_id", "source", F.round("score", 6).alias("score"),
        "vector_score", "bm25_score", "split_group_id", "content", "child_content",
    )
