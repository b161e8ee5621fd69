"""Search, fusion, hybrid scoring, reranking and filters over the given corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators import lexical as L
from askloom.operators import postings as P
from askloom.operators import questions as Q
from askloom.operators import retrieval as R
from askloom.operators import vectors as VS
from askloom.operators.sizes import broadcast_if
from askloom.plans import inputs as I
from askloom.plans.registry import query
from askloom.session import settle

CK = R.CHILD_KEY


def few(hits):
    """Hits settled, since several branches read them, and broadcast to what they join unless they are very many."""
    hits = settle(hits)
    return broadcast_if(hits, hits.count())


def filled(spark, d, hits):
    """Settled hits with their parents' texts; texts that no hit names stay out of the shuffle."""
    named = broadcast_if(hits.select(*R.KEY).distinct(), hits.count())
    return R.backfill_parents(hits, I.parents(spark, d).join(named, R.KEY, "left_semi"))


def vector_hits(spark, d, k=15):
    """Best 15 children of every question, one per parent, with text and group."""
    chunks = I.children(spark, d, embedded=True)
    qv = I.questions(spark, d).select("query_id", V.hashed_embedding(F.col("question")).alias("qvec"))
    return few(VS.best_child_per_parent(VS.vector_scores_topk(qv, chunks, k, CK)))


# ------------------------------------------------------------------------------ lexical
@query("tokenize_documents", f"""
SELECT doc_id, term, count(*) AS tf FROM
  (SELECT doc_id, unnest({I.TOK.format('text')}) AS term FROM documents) GROUP BY ALL""")
def _(spark, d):
    return (
        L.postings(I.documents(spark, d), ["doc_id"]).select("doc_id", "term", "tf")
    )


@query("bm25_term_statistics", f"""
WITH t AS (SELECT doc_id, {I.TOK.format('text')} AS toks FROM documents),
     s AS (SELECT count(*) AS n_docs, sum(len(toks)) / count(*) AS avg_dl FROM t)
SELECT term, count(*) AS df, any_value(n_docs) AS n_docs, round(any_value(avg_dl), 6) AS avg_dl
FROM (SELECT unnest(list_distinct(toks)) AS term FROM t), s GROUP BY term""")
def _(spark, d):
    docs = I.documents(spark, d)
    stats = L.corpus_stats(docs, ["doc_id"])
    return L.document_frequency(docs, ["doc_id"]).withColumns(
        {"n_docs": stats.select("n_docs").scalar(),
         "avg_dl": F.round(stats.select("avg_dl").scalar(), 6)}
    )


@query("bm25_topk", I.with_parts("bm25_ranked") + """
SELECT query_id, document_id, parent_id, child_id, score, rank FROM bm25_ranked WHERE rank <= 10""")
def _(spark, d):
    return P.search(I.lexical_index(spark, d), I.questions(spark, d), 10)


@query("bm25_path_hits", I.with_parts("bm25_ranked") + """
SELECT query_id, document_id, parent_id, child_id, rank, score, child_content, split_group_id,
       'BM25-' || parent_id AS source, 'bm25' AS rerank_method
FROM bm25_ranked JOIN children USING (document_id, parent_id, child_id) WHERE rank <= 15""")
def _(spark, d):
    chunks = I.children(spark, d)
    hits = few(P.search(I.lexical_index(spark, d), I.questions(spark, d), 15))
    return hits.join(chunks, CK).withColumns(
        {"source": F.concat(F.lit("BM25-"), F.col("parent_id")), "rerank_method": F.lit("bm25")}
    )


# ------------------------------------------------------------------------------ vectors
_CENTROIDS = """
q AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY ALL),
qv AS (SELECT label::BIGINT AS query_id, list(v::FLOAT::DOUBLE ORDER BY i) AS qvec FROM q GROUP BY label),
pairs AS (SELECT query_id, vec_id, round(list_cosine_similarity(qvec, embedding::DOUBLE[]), 6) AS score
          FROM qv CROSS JOIN embeddings)"""


def centroids(spark, d):
    """One question vector per label: the mean vector of its rows."""
    e = I.table(spark, d, "embeddings")
    means = F.array(*[F.avg(F.col("embedding")[i].cast("double")).cast("float") for i in range(64)])
    return e.groupBy("label").agg(means.alias("qvec")).select(
        F.col("label").cast("bigint").alias("query_id"), "qvec"
    )


@query("vector_topk", f"""WITH {_CENTROIDS}
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20""")
def _(spark, d):
    return VS.vector_scores_topk(centroids(spark, d), I.table(spark, d, "embeddings"), 20, ["vec_id"])


@query("vector_topk_filtered", f"""WITH {_CENTROIDS}
SELECT query_id, vec_id, score, rank FROM (
  SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs p JOIN documents ON vec_id = doc_id WHERE lang = 'en')
WHERE rank <= 20""")
def _(spark, d):
    english = I.documents(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    chunks = I.table(spark, d, "embeddings").join(english, "vec_id", "left_semi")
    return VS.vector_scores_topk(centroids(spark, d), chunks, 20, ["vec_id"])


@query("cosine_to_label_centroid", f"""WITH {_CENTROIDS}
SELECT vec_id, score FROM pairs JOIN embeddings e USING (vec_id) WHERE query_id = e.label""")
def _(spark, d):
    e = I.table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("query_id"))
    return e.join(centroids(spark, d), "query_id").select(
        "vec_id", V.cosine(F.col("qvec"), F.col("embedding")).alias("score")
    )


@query("text_vector_topk", I.with_parts("vec_ranked") + """
SELECT query_id, document_id, parent_id, child_id, score, rank FROM vec_ranked WHERE rank <= 15""")
def _(spark, d):
    qv = I.questions(spark, d).select("query_id", V.hashed_embedding(F.col("question")).alias("qvec"))
    return VS.vector_scores_topk(qv, I.children(spark, d, True), 15, CK)


@query("best_child_per_parent", I.with_parts("vec_hits") + "SELECT * FROM vec_hits")
def _(spark, d):
    return vector_hits(spark, d)


def group_question_vectors(spark, d):
    """Each label centroid asks inside every group its nearest 20 vectors fall in."""
    qv = centroids(spark, d)
    emb = embedded_documents(spark, d)
    top = VS.vector_scores_topk(qv, emb, 20, ["document_id"])
    hits = top.join(emb.select("document_id", "split_group_id"), "document_id")
    return qv, emb, hits


def embedded_documents(spark, d):
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    return e.join(
        I.documents(spark, d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("split_group_id")),
        "document_id",
    )


_GROUP_SQL = f"""WITH {_CENTROIDS},
pg AS (SELECT p.*, source AS split_group_id FROM pairs p JOIN documents ON vec_id = doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pg) WHERE r <= 20),
wanted AS (SELECT DISTINCT query_id, split_group_id FROM top),
cand AS (SELECT pg.* FROM pg JOIN wanted USING (query_id, split_group_id)
         WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = pg.query_id AND t.vec_id = pg.vec_id))
"""


@query("group_search", _GROUP_SQL + """
SELECT query_id, split_group_id, vec_id AS document_id, score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, split_group_id ORDER BY score DESC, vec_id) AS rank FROM cand)
WHERE rank <= 3""")
def _(spark, d):
    qv, emb, hits = group_question_vectors(spark, d)
    wanted = hits.select("query_id", "split_group_id").distinct().join(qv, "query_id")
    return VS.search_groups(wanted, emb, hits, 3, ["document_id"])


@query("group_scan_without_vector", _GROUP_SQL + """
SELECT query_id, split_group_id, vec_id AS document_id, 0.0::DOUBLE AS score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, split_group_id ORDER BY vec_id) AS rank FROM cand)
WHERE rank <= 3""")
def _(spark, d):
    _, emb, hits = group_question_vectors(spark, d)
    wanted = hits.select("query_id", "split_group_id").distinct()
    return VS.search_groups(wanted, emb, hits, 3, ["document_id"])


# ------------------------------------------------------------------------------ fusion
_RRF = dict(
    paths="""
      SELECT query_id, document_id, parent_id, child_id, rank, 0 AS path FROM vec_hits
      UNION ALL SELECT query_id, document_id, parent_id, child_id, rank, 1 FROM bm25_ranked WHERE rank <= 15""",
    fused="""
      SELECT query_id, document_id, parent_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s,
             arg_min(child_id, path * 1000 + rank) AS child_id
      FROM paths GROUP BY ALL""",
    rrf="""
      SELECT query_id, document_id, parent_id, child_id, rank, rrf_score,
             round(rrf_score / max(rrf_score) OVER (PARTITION BY query_id), 4) AS score
      FROM (SELECT *, round(s, 4) AS rrf_score,
                   row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id, parent_id) AS rank
            FROM fused) WHERE rank <= 15""",
)
_DIVERSE = dict(
    grp="""
      SELECT r.*, split_group_id, child_content FROM rrf r JOIN children USING (document_id, parent_id, child_id)""",
    marked="""
      SELECT *, row_number() OVER (PARTITION BY query_id, split_group_id ORDER BY rank) AS n_in,
             min(rank) OVER (PARTITION BY query_id, split_group_id) AS first_rank,
             min(split_group_id) OVER (PARTITION BY query_id)
               <> max(split_group_id) OVER (PARTITION BY query_id) AS many
      FROM grp""",
    diverse="""
      SELECT query_id, document_id, parent_id, child_id, score, rrf_score, split_group_id, child_content, rank AS old_rank,
             row_number() OVER (PARTITION BY query_id ORDER BY
               CASE WHEN many AND n_in <= 2 THEN 0 ELSE 1 END,
               CASE WHEN many AND n_in <= 2 THEN first_rank END NULLS FIRST,
               CASE WHEN many AND n_in > 2 THEN -score END NULLS FIRST, rank) AS rank
      FROM marked""",
)


def rrf_hits(spark, d):
    lex = P.search(I.lexical_index(spark, d), I.questions(spark, d), 15)
    return R.rrf([vector_hits(spark, d), lex], 15)


@query("rrf_fusion", I.with_parts("vec_hits", "bm25_ranked", **_RRF) + "SELECT * FROM rrf")
def _(spark, d):
    return rrf_hits(spark, d)


@query("group_diversity", I.with_parts("vec_hits", "bm25_ranked", **_RRF, **_DIVERSE) + """
SELECT query_id, document_id, parent_id, score, split_group_id, rank FROM diverse""")
def _(spark, d):
    hits = few(rrf_hits(spark, d)).join(I.children(spark, d).select(*CK, "split_group_id"), CK)
    return R.diversify(hits).select(
        "query_id", "document_id", "parent_id", "score", "split_group_id", "rank"
    )


SYNONYMS = {"the": ["retition", "ntingth"]}  # stand for the fixed ones, which name other words than these texts have
_EXPANDED = dict(
    xq="""SELECT query_id, question || ' ' || array_to_string(list_filter(['retition', 'ntingth'], lambda w: NOT contains(question, w)), ' ') AS x
      FROM questions WHERE contains(question, 'the') AND NOT (contains(question, 'retition') AND contains(question, 'ntingth'))""",
    xvec=I.PARTS["qvec"].replace("FROM questions", "FROM (SELECT query_id, x AS question FROM xq)"),
    xnorm="SELECT query_id, sqrt(sum(v * v)) AS qn FROM xvec GROUP BY query_id",
    xpairs=I.PARTS["vec_pairs"].replace("qvec", "xvec"),
    xall="""SELECT q.query_id, c.document_id, c.parent_id, c.child_id, coalesce(round(dp / nullif(qn * cn, 0), 6), 0.0) AS score
      FROM xq q CROSS JOIN children c LEFT JOIN xpairs USING (query_id, document_id, parent_id, child_id)
      LEFT JOIN xnorm USING (query_id) LEFT JOIN cnorm USING (document_id, parent_id, child_id)""",
    xhits="""SELECT query_id, document_id, parent_id, child_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, parent_id ORDER BY r) AS n
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, parent_id, child_id) AS r FROM xall)
            WHERE r <= 15) WHERE n = 1""",
)
_THREE = dict(_RRF) | dict(paths="""
      SELECT query_id, document_id, parent_id, child_id, rank, 0 AS path FROM vec_hits
      UNION ALL SELECT query_id, document_id, parent_id, child_id, rank, 1 FROM xhits
      UNION ALL SELECT query_id, document_id, parent_id, child_id, rank, 2 FROM bm25_ranked WHERE rank <= 15""")


@query("multi_path_retrieval", I.with_parts("vec_hits", "bm25_ranked", **_EXPANDED, **_THREE, **_DIVERSE) + """
SELECT query_id, document_id, parent_id, child_id, score, rrf_score, rank FROM (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM diverse)
WHERE rank <= 10""")
def _(spark, d):
    """All three paths: the questions that a synonym fits are searched a second time."""
    return R.multi_path(
        I.questions(spark, d), I.children(spark, d, True), 10, expand=lambda q: Q.expand(q, SYNONYMS),
    ).select("query_id", "document_id", "parent_id", "child_id", "score", "rrf_score", "rank")


@query("expanded_question_path", I.with_parts("vec_hits", **_EXPANDED) + "SELECT query_id, x AS expanded, document_id, parent_id, child_id, score, rank FROM xhits JOIN xq USING (query_id)")
def _(spark, d):
    """The second path's hits: expanded questions searched as vectors, unchanged ones skipped."""
    q = I.questions(spark, d).withColumn("expanded", Q.expand(F.col("question"), SYNONYMS))
    hits = R.expanded_path(q, I.children(spark, d, True), 15)
    return hits.join(q.select("query_id", "expanded"), "query_id").select("query_id", "expanded", *CK, "score", "rank")


# ------------------------------------------------------------------------------ expansion, merge, backfill
_SLOTS = dict(
    hits5="SELECT h.*, split_group_id FROM vec_hits h JOIN children USING (document_id, parent_id, child_id) WHERE rank <= 5",
    slots="""SELECT query_id, greatest(0, least(10, count(*) + 10) - count(*)) AS slots FROM hits5 GROUP BY query_id""",
    wanted="SELECT DISTINCT query_id, split_group_id, slots FROM hits5 JOIN slots USING (query_id) WHERE slots > 0",
    cand="""SELECT w.query_id, w.split_group_id, slots, v.document_id, v.parent_id, v.child_id, v.score
      FROM wanted w JOIN children c USING (split_group_id)
      JOIN vec_all v ON v.query_id = w.query_id AND v.document_id = c.document_id AND v.child_id = c.child_id
      WHERE NOT EXISTS (SELECT 1 FROM hits5 h WHERE h.query_id = w.query_id AND h.document_id = c.document_id)""",
    cut="""SELECT *, row_number() OVER (PARTITION BY query_id, split_group_id, document_id, parent_id ORDER BY r) AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, split_group_id ORDER BY score DESC, document_id, parent_id, child_id) AS r
      FROM cand) WHERE r <= slots""",
    extra="""SELECT query_id, split_group_id, document_id, parent_id, child_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY split_group_id, r) AS u FROM cut WHERE p = 1) WHERE u <= slots""",
)


def five_hits(spark, d):
    chunks = I.children(spark, d)
    return few(
        vector_hits(spark, d).where("rank <= 5")
        .join(chunks.select(*CK, "split_group_id", "child_content"), CK)
    )


def group_extra(spark, d, hits):
    qv = I.questions(spark, d).select("query_id", V.hashed_embedding(F.col("question")).alias("qvec"))
    return R.expand_split_groups(hits.withColumn("k", F.lit(5)), I.children(spark, d, True), qv, F.col("k"))


@query("split_group_expansion", I.with_parts("vec_hits", **_SLOTS) + "SELECT * FROM extra")
def _(spark, d):
    return group_extra(spark, d, five_hits(spark, d)).select(
        "query_id", "split_group_id", *CK, "score"
    )


@query("merge_expanded_hits", I.with_parts("vec_hits", **_SLOTS) + """
SELECT query_id, document_id, parent_id, child_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, document_id, parent_id) AS rank FROM (
    SELECT query_id, document_id, parent_id, child_id, score, src, row_number() OVER (PARTITION BY query_id, document_id, parent_id ORDER BY src, score DESC, child_id) AS n
    FROM (SELECT query_id, document_id, parent_id, child_id, score, 0 AS src FROM hits5
          UNION ALL SELECT query_id, document_id, parent_id, child_id, score, 1 FROM extra)) WHERE n = 1)
WHERE rank <= 8""")
def _(spark, d):
    hits = five_hits(spark, d)
    return R.merge_hits(hits, group_extra(spark, d, hits), F.lit(8)).select(
        "query_id", *CK, "score", "rank"
    )


@query("parent_backfill", I.with_parts("vec_hits", "parents") + """
SELECT query_id, document_id, parent_id, rank, length(parent_content) AS parent_chars, md5(parent_content) AS content_key
FROM vec_hits LEFT JOIN parents USING (document_id, parent_id)""")
def _(spark, d):
    return filled(spark, d, vector_hits(spark, d)).select(
        "query_id", "document_id", "parent_id", "rank",
        F.length("content").cast("bigint").alias("parent_chars"), F.md5("content").alias("content_key"),
    )


@query("source_names", I.with_parts("vec_hits", "document_info") + """
SELECT query_id, document_id, rank, coalesce(filename, '文档_' || document_id) AS source
FROM vec_hits LEFT JOIN (SELECT * FROM document_info WHERE lang <> 'en') USING (document_id)""")
def _(spark, d):
    named = R.with_source_names(vector_hits(spark, d), I.document_info(spark, d).where("lang <> 'en'"))
    return named.select("query_id", "document_id", "rank", "source")


# ------------------------------------------------------------------------------ hybrid
_HYBRID = dict(
    full="""
      SELECT query_id, document_id, parent_id, max(score / m) AS fb FROM (
        SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM bm25_ranked WHERE rank <= 30)
      GROUP BY ALL""",
    htok=f"""SELECT query_id, document_id, parent_id, {I.TOK.format('parent_content')} AS toks
      FROM vec_hits JOIN parents USING (document_id, parent_id) WHERE regexp_matches(parent_content, '\\S')""",
    hstat="SELECT query_id, count(*) AS n, avg(len(toks)) AS avgdl FROM htok GROUP BY query_id",
    htf="""SELECT query_id, document_id, parent_id, dl, term, count(*) AS tf FROM (
        SELECT query_id, document_id, parent_id, len(toks) AS dl, unnest(toks) AS term FROM htok) GROUP BY ALL""",
    hdf="SELECT query_id, term, count(*) AS df FROM htf GROUP BY ALL",
    hscore="""
      SELECT query_id, document_id, parent_id,
             round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score,
             any_value(n) AS n
      FROM qt JOIN htf USING (query_id, term) JOIN hdf USING (query_id, term) JOIN hstat USING (query_id) GROUP BY ALL""",
    hrank="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, parent_id) AS rank
      FROM hscore WHERE score > 0""",
    within="""SELECT query_id, document_id, parent_id, score / max(score) OVER (PARTITION BY query_id) AS pb
      FROM hrank WHERE rank <= least(20, n)""",
    hybrid="""
      SELECT query_id, document_id, parent_id, child_id,
             round(score + 1e-9, 4) AS vector_score, round(greatest(coalesce(fb, 0), coalesce(pb, 0)), 4) AS bm25_score,
             round((1 - wb) * score + wb * greatest(coalesce(fb, 0), coalesce(pb, 0))
                   + CASE WHEN coalesce(pb, 0) > 0.3 THEN pb * 0.6 ELSE 0 END, 4) AS score
      FROM vec_hits JOIN wts USING (query_id) LEFT JOIN full_ USING (query_id, document_id, parent_id)
      LEFT JOIN within USING (query_id, document_id, parent_id)""",
)
_HYBRID["full_"] = _HYBRID.pop("full")
_HYBRID["wts"] = """SELECT query_id, CASE WHEN regexp_matches(lower(question), 'hi|hello') THEN 0.2::DOUBLE
      ELSE 0.4::DOUBLE END AS wb FROM questions"""
_HYBRID = {k: _HYBRID[k] for k in ["wts", "full_", "htok", "hstat", "htf", "hdf", "hscore", "hrank", "within", "hybrid"]}


def classified(spark, d):
    return Q.classify(I.questions(spark, d))


def hybrid_hits(spark, d):
    hits = filled(spark, d, vector_hits(spark, d))
    return R.hybrid_scores(classified(spark, d), hits, I.children(spark, d), 10, index=I.lexical_index(spark, d))


@query("bm25_full_corpus_by_parent", I.with_parts("bm25_ranked", **{"full_": _HYBRID["full_"]}) + """
SELECT query_id, document_id, parent_id, round(fb, 6) AS full_bm25 FROM full_""")
def _(spark, d):
    ranked = P.search(I.lexical_index(spark, d), I.questions(spark, d), 30)
    return R.normalized_by_parent(ranked, "f").select(
        "query_id", "document_id", "parent_id", F.round("f", 6).alias("full_bm25")
    )


@query("bm25_within_candidates", I.with_parts("vec_hits", "parents", "bm25_ranked", **_HYBRID) + """
SELECT query_id, document_id, parent_id, score, rank FROM hrank WHERE rank <= 20""")
def _(spark, d):
    hits = filled(spark, d, vector_hits(spark, d)).select(
        "query_id", "document_id", "parent_id", F.col("content").alias("text")
    )
    return L.bm25_within(I.questions(spark, d), hits, 20, R.KEY)


@query("hybrid_scores", I.with_parts("vec_hits", "parents", "bm25_ranked", **_HYBRID) + "SELECT * FROM hybrid")
def _(spark, d):
    return hybrid_hits(spark, d).select("query_id", *CK, "vector_score", "bm25_score", "score")


@query("lexical_weights", """
SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), 'hi|hello') THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS bm25_weight,
       CASE WHEN regexp_matches(lower(text), 'hi|hello') THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS vector_weight FROM benchmark""")
def _(spark, d):
    w = R.lexical_weight(F.col("intent"), F.col("question"))
    return classified(spark, d).select(
        "query_id", w.alias("bm25_weight"), F.round(1 - w, 6).alias("vector_weight")
    )


@query("keyword_rescue", I.with_parts(
    "vec_hits", "ctf", "cdf", "cstat", wts=_HYBRID["wts"],
    terms=f"""SELECT query_id, i - 1 AS pos, t[i] AS term FROM (
        SELECT query_id, {I.TOK.format('question')} AS t FROM questions), unnest(range(1, 6)) u(i) WHERE i <= len(t)""",
    ks="""SELECT term, document_id, parent_id, child_id,
        round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 4) AS score
        FROM (SELECT DISTINCT term FROM terms) JOIN ctf USING (term) JOIN cdf USING (term), cstat""",
    kr="""SELECT *, score / max(score) OVER (PARTITION BY term) AS ns FROM (
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, document_id, parent_id, child_id) AS rank FROM ks WHERE score > 0)
        WHERE rank <= 2""",
    steps="""SELECT query_id, document_id, parent_id, list(ns ORDER BY pos, rank) AS m, arg_min(child_id, pos * 10 + rank) AS child_id
        FROM terms JOIN kr USING (term) GROUP BY ALL""",
    kw="""SELECT query_id, document_id, parent_id, child_id, round(list_reduce(m, lambda acc, x:
            least(1.5::DOUBLE, acc + CASE WHEN acc > 0 THEN 0.25 ELSE 0 END + x * 0.7), 0.0::DOUBLE), 9) AS kw FROM steps""",
    best="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, document_id, parent_id) AS n FROM kw k
        WHERE kw >= 0.6 AND NOT EXISTS (SELECT 1 FROM vec_hits h WHERE h.query_id = k.query_id
              AND h.document_id = k.document_id AND h.parent_id = k.parent_id)""",
) + """SELECT query_id, document_id, parent_id, child_id, round((1 - wb) * 0.05 + wb * kw * 0.5, 4) AS score,
       0.0::DOUBLE AS vector_score, round(kw, 4) AS bm25_score FROM best JOIN wts USING (query_id) WHERE n = 1""")
def _(spark, d):
    return R.keyword_rescue(classified(spark, d), vector_hits(spark, d), I.children(spark, d), index=I.lexical_index(spark, d))


_RERANK = dict(
    qset=f"SELECT query_id, list_distinct({I.TOK.format('question')}) AS qs FROM questions",
    reranked=f"""
      SELECT h.query_id, h.document_id, h.parent_id, h.score, parent_content AS content,
             round(0.7 * h.score + 0.3 * len(list_intersect(qs, list_distinct({I.TOK.format('parent_content')})))
                   / greatest(len(qs), 1), 9) AS rerank_score
      FROM hybrid h JOIN parents USING (document_id, parent_id) JOIN qset USING (query_id)""",
    rr="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, document_id, parent_id) AS rank FROM reranked""",
)


def reranked(spark, d, k=10):
    return R.heuristic_rerank(I.questions(spark, d), hybrid_hits(spark, d), k)


@query("heuristic_rerank", I.with_parts("vec_hits", "parents", "bm25_ranked", **_HYBRID, **_RERANK) + """
SELECT query_id, document_id, parent_id, round(rerank_score, 6) AS rerank_score, rank FROM rr WHERE rank <= 10""")
def _(spark, d):
    return reranked(spark, d).select(
        "query_id", "document_id", "parent_id", F.round("rerank_score", 6).alias("rerank_score"), "rank"
    )


@query("external_rerank_scores", I.with_parts("vec_hits", "parents") + """
SELECT query_id, document_id, parent_id, rerank_score, rank FROM (
  SELECT query_id, document_id, parent_id, rerank_score,
         row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, document_id, parent_id) AS rank
  FROM (SELECT h.*, round(length(parent_content) % 97 / 97.0, 6) AS rerank_score
        FROM vec_hits h JOIN parents USING (document_id, parent_id) WHERE h.rank % 4 <> 0)) WHERE rank <= 5""")
def _(spark, d):
    hits = filled(spark, d, vector_hits(spark, d))
    # stands for the stored reply of a rerank model, which skips every fourth position
    scores = hits.select(
        "query_id", F.col("rank").alias("position"),
        F.when(F.col("rank") % 4 != 0, F.round((F.length("content") % 97) / 97.0, 6)).alias("rerank_score"),
    )
    return R.apply_external_scores(hits, scores, 5).select(
        "query_id", "document_id", "parent_id", "rerank_score", "rank"
    )


def _fold_sql(source: str, threshold: str = "0.9") -> str:
    """Keep-first fold over (query_id, rank, g) rows of ``source``."""
    return f"""SELECT query_id, unnest(list_transform(kept, lambda s: s.rank)) AS rank FROM (
      SELECT query_id, list_reduce(h, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
          len(list_intersect(k.g, x[1].g))::DOUBLE
            > {threshold} * (len(k.g) + len(x[1].g) - len(list_intersect(k.g, x[1].g))))) > 0
          THEN acc ELSE list_concat(acc, x) END) AS kept
      FROM (SELECT query_id, list([{{'rank': rank, 'g': g}}] ORDER BY rank) AS h FROM {source} GROUP BY query_id))"""


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substring({0}, i, 3)))"


@query("near_duplicate_hits", I.with_parts(
    "vec_hits", hg=f"SELECT query_id, rank, {_GRAMS.format('child_content')} AS g FROM vec_hits JOIN children USING (document_id, parent_id, child_id)",
    kept=_fold_sql("hg"),
) + "SELECT query_id, rank FROM kept")
def _(spark, d):
    hits = vector_hits(spark, d).join(I.children(spark, d).select(*CK, "child_content"), CK)
    return R.drop_similar_hits(hits, "child_content").select("query_id", "rank")


_QUALITY = dict(
    qbase=f"""SELECT query_id, document_id, parent_id, rank, rerank_score, {_GRAMS.format('content')} AS g,
               length(content) AS n FROM rr WHERE rank <= 10""",
    hi_in="SELECT * FROM qbase WHERE n >= 20 AND rerank_score >= 0.30",
    lo_in="SELECT * FROM qbase WHERE n >= 20 AND rerank_score >= 0.15",
    hi=_fold_sql("hi_in"), lo=_fold_sql("lo_in"),
    tier="""SELECT query_id, (SELECT count(*) FROM hi WHERE hi.query_id = q.query_id) AS nh,
              (SELECT count(*) FROM lo WHERE lo.query_id = q.query_id) AS nl FROM (SELECT DISTINCT query_id FROM qbase) q""",
    passed="""SELECT b.* FROM qbase b JOIN tier USING (query_id) WHERE
        CASE WHEN nh >= 3 THEN EXISTS (SELECT 1 FROM hi WHERE hi.query_id = b.query_id AND hi.rank = b.rank)
             WHEN nl > 0 THEN EXISTS (SELECT 1 FROM lo WHERE lo.query_id = b.query_id AND lo.rank = b.rank)
             ELSE b.rank <= 3 END""",
)


@query("quality_filter", I.with_parts("vec_hits", "parents", "bm25_ranked", **_HYBRID, **_RERANK, **_QUALITY) + """
SELECT query_id, document_id, parent_id, rank FROM passed""")
def _(spark, d):
    return R.quality_filter(reranked(spark, d)).select("query_id", "document_id", "parent_id", "rank")


@query("result_quality", I.with_parts("vec_hits", "parents") + """
SELECT query_id, coalesce(round(0.6 * avg(score) + 0.4 * least(avg(length(parent_content)) / 500, 1.0), 4), 0) AS quality_score,
       coalesce(round(avg(score), 4), 0) AS avg_similarity, coalesce(round(avg(length(parent_content)), 2), 0) AS avg_content_length,
       count(rank) AS result_count, count(rank) > 0 AS has_results
FROM questions LEFT JOIN (SELECT * FROM vec_hits JOIN parents USING (document_id, parent_id) WHERE score > 0.5) USING (query_id) GROUP BY query_id""")
def _(spark, d):
    hits = filled(spark, d, vector_hits(spark, d).where("score > 0.5"))
    return R.result_quality(I.questions(spark, d), hits)


@query("role_filter", I.with_parts("vec_hits", "document_info") + """
SELECT query_id, role, document_id, rank FROM vec_hits JOIN document_info USING (document_id)
CROSS JOIN (VALUES ('student'), ('teacher'), ('admin'), ('guest')) r(role)
WHERE role = 'admin' OR (role = 'teacher' AND visibility IN ('public', 'internal')) OR (role = 'student' AND visibility = 'public')""")
def _(spark, d):
    hits = vector_hits(spark, d).join(I.document_info(spark, d).select("document_id", "visibility"), "document_id")
    roles = F.explode(F.array(*[F.lit(r) for r in ("student", "teacher", "admin", "guest")]))
    return R.filter_by_role(hits.withColumn("role", roles)).select("query_id", "role", "document_id", "rank")


@query("dynamic_topk_cut", I.with_parts("vec_hits") + """
SELECT query_id, document_id, parent_id, rank FROM vec_hits WHERE rank <= greatest(5, query_id % 4 * 3)""")
def _(spark, d):
    k = F.greatest(F.lit(5), F.col("query_id") % 4 * 3)
    hits = vector_hits(spark, d).withColumn("k", k).drop("rank")
    return L.top_k(hits, F.col("k"), [F.desc("score"), *CK]).select("query_id", "document_id", "parent_id", "rank")


@query("retrieve_contexts")
def _(spark, d):
    return R.retrieve(
        I.questions(spark, d), I.children(spark, d, True), I.parents(spark, d), I.document_info(spark, d), 5,
        index=I.lexical_index(spark, d),
    ).drop("content", "child_content")


@query("evaluation_retrieval")
def _(spark, d):
    """Evaluation variant: no question expansion, what a teacher may read."""
    return R.retrieve(
        I.questions(spark, d), I.children(spark, d, True), I.parents(spark, d),
        I.document_info(spark, d), 5, expansion=False, role="teacher", index=I.lexical_index(spark, d),
    ).drop("content", "child_content")
