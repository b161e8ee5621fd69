"""Domain tables derived from the given tables, as DataFrames and as SQL for the checks.

Documents are the corpus, their lines the searchable children, ``source`` the split group;
benchmark passages are the questions and the golden set; conversations are chat sessions;
events are the request log; customers are the users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators import postings as P
from askloom.sources.tables import read_table


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows of a small, single-split file over the cores before heavy per-row work.

    Files of a real corpus have many splits already; there this is skipped.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def document_info(spark, d) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        "lang", F.col("source").alias("split_group_id"),
        F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "internal")
        .otherwise("confidential").alias("visibility"),
    )


def lines(spark, d) -> DataFrame:
    """(doc_id, source, line_no, line) of every line."""
    return documents(spark, d).select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def children(spark, d, embedded: bool = False) -> DataFrame:
    """Non-blank lines as child chunks of one parent per document."""
    out = (
        lines(spark, d)
        .where(~X.is_blank(F.col("line")))
        .select(
            F.col("doc_id").alias("document_id"), F.lit("p0").alias("parent_id"),
            F.concat(F.lit("p0_c"), F.col("line_no")).alias("child_id"),
            F.col("line").alias("child_content"), F.col("source").alias("split_group_id"),
        )
    )
    return out.withColumn("embedding", V.hashed_embedding(F.col("child_content"))) if embedded else out


_INDEXES: dict = {}


def lexical_index(spark, d) -> P.Index:
    """The stored index of ``children``: built by the first query of an application that asks, then read by all.

    It is built anew when the documents' files have changed.
    """
    key = (spark.sparkContext.applicationId, d, *_stamp(spark, f"{d.rstrip('/')}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = P.build_index(children(spark, d), ["document_id", "parent_id", "child_id"], "child_content")
    return _INDEXES[key]


def _stamp(spark, path: str) -> tuple[int, int, int]:
    """Count, bytes and newest time of the files under a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    n = size = newest = 0
    while files.hasNext():
        f = files.next()
        n, size, newest = n + 1, size + f.getLen(), max(newest, f.getModificationTime())
    return n, size, newest


def parents(spark, d) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("document_id"), F.lit("p0").alias("parent_id"),
        F.col("text").alias("parent_content"),
    )


# ------------------------------------------------------------------------------ SQL
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{Nd}}_]{{2,}}')"

PARTS = {
    "questions": "SELECT item_id AS query_id, text AS question FROM benchmark",
    "children": """
        SELECT doc_id AS document_id, 'p0' AS parent_id, 'p0_c' || (i - 1) AS child_id,
               ls[i] AS child_content, source AS split_group_id
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents) d,
             unnest(range(1, len(ls) + 1)) AS u(i)
        WHERE regexp_matches(ls[i], '\\S')""",
    "parents": "SELECT doc_id AS document_id, 'p0' AS parent_id, text AS parent_content FROM documents",
    "document_info": """
        SELECT doc_id AS document_id, source || '_' || doc_id || '.txt' AS filename, lang,
               source AS split_group_id,
               CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'confidential' END AS visibility
        FROM documents""",
    # ---- BM25 of questions over children
    "qt": f"""
        SELECT query_id, term, count(*) AS qtf
        FROM (SELECT query_id, unnest({TOK.format('question')}) AS term FROM questions) GROUP BY ALL""",
    "ct": f"""
        SELECT document_id, parent_id, child_id, len(toks) AS dl, toks
        FROM (SELECT *, {TOK.format('child_content')} AS toks FROM children)""",
    "ctf": """
        SELECT document_id, parent_id, child_id, dl, term, count(*) AS tf
        FROM (SELECT document_id, parent_id, child_id, dl, unnest(toks) AS term FROM ct) GROUP BY ALL""",
    "cdf": "SELECT term, count(*) AS df FROM ctf GROUP BY term",
    "cstat": "SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM ct",
    "bm25_all": """
        SELECT query_id, document_id, parent_id, child_id,
               round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5
                         / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
        FROM qt JOIN ctf USING (term) JOIN cdf USING (term), cstat
        GROUP BY query_id, document_id, parent_id, child_id""",
    "bm25_ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id
                     ORDER BY score DESC, document_id, parent_id, child_id) AS rank
        FROM bm25_all WHERE score > 0""",
    # ---- hashed embeddings, sparse
    "qvec": f"""
        SELECT query_id, (c >> 1) % 64 AS slot, sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
        FROM (SELECT query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS c
              FROM (SELECT query_id, unnest({TOK.format('question')}) AS t FROM questions))
        GROUP BY ALL""",
    "cvec": f"""
        SELECT document_id, parent_id, child_id, (c >> 1) % 64 AS slot,
               sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
        FROM (SELECT document_id, parent_id, child_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS c
              FROM (SELECT document_id, parent_id, child_id,
                           unnest({TOK.format('child_content')}) AS t FROM children))
        GROUP BY ALL""",
    "qnorm": "SELECT query_id, sqrt(sum(v * v)) AS qn FROM qvec GROUP BY query_id",
    "cnorm": "SELECT document_id, parent_id, child_id, sqrt(sum(v * v)) AS cn FROM cvec GROUP BY ALL",
    "vec_pairs": """
        SELECT query_id, document_id, parent_id, child_id, sum(qvec.v * cvec.v) AS dp
        FROM qvec JOIN cvec USING (slot) GROUP BY ALL""",
    "vec_all": """
        SELECT q.query_id, c.document_id, c.parent_id, c.child_id,
               coalesce(round(dp / nullif(qn * cn, 0), 6), 0.0) AS score
        FROM questions q CROSS JOIN children c
        LEFT JOIN vec_pairs USING (query_id, document_id, parent_id, child_id)
        LEFT JOIN qnorm USING (query_id)
        LEFT JOIN cnorm USING (document_id, parent_id, child_id)""",
    "vec_ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id
                     ORDER BY score DESC, document_id, parent_id, child_id) AS rank FROM vec_all""",
    # ---- the 15 best children, best child per parent
    "vec_hits": """
        SELECT query_id, document_id, parent_id, child_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank
        FROM (SELECT *, rank AS r, row_number() OVER (PARTITION BY query_id, document_id, parent_id
                                                       ORDER BY rank) AS n
              FROM vec_ranked WHERE rank <= 15) WHERE n = 1""",
}
_NEEDS = {
    "qt": ["questions"], "ct": ["children"], "ctf": ["ct"], "cdf": ["ctf"], "cstat": ["ct"],
    "bm25_all": ["qt", "ctf", "cdf", "cstat"], "bm25_ranked": ["bm25_all"],
    "qvec": ["questions"], "cvec": ["children"], "qnorm": ["qvec"], "cnorm": ["cvec"],
    "vec_pairs": ["qvec", "cvec"], "vec_all": ["questions", "children", "vec_pairs", "qnorm", "cnorm"],
    "vec_ranked": ["vec_all"], "vec_hits": ["vec_ranked"],
}


def with_parts(*names: str, **extra: str) -> str:
    """``WITH`` clause holding the named parts, what they need, and further ones given here."""
    order: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({PARTS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(ctes) + "\n"
