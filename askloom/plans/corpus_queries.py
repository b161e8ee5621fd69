"""Cleaning, page filters, chunking, de-duplication and embedding bookkeeping on the corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import folds
from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators import chunking as C
from askloom.operators import dedup as D
from askloom.operators import embedding as E
from askloom.operators import pages as P
from askloom.operators import similar as SIM
from askloom.plans import inputs as I
from askloom.plans.registry import query
from askloom.sources import tables as S


def re2(p: str) -> str:
    """A fixed pattern in the spelling of the checking engine."""
    p = p.replace(r"(?U)", "").replace(r"[^\w\u4e00-\u9fff]", r"[^\p{L}\p{M}\p{N}_]")
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p).replace("'", "''")


def alt(ps) -> str:
    return "|".join(f"(?:{re2(p)})" for p in ps)


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip_(x: str) -> str:
    return _STRIP.format(x)


def _drop(x: str, cond: str) -> str:
    kept = f"list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, '\\S') OR NOT ({cond}))"
    return f"array_to_string(list_transform({kept}, lambda l: CASE WHEN regexp_matches(l, '\\S') THEN l ELSE '' END), chr(10))"


def coarse_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[\\x{{3000}}\\x{{feff}}\\x{{a0}}\\x{{2000}}-\\x{{200f}}\\x{{2028}}-\\x{{202f}}\\x{{205f}}\\x{{2060}}\\x{{ad}}\\x{{2061}}-\\x{{2064}}\\x{{2066}}-\\x{{206f}}]', ' ', 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '(?m)^[ \\t]+|[ \\t]+$', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{4,}}', repeat(chr(10), 3), 'g')"
    s = strip_("l")
    t = _drop(t, f"regexp_matches({s}, '{re2(K.DECORATIVE_LINE)}') OR (regexp_matches({s}, '{re2(K.PURE_SYMBOL_LINE)}') AND length({s}) < 80)")
    t = _drop(t, f"regexp_matches({s}, '{alt(K.PAGE_NUMBER_PATTERNS)}')")
    for p in K.BOILERPLATE_PATTERNS:
        t = f"regexp_replace({t}, '{re2(p)}', '', 'g')"
    t = f"regexp_replace({t}, '{K.REVISION_MARKS}', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{4,}}', repeat(chr(10), 2), 'g')"
    return f"CASE WHEN regexp_matches({x}, '\\S') THEN {strip_(t)} ELSE '' END"


_CLEAN = f"cleaned AS (SELECT doc_id, text, {coarse_sql('text')} AS c FROM documents)"
_NB = lambda x: f"list_filter(list_transform({x}, lambda z: {strip_('z')}), lambda z: length(z) > 0)"
_PARS = lambda x: _NB(f"string_split(regexp_replace({x}, '\\n\\s*\\n', chr(1), 'g'), chr(1))")
_HEAD = lambda l: f"(length({strip_(l)}) BETWEEN 1 AND 80 AND regexp_matches({strip_(l)}, '{alt(K.HEADING_PATTERNS)}'))"
_CLAUSE = lambda l: f"regexp_matches({strip_(l)}, '{alt(K.CLAUSE_PATTERNS)}')"
_ITEM = lambda l: f"regexp_matches({strip_(l)}, '{alt(K.LIST_PATTERNS)}')"


def _segments(lines: str, cond, tidy: bool = True) -> str:
    t = f"list_transform({lines}, lambda q: CASE WHEN regexp_matches(q, '\\S') THEN q ELSE '' END)" if tidy else lines
    st = f"list_distinct(list_concat([0], list_filter(range(0, len({lines})), lambda i: {cond(f'{lines}[i + 1]')})))"
    st = f"list_sort({st})"
    return _NB(f"list_transform({st}, lambda s, j: array_to_string({t}[s + 1 : coalesce(({st})[j + 1], len({lines}))], chr(10)))")


def _pack(units: str, limit: int, sep: str = "chr(10) || chr(10)") -> str:
    """Greedy packing as a list fold; the state is (finished blocks, open block)."""
    elems = f"list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'buf': [u]}})"
    size = lambda b: f"coalesce(list_sum(list_transform({b}, lambda w: length(w))), 0)"
    fold = (
        f"list_reduce({elems}, lambda a, b: CASE WHEN {size('a.buf')} + length(b.buf[1]) > {limit} "
        f"THEN {{'done': list_append(a.done, array_to_string(a.buf, {sep})), 'buf': b.buf}} "
        f"ELSE {{'done': a.done, 'buf': list_concat(a.buf, b.buf)}} END)"
    )
    return (f"CASE WHEN len({units}) = 0 THEN []::VARCHAR[] ELSE "
            f"list_append(({fold}).done, array_to_string(({fold}).buf, {sep})) END")


def docs(spark, d):
    return I.documents(spark, d).withColumn("document_id", F.col("doc_id"))


def long(c):
    return c.cast("bigint")


# ------------------------------------------------------------------------------ cleaning
@query("coarse_clean", f"WITH {_CLEAN} SELECT doc_id, md5(c) AS content_key, length(c) AS chars FROM cleaned")
def _(spark, d):
    c = X.coarse_clean(F.col("text"))
    return I.documents(spark, d).select("doc_id", c.alias("c")).select(
        "doc_id", F.md5("c").alias("content_key"), long(F.length("c")).alias("chars")
    )


@query("page_number_lines", f"""
WITH c AS (SELECT doc_id, text, {_drop('text', f"regexp_matches({strip_('l')}, '{alt(K.PAGE_NUMBER_PATTERNS)}')")} AS t FROM documents)
SELECT doc_id, md5(t) AS content_key, length(text) - length(t) AS removed_chars FROM c""")
def _(spark, d):
    return I.documents(spark, d).withColumn("t", X.drop_page_number_lines(F.col("text"))).select(
        "doc_id", F.md5("t").alias("content_key"), long(F.length("text") - F.length("t")).alias("removed_chars")
    )


@query("fine_clean_report", f"""
WITH f AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN {strip_(f"regexp_replace(regexp_replace({strip_('text')}, '\\n{{4,}}', repeat(chr(10), 2), 'g'), ' {{2,}}', ' ', 'g')")} END AS t FROM documents)
SELECT doc_id, CASE WHEN t IS NULL THEN 'rejected' ELSE 'accepted' END AS quality, length(t) AS total_chars, md5(t) AS content_key FROM f""")
def _(spark, d):
    t = X.fine_clean(F.col("text"))
    return I.documents(spark, d).select("doc_id", t.alias("t")).select(
        "doc_id", F.when(F.col("t").isNull(), "rejected").otherwise("accepted").alias("quality"),
        long(F.length("t")).alias("total_chars"), F.md5("t").alias("content_key"),
    )


@query("child_light_check", f"""
SELECT source, count(*) AS children, count(*) FILTER (WHERE regexp_matches(l, '\\S')) AS valid,
       sum(length({strip_('l')}))::BIGINT AS chars
FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY source""")
def _(spark, d):
    return I.lines(spark, d).groupBy("source").agg(
        F.count("*").alias("children"), F.count_if(~X.is_blank(F.col("line"))).alias("valid"),
        F.sum(F.length(X.strip(F.col("line")))).alias("chars"),
    )


@query("full_clean_status", f"""
WITH {_CLEAN}, s AS (SELECT CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' WHEN length(c) < 10 THEN 'rejected_too_short' ELSE 'completed' END AS coarse,
  CASE WHEN regexp_matches(text, '\\S') AND length(c) >= 10 THEN 'accepted' ELSE 'skipped' END AS fine FROM cleaned)
SELECT coarse, fine, count(*) AS documents FROM s GROUP BY ALL""")
def _(spark, d):
    return full_clean(I.documents(spark, d)).groupBy("coarse", "fine").agg(F.count("*").alias("documents"))


def full_clean(df):
    """Clean text (null when rejected) and the status of each stage."""
    c = df.withColumn("_c", X.coarse_clean(F.col("text")))
    blank, short = X.is_blank(F.col("text")), F.length("_c") < K.MIN_CLEAN_CHARS
    return c.select(
        *df.columns,
        F.when(~blank & ~short, X.fine_clean(F.col("_c"))).alias("clean_text"),
        F.when(blank, "empty").when(short, "rejected_too_short").otherwise("completed").alias("coarse"),
        F.when(blank | short, "skipped").otherwise("accepted").alias("fine"),
    )


_QUALITY_SQL = r"""
WITH m AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[0-9]')) AS digits,
       len(regexp_extract_all(text, '\s')) AS spaces, len(regexp_extract_all(text, '[a-zA-Z]')) AS letters,
       len(regexp_extract_all(text, '[，。！？；：、"（）《》【】—…]')) AS punct,
       len(regexp_extract_all(text, '(?:^|\s)[0-9]+(?:\s|$)')) AS iso, text FROM documents),
s AS (SELECT doc_id, CASE WHEN n < 10 THEN 0.0 WHEN (digits + spaces) / n > 0.7 THEN 0.05
  ELSE least(1.0, greatest(0.0, punct / n * 0.25 + letters / n * 0.15 - least(0.5, iso * 0.05))) END::DOUBLE AS score FROM m)
"""


@query("text_quality_score", _QUALITY_SQL + "SELECT doc_id, round(score, 6) AS quality_score FROM s")
def _(spark, d):
    return I.documents(spark, d).select("doc_id", F.round(X.quality_score(F.col("text")), 6).alias("quality_score"))


@query("quality_score_by_label", _QUALITY_SQL + """
SELECT quality::BIGINT AS quality, count(*) AS documents, round(avg(score), 6) AS mean_score FROM s JOIN labels USING (doc_id) GROUP BY quality""")
def _(spark, d):
    scored = I.documents(spark, d).select("doc_id", X.quality_score(F.col("text")).alias("s"))
    return scored.join(I.table(spark, d, "labels"), "doc_id").groupBy(long(F.col("quality")).alias("quality")).agg(
        F.count("*").alias("documents"), F.round(F.avg("s"), 6).alias("mean_score")
    )


@query("language_detection", f"""
WITH t AS (SELECT doc_id, lang, unnest({I.TOK.format('text')}) AS term FROM documents),
prof AS (SELECT term, lang, n / sum(n) OVER (PARTITION BY lang) AS weight FROM (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN documents USING (doc_id) WHERE length({strip_('text')}) >= 10 GROUP BY ALL),
sc AS (SELECT doc_id, lang, round(sum(tf * weight), 6) AS s FROM tf JOIN prof USING (term) GROUP BY ALL),
best AS (SELECT doc_id, lang AS detected FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
SELECT d.doc_id, coalesce(detected, 'unknown') AS detected, coalesce(detected, 'unknown') = lang AS agrees FROM documents d LEFT JOIN best USING (doc_id)""")
def _(spark, d):
    x = I.documents(spark, d)
    found = P.detect_language(x, P.language_profiles(x))
    return found.join(x.select("doc_id", "lang"), "doc_id").select(
        "doc_id", "detected", (F.col("detected") == F.col("lang")).alias("agrees")
    )


# ------------------------------------------------------------------------------ pages (one line = one page)
def page_table(spark, d):
    return I.lines(spark, d).select("doc_id", F.col("line_no").alias("page_no"), F.col("line").alias("text"))


_PAGE = f"""pg AS (SELECT doc_id, i - 1 AS page_no, ls[i] AS text, {strip_('ls[i]')} AS s, len(ls) AS total FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i))"""


def _kw(words) -> str:
    return "(" + " OR ".join(f"contains(lower(s), '{w.lower()}')" for w in words) + ")"


_TOCLIKE = r"len(list_filter(list_transform(string_split(s, chr(10)), lambda z: trim(z)), lambda z: regexp_matches(z, '[.·•]{3,}|\.{2,}\s*\d+$|^.{2,30}\s+\d{1,4}$'))) >= 3"
_REFLIKE = r"len(list_filter(list_transform(string_split(s, chr(10)), lambda z: trim(z)), lambda z: regexp_matches(z, '^\[\d+\]') OR (regexp_matches(z, '^\d+\.\s') AND length(z) > 20))) >= 3"


@query("page_classes", f"""
WITH {_PAGE}, k AS (SELECT *, CASE WHEN length(s) < 20 THEN 'blank'
  WHEN page_no < greatest(5.0, total * 0.1) AND ({' + '.join(f"contains(lower(s), '{w.lower()}')::INT" for w in K.COVER_KEYWORDS)}) >= CASE WHEN length(s) < 200 THEN 1 ELSE 2 END THEN 'cover'
  WHEN {_kw(K.TOC_KEYWORDS)} THEN 'toc' WHEN {_kw(K.REFERENCE_KEYWORDS)} THEN 'references'
  WHEN {_kw(K.APPENDIX_KEYWORDS)} AND length(s) < 300 THEN 'appendix' END AS kind,
  {_kw(K.REFERENCE_KEYWORDS)} AS ref, {_kw(K.APPENDIX_KEYWORDS)} AS app, {_TOCLIKE} AS tl, {_REFLIKE} AS rl FROM pg),
r AS (SELECT *, max(page_no) FILTER (kind = 'toc') OVER w AS mt, max(page_no) FILTER (ref OR app OR (length(s) > 100 AND NOT tl)) OVER w AS et,
  max(page_no) FILTER (kind = 'references') OVER w AS mr, max(page_no) FILTER (app OR (length(s) > 50 AND NOT rl)) OVER w AS er,
  max(page_no) FILTER (kind = 'appendix') OVER w AS ma, max(page_no) FILTER (ref OR (length(s) > 500 AND NOT app)) OVER w AS ea
  FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_no))
SELECT doc_id, CASE WHEN kind IN ('blank', 'cover') THEN kind WHEN mt IS NOT NULL AND coalesce(et <= mt, true) AND page_no - mt <= 14 THEN 'toc'
  WHEN mr IS NOT NULL AND coalesce(er <= mr, true) THEN 'references' WHEN ma IS NOT NULL AND coalesce(ea <= ma, true) THEN 'appendix' ELSE 'body' END AS page_class,
  count(*) AS pages FROM r GROUP BY ALL""")
def _(spark, d):
    return P.classify_pages(page_table(spark, d)).groupBy(
        "doc_id", F.coalesce("page_class", F.lit("body")).alias("page_class")
    ).agg(F.count("*").alias("pages"))


@query("page_text_shape", f"""
SELECT doc_id, {_TOCLIKE} AS toc_like, {_REFLIKE} AS reference_like FROM (SELECT doc_id, {strip_('text')} AS s FROM documents)""")
def _(spark, d):
    t = F.col("text")
    return I.documents(spark, d).select(
        "doc_id", X.looks_like_toc(t).alias("toc_like"), X.looks_like_references(t).alias("reference_like")
    )


def _any(words, t="x.t"):
    return "(" + " OR ".join(f"contains(lower({t}), '{w.lower()}')" for w in words) + ")"


def _section(toc, ref, app, keep=False):
    n, last = ("acc.n + 1", "x.i") if keep else ("acc.n", "acc.last")
    return f"{{'i': 0::BIGINT, 't': '', 'toc': {toc}, 'ref': {ref}, 'app': {app}, 'n': {n}, 'last': {last}}}"


# Every eleventh paragraph and its neighbours begin with the heading of a section that is not text.
_HEADED = {1: "CONTENTS", 4: "References", 6: "Appendix", 9: "Copyright"}


@query("paragraph_state_filter", f"""
WITH p AS (SELECT doc_id, i - 1 AS i, CASE (doc_id + i - 1) % 11 {" ".join(f"WHEN {k} THEN '{w} '" for k, w in _HEADED.items())} ELSE '' END || ls[i] AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
l AS (SELECT doc_id, list_prepend({{'i': -1::BIGINT, 't': '', 'toc': false, 'ref': false, 'app': false, 'n': 0::BIGINT, 'last': -1::BIGINT}},
  list({{'i': i, 't': regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 'toc': false, 'ref': false, 'app': false, 'n': 0::BIGINT, 'last': -1::BIGINT}} ORDER BY i)) AS f FROM p GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(f, lambda acc, x: CASE
  WHEN length(x.t) = 0 OR (x.i < 20 AND {_any(K.COVER_KEYWORDS)} AND length(x.t) < 100) THEN acc
  WHEN {_any(K.TOC_KEYWORDS)} THEN {_section("true", "acc.ref", "acc.app")}
  WHEN acc.toc AND length(x.t) < 80 THEN acc
  WHEN {_any(K.REFERENCE_KEYWORDS)} THEN {_section("false", "true", "acc.app")}
  WHEN {_any(K.APPENDIX_KEYWORDS)} AND length(x.t) < 300 THEN {_section("false", "false", "true")}
  WHEN acc.app AND NOT (length(x.t) > 500 AND NOT {_any(K.APPENDIX_KEYWORDS)}) THEN {_section("false", "false", "true")}
  WHEN {_any(K.COPYRIGHT_KEYWORDS)} AND length(x.t) < 200 THEN {_section("false", "false", "false")}
  ELSE {_section("false", "false", "false", True)} END) AS s FROM l)
SELECT doc_id, s.n AS kept, s.last AS last_kept FROM r""")
def _(spark, d):
    """Lines as paragraphs under headings of contents, references, appendix and notice."""
    head = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in _HEADED.items() for x in (k, f"{w} ")]), ((F.col("doc_id") + i) % 11).cast("int")), F.lit(""))
    paras = I.documents(spark, d).select("doc_id", F.transform(F.split("text", "\n"), lambda t, i: F.concat(head(i), t)).alias("paragraphs"))
    return P.paragraph_fold(paras).select(
        "doc_id", long(F.size("keep")).alias("kept"),
        F.coalesce(F.array_max("keep"), F.lit(-1).cast("bigint")).alias("last_kept"),
    )


_QS = r"""CASE WHEN n < 10 THEN 0.0 WHEN (len(regexp_extract_all(s, '[0-9]')) + len(regexp_extract_all(s, '\s'))) / n > 0.7 THEN 0.05
  ELSE least(1.0, greatest(0.0, len(regexp_extract_all(s, '[，。！？；：、"（）《》【】—…]')) / n * 0.25 + len(regexp_extract_all(s, '[a-zA-Z]')) / n * 0.15
       - least(0.5, len(regexp_extract_all(s, '(?:^|\s)[0-9]+(?:\s|$)')) * 0.05))) END"""


@query("document_route", f"""
WITH {_PAGE}, f AS (SELECT *, length(s) AS n FROM pg),
q AS (SELECT doc_id, n > 100 AND {_QS} >= 0.15 AS ed, n < 10 OR {_QS} < 0.08 AS sc FROM f),
a AS (SELECT doc_id, avg(ed::INT) AS e, avg((NOT ed AND sc)::INT) AS s FROM q GROUP BY doc_id)
SELECT doc_id, round(e, 6) AS editable_ratio, round(s, 6) AS scanned_ratio,
  CASE WHEN s >= 0.8 THEN 'scanned' WHEN s >= 0.3 OR (e < 0.5 AND s > 0) THEN 'mixed' ELSE 'editable' END AS route FROM a""")
def _(spark, d):
    return P.document_route(page_table(spark, d)).select(
        "doc_id", F.round("editable_ratio", 6).alias("editable_ratio"),
        F.round("scanned_ratio", 6).alias("scanned_ratio"), "route",
    )


@query("extraction_choice", f"""
WITH c AS (SELECT doc_id, 0 AS p, regexp_replace(text, '[a-z]', '7', 'g') AS t FROM documents UNION ALL SELECT doc_id, 1, text FROM documents
           UNION ALL SELECT doc_id, 2, text || ' ' || text FROM documents),
g AS (SELECT *, length({strip_('t')}) > 50 AND {_QS.replace('(s,', '(t,').replace(' n ', ' length(t) ').replace('/ n', '/ length(t)')} >= 0.15 AS good FROM c)
SELECT doc_id, md5(coalesce(arg_min(t, p) FILTER (good), arg_max(t, length(t) * 10 - p))) AS content_key FROM g GROUP BY doc_id""")
def _(spark, d):
    t = F.col("text")
    low = "abcdefghijklmnopqrstuvwxyz"
    forms = I.documents(spark, d).select("doc_id", "text", F.translate(t, low, "7" * len(low)).alias("digits"), F.concat(t, F.lit(" "), t).alias("twice"))
    return forms.select("doc_id", F.md5(P.pick_extraction([F.col("digits"), t, F.col("twice")])).alias("content_key"))


@query("recognition_confidence", """
WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
p AS (SELECT doc_id, line_no // 4 AS page_no, avg(0.5 + (length(line) % 50) / 100.0::DOUBLE) AS c, string_agg(line, chr(10) ORDER BY line_no) AS t FROM l GROUP BY ALL)
SELECT doc_id, page_no, round(c, 6) AS confidence, CASE WHEN round(c, 9) < 0.6 THEN 'rejected' WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) >= 30 THEN 'kept' ELSE 'too short' END AS verdict FROM p""")
def _(spark, d):
    # line length stands in for a stored recognition confidence
    stored = I.lines(spark, d).select(
        "doc_id", long(F.floor(F.col("line_no") / 4)).alias("page_no"), "line_no", F.col("line").alias("text"),
        (0.5 + (F.length("line") % 50) / 100.0).alias("confidence"),
    )
    return P.recognized_pages(stored).select("doc_id", "page_no", F.round("confidence", 6).alias("confidence"), "verdict")


@query("page_batches", """
WITH l AS (SELECT doc_id, i - 1 AS n, ls[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i) WHERE regexp_matches(ls[i], '\\S'))
SELECT doc_id, (r - 1) // 5 AS batch_no, md5(string_agg(t, chr(10) || chr(10) ORDER BY n)) AS content_key
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM l) GROUP BY ALL""")
def _(spark, d):
    return S.page_batches(page_table(spark, d)).select("doc_id", "batch_no", F.md5("text").alias("content_key"))


# ------------------------------------------------------------------------------ line classes
@query("line_classes", f"""
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {_HEAD('l')}) AS headings, count(*) FILTER (WHERE {_CLAUSE('l')}) AS clause_starts,
       count(*) FILTER (WHERE {_ITEM('l')}) AS list_items FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def _(spark, d):
    l = F.col("line")
    return I.lines(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(X.is_heading(l)).alias("headings"),
        F.count_if(X.is_clause_start(l)).alias("clause_starts"), F.count_if(X.is_list_item(l)).alias("list_items"),
    )


@query("heading_levels", f"""
SELECT lvl::BIGINT AS level, count(*) AS lines FROM (SELECT CASE WHEN length({strip_('l')}) = 0 OR length({strip_('l')}) > 80 THEN 0
  {' '.join(f"WHEN regexp_matches({strip_('l')}, '{re2(p)}') THEN {min(i + 1, 3)}" for i, p in enumerate(K.HEADING_PATTERNS))} ELSE 0 END AS lvl
  FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1""")
def _(spark, d):
    return I.lines(spark, d).groupBy(long(X.heading_level(F.col("line"))).alias("level")).agg(F.count("*").alias("lines"))


# Markdown-like view of the corpus: a heading line is put before every fifth line of a text, so that
# heading blocks, clauses and packing meet real structure.
def structured(df):
    marked = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(i % 5 == 2, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), l))
        .when(i % 7 == 3, F.concat(F.lit("("), (i % 9 + 1).cast("string"), F.lit(") "), l))
        .when(i % 11 == 5, F.concat(l, F.lit("\n")))
        .otherwise(l),
    )
    return df.withColumn("text", F.array_join(marked, "\n"))


_STRUCT = """st AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN (i - 1) % 5 = 2 THEN '## Part ' || (i - 1) || chr(10) || l
   WHEN (i - 1) % 7 = 3 THEN '(' || ((i - 1) % 9 + 1) || ') ' || l WHEN (i - 1) % 11 = 5 THEN l || chr(10) ELSE l END), chr(10)) AS text FROM documents)"""
_LINES = "ln AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM st)"


def _rows(sql_list: str, out: str, src: str = "ln") -> str:
    return f"SELECT doc_id, i - 1 AS {out}, md5(a[i]) AS content_key, length(a[i]) AS chars FROM (SELECT doc_id, {sql_list} AS a FROM {src}), unnest(range(1, len(a) + 1)) u(i)"


def _exploded(df, arr, name):
    return df.select("doc_id", F.posexplode(arr).alias(name, "t")).select(
        "doc_id", long(F.col(name)).alias(name), F.md5("t").alias("content_key"), long(F.length("t")).alias("chars")
    )


_HB = f"""hb AS (SELECT doc_id, {_segments('ls', _HEAD, tidy=False)} AS bl FROM ln)"""
_BLOCKS = f"flatten(list_transform(bl, lambda b: CASE WHEN length(b) > 3000 THEN {_pack(_PARS('b'), 1500)} ELSE [b] END))"


@query("heading_blocks", f"WITH {_STRUCT}, {_LINES}, {_HB} " + _rows(_BLOCKS, "block_no", "hb"))
def _(spark, d):
    return _exploded(structured(docs(spark, d)), C.heading_blocks(F.col("text")), "block_no")


@query("clause_segments", f"WITH {_STRUCT}, {_LINES} " + _rows(_segments("ls", _CLAUSE), "clause_no"))
def _(spark, d):
    return _exploded(structured(docs(spark, d)), C.clauses(F.col("text")), "clause_no")


@query("pack_clauses", f"WITH {_STRUCT}, {_LINES}, cl AS (SELECT doc_id, {_segments('ls', _CLAUSE)} AS u FROM ln) " + _rows(_pack("u", 1500), "parent_no", "cl"))
def _(spark, d):
    return _exploded(structured(docs(spark, d)), C.pack_clauses(F.col("text")), "parent_no")


@query("pack_paragraphs", f"WITH {_STRUCT}, {_LINES}, pr AS (SELECT doc_id, {_PARS('text')} AS u FROM ln) " + _rows(_pack("u", 1500), "parent_no", "pr"))
def _(spark, d):
    return _exploded(structured(docs(spark, d)), C.pack_paragraphs(F.col("text")), "parent_no")


@query("oversized_blocks", f"WITH {_STRUCT}, {_LINES}, pr AS (SELECT doc_id, {_PARS('text')} AS u, text FROM ln) " + _rows("CASE WHEN length(text) > 3000 THEN " + _pack("u", 1500) + " ELSE [text] END", "part_no", "pr"))
def _(spark, d):
    big = F.length("text") > 2 * K.PARENT_CHARS
    return _exploded(structured(docs(spark, d)), F.when(big, C.pack_paragraphs(F.col("text"))).otherwise(F.array("text")), "part_no")


_TINY = """list_reduce(list_transform(bl, lambda u: {'done': []::VARCHAR[], 'buf': [u]}), lambda a, b:
  CASE WHEN length(b.buf[1]) < 100 AND coalesce(list_sum(list_transform(a.buf, lambda w: length(w))), 0) + length(b.buf[1]) < 1500
       THEN {'done': a.done, 'buf': list_concat(a.buf, b.buf)}
       WHEN length(b.buf[1]) < 100 THEN {'done': list_append(a.done, array_to_string(a.buf, chr(10) || chr(10))), 'buf': b.buf}
       ELSE {'done': list_append(CASE WHEN len(a.buf) > 0 THEN list_append(a.done, array_to_string(a.buf, chr(10) || chr(10))) ELSE a.done END, b.buf[1]), 'buf': []::VARCHAR[]} END,
  {'done': []::VARCHAR[], 'buf': []::VARCHAR[]})"""
_MERGED = f"CASE WHEN len(bl) <= 1 THEN bl WHEN len(({_TINY}).buf) > 0 THEN list_append(({_TINY}).done, array_to_string(({_TINY}).buf, chr(10) || chr(10))) ELSE ({_TINY}).done END"


@query("merge_tiny_parents", f"WITH {_STRUCT}, {_LINES}, {_HB} " + _rows(_MERGED, "parent_no", "hb"))
def _(spark, d):
    x = structured(docs(spark, d))
    lines = F.split("text", "\n")
    raw = C.segments(lines, lambda l: X.is_heading(l))
    return _exploded(x.withColumn("bl", raw), folds.merge_tiny(F.col("bl")), "parent_no")


_SENT = _NB("string_split(regexp_replace(text, '([。！？])\\s*', '\\1' || chr(1), 'g'), chr(1))")


@query("sentence_split", f"""
WITH z AS (SELECT doc_id, replace(replace(text, '. ', '。'), ', ', '，') AS text FROM documents), f AS (SELECT doc_id, {_SENT} AS s FROM z),
g AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 800 THEN {_NB("string_split(regexp_replace(x, '([，；：])', '\\1' || chr(1), 'g'), chr(1))")} ELSE [x] END)) AS a FROM f)
SELECT doc_id, i - 1 AS sentence_no, md5(a[i]) AS content_key, length(a[i]) AS chars FROM g, unnest(range(1, len(a) + 1)) u(i)""")
def _(spark, d):
    cjk = F.replace(F.replace("text", F.lit(". "), F.lit("。")), F.lit(", "), F.lit("，"))
    return _exploded(docs(spark, d).withColumn("text", cjk), C.sentences(F.col("text")), "sentence_no")


_CHILD = f"""ch AS (SELECT doc_id, text, {_segments('ls', _CLAUSE)} AS cl, {_segments('ls', lambda l: f"({_ITEM(l)} OR {_HEAD(l)})")} AS it, {_PARS('text')} AS pr FROM ln)"""
_KIDS = "CASE WHEN NOT regexp_matches(text, '\\S') THEN []::VARCHAR[] WHEN len(cl) >= 2 THEN cl WHEN len(it) >= 2 THEN it WHEN len(pr) >= 2 THEN pr WHEN length(text) > 800 THEN [" + strip_("text") + "] ELSE [text] END"


@query("split_children", f"WITH {_STRUCT}, {_LINES}, {_CHILD} " + _rows(_KIDS, "child_no", "ch"))
def _(spark, d):
    return _exploded(structured(docs(spark, d)), C.split_children(F.col("text")), "child_no")


@query("chunk_documents")
def _(spark, d):
    clean = structured(docs(spark, d)).withColumn("text", X.coarse_clean(F.col("text")))
    return C.chunk_documents(clean).select(
        "document_id", "parent_id", "child_id", long(F.length("child_content")).alias("chars"),
        F.md5("child_content").alias("content_key"),
    )


_PLAIN = "ln AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)"


@query("chunk_quality", f"""
WITH {_STRUCT}, {_LINES}, {_CHILD}, k AS (SELECT doc_id, text, {_KIDS} AS kids FROM ch),
c AS (SELECT doc_id, length(text) AS pl, length(trim(kids[i])) AS n FROM k, unnest(range(1, len(kids) + 1)) u(i)),
a AS (SELECT doc_id, count(*) AS total_children, 1::BIGINT AS total_parents, round(avg(n) + 1e-9, 1) AS avg_child_size, round(max(pl), 1)::DOUBLE AS avg_parent_size,
  count(*) FILTER (WHERE n < 10) AS too_short, count(*) FILTER (WHERE n > 800) AS too_long FROM c GROUP BY doc_id)
SELECT *, CASE WHEN too_short > total_children * 0.3 OR too_long > total_children * 0.1 THEN 'poor' WHEN too_short > total_children * 0.1 THEN 'fair' ELSE 'good' END AS quality FROM a""")
def _(spark, d):
    x = structured(docs(spark, d)).select(
        "document_id", F.lit("p0").alias("parent_id"), F.col("text").alias("parent_content"),
        F.explode(C.split_children(F.col("text"))).alias("child_content"),
    )
    return C.chunk_quality(x).withColumnRenamed("document_id", "doc_id")


@query("distinct_parents", """
SELECT doc_id AS document_id, 'p0' AS parent_id, md5(text) AS content_key FROM documents WHERE regexp_matches(text, '\\S')""")
def _(spark, d):
    keyed = I.parents(spark, d).select("document_id", "parent_id", F.md5("parent_content").alias("content_key"))
    return C.distinct_parents(I.children(spark, d), keyed)


# ------------------------------------------------------------------------------ file splitting
@query("split_large_text", f"WITH {_STRUCT}, pr AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS u, text FROM st) " + _rows("CASE WHEN length(text) > 4000 THEN " + _pack("u", 1000) + " ELSE [text] END", "part", "pr").replace("i - 1 AS part", "i AS part_no"))
def _(spark, d):
    return C.split_large_text(structured(docs(spark, d)), limit=4000, target=1000).select(
        F.col("document_id").alias("doc_id"), "part_no", F.md5("part").alias("content_key"), long(F.length("part")).alias("chars")
    )


@query("split_by_lines", "WITH pr AS (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents) " + _rows(_pack("u", 2000, "chr(10)"), "part", "pr").replace("i - 1 AS part", "i AS part_no"))
def _(spark, d):
    return C.split_by_lines(docs(spark, d), target=2000).select(
        F.col("document_id").alias("doc_id"), "part_no", F.md5("part").alias("content_key"), long(F.length("part")).alias("chars")
    )


# ------------------------------------------------------------------------------ contents tables
# Contents pages of the corpus: every document lists its lines as numbered entries.
def toc_lines(spark, d):
    l = I.lines(spark, d)
    head = F.regexp_replace("line", "[^a-zA-Z ]", "")
    entry = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("Part "), F.col("line_no").cast("string"))).otherwise(
        F.concat((F.col("line_no") % 99 + 1).cast("string"), F.lit(" "), head, F.lit(" ... "), (F.col("line_no") * 2 + 1).cast("string"))
    )
    return l.select("doc_id", "line_no", entry.alias("line"))


_TOC = r"""
l AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(ls[i], '[^a-zA-Z ]', '', 'g') AS h FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
t AS (SELECT doc_id, line_no, trim(CASE WHEN line_no % 4 = 0 THEN 'Part ' || line_no ELSE (line_no % 99 + 1) || ' ' || h || ' ... ' || (line_no * 2 + 1) END) AS s FROM l),
e AS (SELECT *, regexp_matches(s, '^(\d{1,2})[\.、]?\s+(.+)\s+(\d{1,3})$') AS m FROM t WHERE length(s) > 0),
c AS (SELECT *, last_value(CASE WHEN NOT m AND NOT regexp_matches(s, '^\d') AND length(s) < 20 THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS cat FROM e),
toc AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS entry_no,
  regexp_extract(s, '^(\d{1,2})[\.、]?\s+(.+)\s+(\d{1,3})$', 1)::BIGINT AS number,
  trim(regexp_replace(trim(regexp_extract(s, '^(\d{1,2})[\.、]?\s+(.+)\s+(\d{1,3})$', 2)), '[\s\.…\-—]+$', '')) AS title,
  regexp_extract(s, '^(\d{1,2})[\.、]?\s+(.+)\s+(\d{1,3})$', 3)::BIGINT AS page_in_toc, coalesce(cat, '') AS category FROM c WHERE m),
pg AS (SELECT doc_id, i - 1 AS page_no, ls[i] AS text, len(ls) AS total FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
tot AS (SELECT doc_id, max(total) AS total_pages FROM pg GROUP BY doc_id),
b0 AS (SELECT toc.*, total_pages, greatest(0, least(page_in_toc - 1, total_pages - 1)) AS start_page, lead(page_in_toc) OVER (PARTITION BY doc_id ORDER BY entry_no) AS nx FROM toc JOIN tot USING (doc_id)),
bounds AS (SELECT * EXCLUDE (nx), greatest(start_page, least(coalesce(nx - 2, total_pages - 1), total_pages - 1)) AS end_page FROM b0),
est AS (SELECT b.doc_id, entry_no, sum(length(text)) AS a FROM bounds b JOIN pg p ON p.doc_id = b.doc_id AND p.page_no BETWEEN start_page AND end_page GROUP BY ALL),
sec AS (SELECT b.*, coalesce(a, 0)::BIGINT AS chars FROM bounds b LEFT JOIN est USING (doc_id, entry_no))
"""


def _sections(spark, d):
    pages = page_table(spark, d)
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    bounds = C.section_bounds(C.toc_entries(toc_lines(spark, d)), totals)
    return bounds, pages


@query("toc_entries", f"WITH {_TOC} SELECT doc_id, line_no::INTEGER AS line_no, entry_no, number, title, page_in_toc, category FROM toc")
def _(spark, d):
    return C.toc_entries(toc_lines(spark, d))


@query("section_bounds", f"WITH {_TOC} SELECT doc_id, entry_no, start_page, end_page FROM bounds")
def _(spark, d):
    return _sections(spark, d)[0].select("doc_id", "entry_no", "start_page", "end_page")


@query("section_chars", f"WITH {_TOC} SELECT doc_id, entry_no, chars FROM sec")
def _(spark, d):
    return C.section_chars(*_sections(spark, d)).select("doc_id", "entry_no", "chars")


@query("merge_small_sections")
def _(spark, d):
    return C.merge_small_sections(C.section_chars(*_sections(spark, d)))


@query("split_large_sections", f"""WITH {_TOC}, z AS (SELECT doc_id, entry_no, title, start_page, end_page, chars, chars > 1500 AS big, end_page - start_page + 1 AS pages,
  coalesce(nullif(chars / (end_page - start_page + 1), 0), 1000) AS av FROM sec),
y AS (SELECT *, least(20, greatest(1, floor(600 / av)))::BIGINT AS per FROM z), x AS (SELECT *, CASE WHEN big THEN ceil(pages / per) ELSE 1 END::BIGINT AS parts FROM y)
SELECT doc_id, entry_no AS section_no, j + 1 AS part_no, CASE WHEN big THEN title || ' (部分' || (j + 1) || '/' || parts || ')' ELSE title END AS title,
  CASE WHEN big THEN start_page + j * per ELSE start_page END AS start_page, CASE WHEN big THEN least(start_page + (j + 1) * per - 1, end_page) ELSE end_page END AS end_page
FROM x, unnest(range(0, parts)) u(j)""")
def _(spark, d):
    sec = C.section_chars(*_sections(spark, d)).withColumnRenamed("entry_no", "section_no")
    return C.split_large_sections(sec, limit=1500, target=600).select(
        "doc_id", "section_no", "part_no", "title", "start_page", "end_page"
    )


@query("fallback_page_ranges", """
WITH pg AS (SELECT doc_id, i - 1 AS page_no, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
a AS (SELECT doc_id, count(*) AS n, coalesce(nullif(avg(length(text)), 0), 1000) AS av FROM pg GROUP BY doc_id),
b AS (SELECT *, least(20, greatest(1, floor(2000 / av)))::BIGINT AS per FROM a)
SELECT doc_id, j + 1 AS part_no, j * per AS start_page, least((j + 1) * per, n) AS end_page FROM b, unnest(range(0, ceil(n / per)::BIGINT)) u(j)""")
def _(spark, d):
    return C.fallback_ranges(page_table(spark, d), target=2000)


_PARA = """p AS (SELECT doc_id, i - 1 AS n, ls[i] AS t, (i - 1) % 3 = 1 AS h FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
q AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM p),
hs AS (SELECT doc_id, e::BIGINT AS entry_no, arg_min(t, n) AS title, min(n) AS start_page, max(n) AS end_page, sum(length(t))::BIGINT AS chars FROM q WHERE e > 0 GROUP BY ALL)"""


def _para_sections(spark, d):
    paras = I.lines(spark, d).select("doc_id", F.col("line_no").alias("para_no"), F.col("line").alias("text"), (F.col("line_no") % 3 == 1).alias("is_heading"))
    return C.heading_sections(paras)


@query("heading_sections", f"WITH {_PARA} SELECT doc_id, entry_no, md5(title) AS title_key, start_page, end_page, chars FROM hs")
def _(spark, d):
    return _para_sections(spark, d).select("doc_id", "entry_no", F.md5("title").alias("title_key"), "start_page", "end_page", "chars")


@query("pair_small_sections", f"""WITH {_PARA}, a AS (SELECT doc_id, list([{{'e': entry_no, 's': start_page, 'x': end_page, 'c': chars, 'open': true}}] ORDER BY entry_no) AS a FROM hs GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(a, lambda acc, v: CASE WHEN acc[-1].c < 900 AND acc[-1].open THEN list_append(acc[:-2], {{'e': acc[-1].e, 's': acc[-1].s, 'x': v[1].x, 'c': acc[-1].c + v[1].c, 'open': false}}) ELSE list_concat(acc, v) END) AS o FROM a)
SELECT doc_id, u.e AS entry_no, u.s AS start_page, u.x AS end_page, u.c AS chars FROM (SELECT doc_id, unnest(o) AS u FROM f)""")
def _(spark, d):
    return C.pair_small_sections(_para_sections(spark, d), minimum=900).drop("title")


@query("split_large_heading_sections", f"""WITH {_PARA}, z AS (SELECT *, end_page - start_page + 1 AS n, greatest(10, floor(100 / coalesce(nullif(chars / (end_page - start_page + 1), 0), 100)))::BIGINT AS per FROM hs),
y AS (SELECT *, chars > 400 AS cut, ceil(n / per)::BIGINT AS parts FROM z)
SELECT doc_id, entry_no, j + 1 AS part_no, CASE WHEN cut THEN start_page + j * per ELSE start_page END AS start_page,
  CASE WHEN cut THEN least(start_page + (j + 1) * per - 1, end_page) ELSE end_page END AS end_page FROM y, unnest(range(0, CASE WHEN cut THEN parts ELSE 1 END)) u(j)""")
def _(spark, d):
    return C.split_large_heading_sections(_para_sections(spark, d), limit=400, target=100).select(
        "doc_id", "entry_no", "part_no", "start_page", "end_page"
    )


@query("fixed_paragraph_parts", """
SELECT doc_id, part_no, count(*) AS paragraphs FROM (SELECT doc_id, (i - 1) // 5 + 1 AS part_no FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)) GROUP BY ALL""")
def _(spark, d):
    paras = I.lines(spark, d).withColumnRenamed("line_no", "para_no")
    return C.fixed_parts(paras, 5).groupBy("doc_id", "part_no").agg(F.count("*").alias("paragraphs"))


@query("split_file_chunk_order", I.with_parts("children", f="SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS idx FROM documents") + """
SELECT source, document_id, idx AS file_index, 's' || idx || '_p0' AS parent_id, 's' || idx || '_' || child_id AS child_id, md5(child_content) AS content_key
FROM children JOIN f ON doc_id = document_id""")
def _(spark, d):
    """Files of one source chunked apart, lines as chunks: every id carries the file's position in its source."""
    def by_line(files, prefix):
        rows = files.select("document_id", prefix.alias("_p"), F.posexplode(F.split("text", "\n")).alias("n", "child_content"))
        parent = F.concat("_p", F.lit("p0"))
        return rows.where(~X.is_blank(F.col("child_content"))).select(
            "document_id", parent.alias("parent_id"), F.concat(parent, F.lit("_c"), F.col("n").cast("string")).alias("child_id"), "child_content"
        )

    files = I.documents(spark, d).select(F.col("doc_id").alias("document_id"), "source", "text")
    return C.chunk_split_files(files, "source", "document_id", by_line).select(
        "source", "document_id", "file_index", "parent_id", "child_id", F.md5("child_content").alias("content_key")
    )


@query("split_group_backfill", """
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '_part' || doc_id || '.txt' ELSE source || '.txt' END AS filename, CASE WHEN doc_id % 5 = 0 THEN 'set' ELSE '' END AS g FROM documents)
SELECT doc_id, CASE WHEN g = '' AND regexp_matches(filename, '^(.+)_part\\d+') THEN regexp_extract(filename, '^(.+)_part\\d+', 1) ELSE g END AS split_group_id FROM n""")
def _(spark, d):
    x = docs(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_part"), F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise(F.concat("source", F.lit(".txt"))).alias("filename"),
        F.when(F.col("doc_id") % 5 == 0, "set").otherwise("").alias("split_group_id"),
    )
    return C.split_group_from_name(x).select("doc_id", "split_group_id")


# ------------------------------------------------------------------------------ files
@query("file_admission", """
WITH f AS (SELECT page_id, url, length(html) * 20000 AS n, lower(regexp_extract(url, '[^/](\\.[^./]*)$', 1)) AS ext FROM pages
           UNION ALL SELECT doc_id, source || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pdf' ELSE '.exe' END, n_chars * 20000,
                  CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pdf' ELSE '.exe' END FROM documents),
e AS (SELECT *, CASE WHEN n > 104857600 THEN 'file too large' WHEN ext IN ('.xlsx', '.xls', '.csv', '.xlsm', '.xltx', '.xlt') THEN 'spreadsheet not supported'
      WHEN ext NOT IN ('.pdf', '.docx', '.doc', '.txt', '.md') THEN 'format not supported' END AS error FROM f)
SELECT page_id AS file_id, url AS path, ext, error IS NULL AS valid, error, CASE WHEN n > 52428800 THEN 'split' ELSE 'whole' END AS route FROM e""")
def _(spark, d):
    k = F.col("doc_id") % 5
    ext = F.when(k == 0, ".TXT").when(k == 1, ".md").when(k == 2, ".xlsx").when(k == 3, ".pdf").otherwise(".exe")
    web = I.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), long(F.length("html")).alias("n"))
    own = I.table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("n_chars").alias("n")
    )
    listing = web.unionByName(own).select("file_id", "path", (F.col("n") * 20000).alias("length"))
    return S.admit_files(listing).drop("length")


# ------------------------------------------------------------------------------ de-duplication
@query("exact_duplicates", "SELECT md5(text) AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(spark, d):
    return D.exact_first(I.table(spark, d, "documents"), "text", "doc_id")


_G3 = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substring({0}, i, 3)))"


@query("pairwise_text_similarity", f"""
WITH p AS (SELECT doc_id, {_G3.format('text')} AS g FROM documents), q AS (SELECT doc_id, g, lag(g) OVER (ORDER BY doc_id) AS h FROM p)
SELECT doc_id, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0 ELSE round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) END::DOUBLE AS similarity FROM q WHERE h IS NOT NULL""")
def _(spark, d):
    """Each document against the one before it."""
    return SIM.similarity_to_previous(I.documents(spark, d), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query("near_duplicate_lines", f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
g AS (SELECT doc_id AS query_id, line_no AS rank, {_G3.format('t')} AS g FROM l),
h AS (SELECT * FROM g WHERE len(g) > 0),
kept AS (SELECT query_id, unnest(list_transform(k, lambda s: s.rank)) AS rank FROM (SELECT query_id, list_reduce(list([{{'rank': rank, 'g': g}}] ORDER BY rank), lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda k: 100 * least(len(k.g), len(x[1].g)) >= 95 * greatest(len(k.g), len(x[1].g)) AND 195 * len(list_intersect(k.g, x[1].g)) >= 95 * (len(k.g) + len(x[1].g)))) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM h GROUP BY query_id))
SELECT query_id AS doc_id, rank::INTEGER AS line_no FROM kept UNION ALL SELECT query_id, rank::INTEGER FROM g WHERE len(g) = 0""")
def _(spark, d):
    return D.keep_first(I.lines(spark, d).drop("source"), ["doc_id"], "line_no", "line").select("doc_id", "line_no")


@query("corpus_near_duplicates", """
WITH ch AS (SELECT doc_id, string_split(text, '') AS l FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(l) - 1, 1)), lambda i: l[i] || l[i + 1] || l[i + 2]))) AS g FROM ch),
c AS (SELECT min(doc_id) AS doc_id, g, count(*) AS copies, len(g) AS n FROM g WHERE len(g) > 0 GROUP BY g),
m AS (SELECT doc_id, bitstring_agg((hash(t) % 2048)::INT, 0, 2047) AS bits FROM (SELECT doc_id, unnest(g) AS t FROM c) GROUP BY doc_id),
w AS (SELECT c.*, bits FROM c JOIN m USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.g, b.g)) AS i, a.n + b.n AS s
      FROM w a JOIN w b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 95 * greatest(a.n, b.n)
       AND 195 * bit_count(xor(a.bits, b.bits)) <= 5 * (a.n + b.n)),  -- bits that differ are elements that differ
l AS (SELECT a, b, i / (s - i) AS j FROM p WHERE 100 * i >= 95 * (s - i)),
d AS (SELECT a AS id, b AS other, j FROM l UNION ALL SELECT b, a, j FROM l),
t AS (SELECT id, count(*) AS links, max(j) AS similarity FROM d GROUP BY id)
SELECT doc_id, copies, coalesce(links, 0) AS links, (SELECT min(other) FROM d WHERE d.id = c.doc_id AND j = similarity) AS nearest, round(similarity, 9) AS similarity
FROM c LEFT JOIN t ON t.id = c.doc_id""")
def _(spark, d):
    """Every distinct document of the corpus with the number of others at 0.95 and more, and the likest."""
    found = SIM.similar_texts(I.documents(spark, d), "doc_id", "text")
    return found.withColumn("similarity", F.round("similarity", 9))


# ------------------------------------------------------------------------------ embedding bookkeeping
def _cache(spark, d):
    """Stored vectors: model m1 has the documents of ``embeddings``, model m2 those of ``labels``."""
    x = I.documents(spark, d).select("doc_id", F.md5("text").alias("content_key"))
    of = lambda name, key, model: x.join(
        I.table(spark, d, name).select(F.col(key).alias("doc_id")), "doc_id", "left_semi"
    ).select(F.lit(model).alias("model"), F.lit(64).alias("dim"), "content_key")
    return of("embeddings", "vec_id", "m1").unionByName(of("labels", "doc_id", "m2")).distinct()


@query("embedding_backlog", """
SELECT md5(text) AS content_key, any_value(length(text)) AS chars FROM documents WHERE regexp_matches(text, '\\S')
GROUP BY text HAVING md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))""")
def _(spark, d):
    return E.backlog(I.documents(spark, d), _cache(spark, d), "m1", 64).select("content_key", long(F.length("text")).alias("chars"))


@query("embedding_attach", """
SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\\S') THEN 0 ELSE len(embedding) END AS dim, round(embedding[1]::DOUBLE, 6) AS first_value
FROM documents d LEFT JOIN (SELECT vec_id, embedding FROM embeddings) e ON vec_id = (SELECT min(x.doc_id) FROM documents x WHERE x.text = d.text)""")
def _(spark, d):
    x = I.documents(spark, d)
    first = D.exact_first(x, "text", "doc_id").withColumnRenamed("doc_id", "vec_id")
    cache = first.join(I.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return E.attach(x, cache).select(
        "doc_id", F.when(F.col("embedding").isNotNull(), long(F.size("embedding"))).alias("dim"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"),
    )


@query("embedding_checks", """
SELECT coalesce(problem, 'ok') AS problem, count(*) AS rows FROM (SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' END AS problem
 FROM (SELECT CASE vec_id % 4 WHEN 0 THEN embedding WHEN 1 THEN embedding[1:32] WHEN 2 THEN embedding[1:0] END AS embedding FROM embeddings)) GROUP BY 1""")
def _(spark, d):
    """Three of four vectors are spoiled, one kind of damage each."""
    k = F.col("vec_id") % 4
    e = I.table(spark, d, "embeddings").select(
        F.when(k == 0, F.col("embedding")).when(k == 1, F.slice("embedding", 1, 32)).when(k == 2, F.slice("embedding", 1, 0)).alias("embedding")
    )
    return E.check_vectors(e, 64).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("rows"))


@query("embedding_request_batches", """
SELECT md5(text) AS content_key, count(*) AS texts, sum(length(text))::BIGINT AS chars, true AS within_ten FROM documents GROUP BY text""")
def _(spark, d):
    """Requests of at most ten texts; every text is in one, whatever the partitions are."""
    rows = I.documents(spark, d).select(F.md5("text").alias("content_key"), "text")
    asked = E.request_batches(rows).select(F.size("keys").alias("n"), F.explode(F.arrays_zip("keys", "texts")).alias("r"))
    return asked.groupBy(F.col("r.keys").alias("content_key")).agg(
        F.count("*").alias("texts"), F.sum(F.length("r.texts")).alias("chars"), (F.max("n") <= 10).alias("within_ten")
    )


@query("hashed_text_embedding", I.with_parts(
    dv=f"""SELECT doc_id, (c >> 1) % 64 AS slot, sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS c FROM (SELECT doc_id, unnest({I.TOK.format('text')}) AS t FROM documents)) GROUP BY ALL"""
) + "SELECT d.doc_id, coalesce(sum(v), 0)::DOUBLE AS total, coalesce(sum(v * v), 0)::DOUBLE AS squares, coalesce(sum(v * slot), 0)::DOUBLE AS moment FROM documents d LEFT JOIN dv USING (doc_id) GROUP BY d.doc_id")
def _(spark, d):
    e = I.documents(spark, d).select("doc_id", V.hashed_embedding(F.col("text")).alias("e"))
    fold = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select(
        "doc_id", fold(F.col("e")).alias("total"), fold(F.transform("e", lambda x: x * x)).alias("squares"),
        fold(F.transform("e", lambda x, i: x * i)).alias("moment"),
    )


# ------------------------------------------------------------------------------ sinks
def _stored_chunks(spark, d):
    """Documents as chunks with the vectors the given table holds for them."""
    x = docs(spark, d).select(
        "document_id", F.lit("p0").alias("parent_id"), F.lit("p0_c0").alias("child_id"), F.lit(0).alias("child_no"),
        F.col("text").alias("child_content"), F.col("text").alias("parent_content"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("split_group_id"),
    )
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("p0_c0").alias("child_id"), "embedding")
    return x, e


@query("child_vector_rows", """
SELECT 'doc' || doc_id || '_p0_c0' AS id, doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS split_group_id, length(text) AS chars
FROM documents JOIN embeddings ON vec_id = doc_id""")
def _(spark, d):
    good, _ = S.child_rows(*_stored_chunks(spark, d), dim=64)
    return good.select("id", "document_id", "split_group_id", long(F.length("child_content")).alias("chars"))


@query("child_vector_rejects", """
SELECT 'doc' || doc_id || '_p0_c0' AS id, 'no vector' AS reject_reason FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(spark, d):
    return S.child_rows(*_stored_chunks(spark, d), dim=64)[1].select("id", "reject_reason")


@query("parent_rows", """
SELECT doc_id AS document_id, 'p0' AS parent_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS split_group_id, md5(text) AS content_key FROM documents WHERE regexp_matches(text, '\\S')""")
def _(spark, d):
    return S.parent_rows(_stored_chunks(spark, d)[0]).select("document_id", "parent_id", "split_group_id", F.md5("parent_content").alias("content_key"))
