"""Questions, contexts, history, caches and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.functions import vector as V
from askloom.operators import answers as A
from askloom.operators import caches as CA
from askloom.operators import evaluation as E
from askloom.operators import history as H
from askloom.operators import postings as P
from askloom.operators import questions as Q
from askloom.operators import retrieval as R
from askloom.plans import inputs as I
from askloom.plans.registry import query
from askloom.plans.retrieval_queries import SYNONYMS, few, filled, vector_hits
from askloom.sources import tables as S

CK = R.CHILD_KEY


def long(c):
    return c.cast("bigint")


def conversations(spark, d):
    return I.table(spark, d, "conversations")


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ------------------------------------------------------------------------------ questions
_CHAT = f"(len(list_filter({lst(K.CHAT_KEYWORDS)}, lambda w: contains(q, w))) > 0)"


def _points(words, bonus):
    return f"least(1.0::DOUBLE, len(list_filter({lst(words)}, lambda w: contains(q, w))) * 0.3::DOUBLE + CASE WHEN {bonus} THEN 0.2::DOUBLE ELSE 0 END)"


_INTENT = f"""
m AS (SELECT conv_id, turn, text, lower(trim(text)) AS q FROM conversations),
i0 AS (SELECT conv_id, turn, q, {_CHAT} AS chat, {_points(K.FACT_KEYWORDS, 'length(q) < 15')} AS f, {_points(K.PROCESS_KEYWORDS, 'false')} AS r, {_points(K.POLICY_KEYWORDS, 'false')} AS p FROM m),
it AS (SELECT conv_id, turn, q, CASE WHEN chat THEN 'chat' WHEN greatest(f, r, p) < 0.3 THEN 'unknown' WHEN f = greatest(f, r, p) THEN 'fact' WHEN r = greatest(f, r, p) THEN 'process' ELSE 'policy' END AS intent,
  CASE WHEN chat THEN 0.95 WHEN greatest(f, r, p) < 0.3 THEN 0.5 ELSE round(greatest(f, r, p), 2) END::DOUBLE AS confidence FROM i0)
"""


def turns_as_questions(spark, d):
    return conversations(spark, d).withColumnRenamed("text", "question")


@query("intent_classification", f"WITH {_INTENT} SELECT conv_id, turn, intent, confidence FROM it")
def _(spark, d):
    return Q.classify(turns_as_questions(spark, d)).select("conv_id", "turn", "intent", "confidence")


@query("chat_detection", f"WITH {_INTENT} SELECT conv_id, turn, chat AS is_chat FROM i0")
def _(spark, d):
    return turns_as_questions(spark, d).select("conv_id", "turn", Q.is_chat(F.col("question")).alias("is_chat"))


@query("intent_strategies", f"""WITH {_INTENT} SELECT intent, count(*) AS questions, any_value(CASE intent WHEN 'chat' THEN 0 WHEN 'fact' THEN 3 WHEN 'process' THEN 8 ELSE 5 END)::BIGINT AS top_k,
 any_value(intent IN ('process', 'policy', 'unknown')) AS use_expansion, any_value(intent IN ('fact', 'policy')) AS require_high_confidence, any_value(intent = 'chat') AS direct_answer FROM it GROUP BY intent""")
def _(spark, d):
    return Q.classify(turns_as_questions(spark, d)).groupBy("intent").agg(
        F.count("*").alias("questions"), F.any_value("strategy_top_k").alias("top_k"), F.any_value("use_expansion").alias("use_expansion"),
        F.any_value("require_high_confidence").alias("require_high_confidence"), F.any_value("direct_answer").alias("direct_answer"),
    )


@query("canned_replies", f"""WITH {_INTENT} SELECT CASE {' '.join(f"WHEN len(list_filter({lst(w)}, lambda w: contains(q, w))) > 0 THEN '{r}'" for w, r in K.CHAT_REPLIES[:-1])} ELSE '{K.CHAT_REPLIES[-1][1]}' END AS reply, count(*) AS questions FROM i0 WHERE chat GROUP BY 1""")
def _(spark, d):
    q = turns_as_questions(spark, d).where(Q.is_chat(F.col("question")))
    return q.groupBy(Q.canned_reply(F.col("question")).alias("reply")).agg(F.count("*").alias("questions"))


# The given questions are not Chinese: a word list of the same shape stands in for the fixed one.
_SYN = {"the": ["and", "thing", "ther"], "que": ["los", "ciones", "las", "never"], "der": ["und", "ein"], "le": ["la", "eau"]}


@query("synonym_expansion", f"""SELECT item_id AS query_id, array_to_string(list_concat([text], {', '.join(f"CASE WHEN contains(text, '{k}') THEN list_filter({lst(w[:3])}, lambda w: NOT contains(text, w)) ELSE []::VARCHAR[] END" for k, w in _SYN.items())}), ' ') AS expanded FROM benchmark""".replace("list_concat([text], ", "flatten([[text], ").replace("END), ' ')", "END]), ' ')"))
def _(spark, d):
    return I.questions(spark, d).select("query_id", Q.expand(F.col("question"), _SYN).alias("expanded"))


@query("model_keyword_list", """SELECT item_id AS query_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[，,、\\n]+'), lambda p: trim(p)), lambda p: length(p) > 0)[1:3], '|') AS keywords FROM benchmark""")
def _(spark, d):
    return I.questions(spark, d).select("query_id", F.array_join(Q.parse_keyword_list(F.col("question")), "|").alias("keywords"))


@query("question_admission", """
WITH u AS (SELECT c_custkey AS user_id, c_acctbal > 0 AS is_active, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS ban_until FROM customer),
a AS (SELECT event_id, user_id, ts AS asked_at, CASE WHEN event_type = 'error' THEN '  ' WHEN event_type = 'signup' THEN repeat(props, 300) ELSE props END AS question FROM events)
SELECT coalesce(CASE WHEN trim(question) = '' THEN 'blank' WHEN length(question) > 2000 THEN 'too long' WHEN NOT coalesce(is_active, false) THEN 'disabled' WHEN ban_until > asked_at THEN 'banned' END, 'admitted') AS outcome, count(*) AS questions
FROM a LEFT JOIN u USING (user_id) GROUP BY 1""")
def _(spark, d):
    users = I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("ban_until"),
    )
    asked = I.table(spark, d, "events").select(
        "user_id", F.col("ts").alias("asked_at"),
        F.when(F.col("event_type") == "error", "  ").when(F.col("event_type") == "signup", F.repeat("props", F.lit(300))).otherwise(F.col("props")).alias("question"),
    )
    return Q.admission(asked, users).groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("questions"))


# ------------------------------------------------------------------------------ contexts
_CTX = dict(ctx="""SELECT h.query_id, h.document_id, h.parent_id, h.rank, h.score, c.child_content, c.split_group_id, p.parent_content, c.split_group_id || '_' || h.document_id || '.txt' AS source
  FROM vec_hits h JOIN children c USING (document_id, parent_id, child_id) JOIN parents p USING (document_id, parent_id)""")


def contexts(spark, d):
    hits = few(vector_hits(spark, d).join(I.children(spark, d).select(*CK, "child_content", "split_group_id"), CK))
    texts = filled(spark, d, hits)
    return R.with_source_names(texts, I.document_info(spark, d).select("document_id", "filename"))


@query("merged_group_contexts", I.with_parts("vec_hits", "parents", **_CTX, many="SELECT query_id, count(DISTINCT split_group_id) > 1 AS many FROM ctx GROUP BY query_id",
  g="""SELECT query_id, CASE WHEN many THEN split_group_id ELSE split_group_id || rank END AS k, min(rank) AS r, max(score) AS score, count(*) AS source_count,
       string_agg(parent_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS content FROM ctx JOIN many USING (query_id) GROUP BY ALL""") + """
SELECT query_id, score, source_count, md5(content) AS content_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM g""")
def _(spark, d):
    return A.merge_group_contexts(contexts(spark, d)).select("query_id", "score", "source_count", F.md5("content").alias("content_key"), "rank")


@query("confidence_labels", I.with_parts("vec_hits") + """
SELECT q.query_id, CASE WHEN max(score) >= 0.6 THEN '高' WHEN max(score) >= 0.4 THEN '中' ELSE '低' END AS confidence FROM questions q LEFT JOIN vec_hits h USING (query_id) GROUP BY q.query_id""")
def _(spark, d):
    return A.confidence_label(I.questions(spark, d), vector_hits(spark, d))


@query("extractive_answers", I.with_parts("vec_hits", "parents", **_CTX,
  c0="""SELECT query_id, rank, trim(parent_content, ' ' || chr(10) || chr(9)) AS c, source FROM ctx""",
  c1="""SELECT *, least(length(c), 500) + length(source) + 10 AS need FROM c0 QUALIFY row_number() OVER (PARTITION BY query_id, c ORDER BY rank) = 1""",
  c2="""SELECT query_id, list([{'parts': ['【来源：' || source || '】' || chr(10)], 'c': c, 's': length(source) + 10, 'used': 0::BIGINT, 'stop': false}] ORDER BY rank) AS l FROM c1 GROUP BY query_id""",
  c3="""SELECT query_id, list_reduce(l, lambda a, x: CASE WHEN a[1].stop THEN a
      WHEN a[1].used + least(length(x[1].c), 500) + x[1].s <= 2000 THEN [{'parts': list_append(a[1].parts, x[1].parts[1] || left(x[1].c, 500)), 'c': '', 's': 0::BIGINT, 'used': a[1].used + least(length(x[1].c), 500) + x[1].s, 'stop': false}]
      WHEN 2000 - a[1].used - x[1].s > 50 THEN [{'parts': list_append(a[1].parts, x[1].parts[1] || left(x[1].c, (2000 - a[1].used - x[1].s)::INT)), 'c': '', 's': 0::BIGINT, 'used': a[1].used + least(length(x[1].c), 2000 - a[1].used - x[1].s) + x[1].s, 'stop': false}]
      ELSE [{'parts': a[1].parts, 'c': '', 's': 0::BIGINT, 'used': a[1].used, 'stop': true}] END,
      [{'parts': []::VARCHAR[], 'c': '', 's': 0::BIGINT, 'used': 0::BIGINT, 'stop': false}])[1] AS s FROM c2""") + """
SELECT query_id, md5(array_to_string(s.parts, chr(10) || chr(10))) AS answer_key, length(array_to_string(s.parts, chr(10) || chr(10))) AS chars FROM c3""")
def _(spark, d):
    a = A.extractive_answers(I.questions(spark, d), contexts(spark, d))
    return a.select("query_id", F.md5("answer").alias("answer_key"), long(F.length("answer")).alias("chars"))


@query("distinct_sources", I.with_parts("vec_hits", "parents", **_CTX) + """
SELECT query_id, string_agg(source, '|' ORDER BY r) AS sources FROM (SELECT query_id, source, min(rank) AS r FROM ctx GROUP BY ALL) GROUP BY query_id""")
def _(spark, d):
    return A.distinct_sources(contexts(spark, d)).select("query_id", F.array_join("sources", "|").alias("sources"))


@query("prompt_rows", I.with_parts("vec_hits", "parents", **_CTX,
  hist="SELECT conv_id AS query_id, turn, role, text AS content FROM conversations",
  sums="SELECT query_id, string_agg(content, chr(10) ORDER BY turn, content) AS s FROM hist WHERE role IN ('summary', 'system') GROUP BY query_id",
  turns=f"""SELECT query_id, string_agg(CASE WHEN role = 'user' THEN '{K.PROMPT_USER}' ELSE '{K.PROMPT_ASSISTANT}' END || content, chr(10) ORDER BY turn) AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn DESC) AS r FROM hist WHERE role NOT IN ('summary', 'system')) WHERE r <= {K.PROMPT_TURNS} GROUP BY query_id""",
  told=f"""SELECT query_id, string_agg('[来源 ' || rank || '] ' || coalesce(source, '{K.PROMPT_UNKNOWN_SOURCE}') || ' (相关度：' || score::DECIMAL(18, 6)::DECIMAL(10, 2)::VARCHAR
    || ')' || chr(10) || parent_content || '{K.PROMPT_CONTEXT_END}', chr(10) ORDER BY rank) AS c FROM ctx WHERE query_id % 3 <> 0 GROUP BY query_id""",
  made=f"""SELECT query_id, coalesce('{K.PROMPT_SUMMARY_HEAD}' || s || chr(10) || chr(10), '') || coalesce('{K.PROMPT_TURNS_HEAD}' || t || chr(10) || chr(10), '')
    || CASE WHEN c IS NULL THEN '{K.PROMPT_NO_CONTEXT_HEAD}' || question || '{K.PROMPT_NO_CONTEXT_TASK}'
       ELSE '{K.PROMPT_CONTEXT_HEAD}' || c || '{K.PROMPT_TASK}' || question || chr(10) || chr(10) || '{K.PROMPT_RULES}{K.PROMPT_MODEL_RULE.format(model="m1")}' END AS p
    FROM questions LEFT JOIN sums USING (query_id) LEFT JOIN turns USING (query_id) LEFT JOIN told USING (query_id)""",
) + "SELECT query_id, length(p) AS chars, md5(p) AS prompt_key FROM made")
def _(spark, d):
    """Prompts with a history of the same number; every third question has no contexts."""
    hist = conversations(spark, d).select(F.col("conv_id").alias("query_id"), "turn", "role", F.col("text").alias("content"))
    p = A.prompts(I.questions(spark, d), contexts(spark, d).where("query_id % 3 <> 0"), hist, "m1")
    return p.select("query_id", long(F.length("prompt")).alias("chars"), F.md5("prompt").alias("prompt_key"))


@query("cacheable_answers", f"SELECT role, count(*) AS answers, count(*) FILTER (WHERE length(text) > 0 AND len(list_filter({lst(K.NOT_FOUND_PHRASES)}, lambda p: contains(text, p))) = 0) AS cacheable FROM (SELECT role, CASE WHEN turn = 1 THEN '抱歉，我目前无法回答' || text ELSE text END AS text FROM conversations) GROUP BY role")
def _(spark, d):
    t = F.when(F.col("turn") == 1, F.concat(F.lit("抱歉，我目前无法回答"), F.col("text"))).otherwise(F.col("text"))
    return conversations(spark, d).groupBy("role").agg(F.count("*").alias("answers"), F.count_if(A.cacheable(t)).alias("cacheable"))


# ------------------------------------------------------------------------------ history
def messages(spark, d):
    return conversations(spark, d).select(
        F.col("conv_id").alias("session_id"), "turn", F.when(F.col("role") == "system", "summary").otherwise(F.col("role")).alias("role"), F.col("text").alias("content")
    )


_MSG = "msg AS (SELECT conv_id AS session_id, turn, CASE role WHEN 'system' THEN 'summary' ELSE role END AS role, text AS content, length(text) // 2 AS tokens FROM conversations)"
_NEED = "need AS (SELECT session_id, sum(tokens) > 1500 AS compress FROM msg GROUP BY session_id)"
_FIT = "fit AS (SELECT session_id, turn, role, content FROM (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn DESC) AS s FROM msg) WHERE s <= 1500)"
_RECENT = "rec AS (SELECT session_id, turn, role, content, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM msg WHERE role NOT IN ('summary', 'system'))"


@query("token_estimates", """SELECT conv_id, turn, length(text) // 2 AS half_length,
 CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[一-鿿]')) * 1.5 + (length(text) - len(regexp_extract_all(text, '[一-鿿]'))) * 0.25)) END::BIGINT AS by_script,
 greatest(10, length(text) // 3) AS last_input, greatest(10, length(text) // 2) AS last_output FROM conversations""")
def _(spark, d):
    t = F.col("text")
    li, lo = X.last_resort_usage(t)
    return conversations(spark, d).select("conv_id", "turn", X.tokens_half_length(t).alias("half_length"), X.tokens_by_script(t).alias("by_script"), li.alias("last_input"), lo.alias("last_output"))


@query("usage_estimates", """WITH a AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 7 END AS i, CASE WHEN turn % 3 = 0 THEN 5 END AS o, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN i IS NOT NULL THEN 12 WHEN t <> '' THEN 2 * greatest(1, floor(length(t) * 0.25)) ELSE 20 END::BIGINT AS total_tokens FROM a""")
def _(spark, d):
    t = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("text"))
    rows = conversations(spark, d).select(
        "conv_id", "turn", t.alias("prompt"), t.alias("answer"),
        F.when(F.col("turn") % 3 == 0, 7).alias("input_tokens"), F.when(F.col("turn") % 3 == 0, 5).alias("output_tokens"),
    )
    return H.usage_estimates(rows).select("conv_id", "turn", "total_tokens")


@query("history_needs_compression", f"WITH {_MSG}, {_NEED} SELECT session_id, compress FROM need")
def _(spark, d):
    return H.needs_compression(messages(spark, d)).select("session_id", "compress")


@query("history_newest_that_fit", f"WITH {_MSG}, {_FIT} SELECT session_id, turn, role FROM fit")
def _(spark, d):
    return H.newest_that_fit(messages(spark, d)).select("session_id", "turn", "role")


@query("history_load", f"""WITH {_MSG}, f AS (SELECT * FROM msg),
s AS (SELECT *, max(turn) FILTER (role = 'summary') OVER (PARTITION BY session_id) AS m FROM f),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn) AS tot FROM s WHERE m IS NULL OR turn >= m) SELECT session_id, turn, role FROM t WHERE tot <= 3000""")
def _(spark, d):
    return H.load_history(messages(spark, d)).select("session_id", "turn", "role")


@query("history_recent_turns", f"WITH {_MSG}, {_RECENT} SELECT session_id, turn, role FROM rec WHERE r <= 4")
def _(spark, d):
    return H.recent_turns(messages(spark, d), 4).select("session_id", "turn", "role")


@query("managed_history", f"""WITH {_MSG}, {_NEED}, {_FIT}, {_RECENT}, sm AS (SELECT DISTINCT session_id FROM msg WHERE role = 'summary'),
nn AS (SELECT session_id FROM rec GROUP BY session_id HAVING count(*) >= 2)
SELECT session_id, turn, role FROM msg JOIN need USING (session_id) WHERE NOT compress
UNION ALL SELECT session_id, -1, 'system' FROM need JOIN sm USING (session_id) WHERE compress
UNION ALL SELECT session_id, turn, role FROM fit JOIN need USING (session_id) WHERE compress AND session_id NOT IN (SELECT session_id FROM sm)
UNION ALL SELECT session_id, turn, role FROM rec JOIN need USING (session_id) JOIN nn USING (session_id) WHERE compress AND r <= 2""")
def _(spark, d):
    """Sessions with a summary turn have a stored summary."""
    m = messages(spark, d)
    summaries = m.where("role = 'summary'").select("session_id").distinct().withColumn("content", F.lit("summary"))
    return H.managed_history(m, summaries).select("session_id", "turn", "role")


@query("managed_history_truncated", f"""WITH {_MSG}, {_NEED}, {_RECENT}
SELECT session_id, turn, role FROM msg JOIN need USING (session_id) WHERE NOT compress UNION ALL SELECT session_id, turn, role FROM rec JOIN need USING (session_id) WHERE compress AND r <= 4""")
def _(spark, d):
    return H.managed_history(messages(spark, d)).select("session_id", "turn", "role")


@query("message_rows", """SELECT conv_id, turn, to_json({'input_tokens': length(text) // 3, 'output_tokens': length(text) // 2})::VARCHAR AS token_usage, to_json([role])::VARCHAR AS sources FROM conversations""")
def _(spark, d):
    m = conversations(spark, d).select(
        "conv_id", "turn",
        F.struct(F.floor(F.length("text") / 3).alias("input_tokens"), F.floor(F.length("text") / 2).alias("output_tokens")).alias("token_usage"),
        F.array("role").alias("sources"),
    )
    return S.message_rows(m)


# ------------------------------------------------------------------------------ caches
def asks(spark, d):
    return I.table(spark, d, "events").select(F.col("event_id").alias("ask_id"), F.col("props").alias("question"), F.col("ts").alias("asked_at"), "event_type")


@query("exact_answer_reuse", """WITH s AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT e.event_id AS ask_id, arg_max(s.event_id, s.ts) AS entry_id FROM events e LEFT JOIN s ON s.props = e.props AND s.ts <= e.ts AND e.ts < s.ts + INTERVAL 3600 SECOND GROUP BY e.event_id""")
def _(spark, d):
    log = asks(spark, d)
    stored = log.where("event_type = 'purchase'").select(F.col("ask_id").alias("entry_id"), "question", F.col("asked_at").alias("stored_at"))
    return CA.reuse_exact(log, stored, 3600).select("ask_id", "entry_id")


@query("search_result_reuse", """SELECT event_id AS ask_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3600 SECOND THEN lag(event_id) OVER w END AS entry_id FROM events WINDOW w AS (PARTITION BY props, user_id ORDER BY ts, event_id)""")
def _(spark, d):
    log = I.table(spark, d, "events").select(
        F.col("event_id").alias("ask_id"), F.concat_ws("|", "props", "user_id").alias("key"), F.col("ts").alias("asked_at")
    )
    return CA.latest_before(log, "key", "asked_at", "ask_id", K.TTL_SEARCH_S).select("ask_id", "entry_id")


@query("semantic_answer_reuse", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, TIMESTAMP '2024-01-01' + INTERVAL (vec_id) HOUR AS at FROM embeddings),
p AS (SELECT a.vec_id AS ask_id, s.vec_id AS entry_id, round(list_cosine_similarity(a.e, s.e), 6) AS similarity FROM v a JOIN v s ON s.at < a.at AND a.at < s.at + INTERVAL 7 DAY)
SELECT v.vec_id AS ask_id, entry_id, similarity FROM v LEFT JOIN (SELECT * FROM p WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY similarity DESC, entry_id) = 1) b ON v.vec_id = ask_id""")
def _(spark, d):
    """One question per hour with the given vectors; threshold 0.3, which these vectors reach."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("vec_id").cast("int"))
    e = I.table(spark, d, "embeddings")
    asked = e.select(F.col("vec_id").alias("ask_id"), at.alias("asked_at"), "embedding")
    stored = e.select(F.col("vec_id").alias("entry_id"), at.alias("stored_at"), "embedding")
    return CA.reuse_similar(asked, stored, 0.3).select("ask_id", "entry_id", "similarity")


@query("semantic_cache_newest", """SELECT md5(props) AS content_key, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_stored, arg_max(event_id, ts) AS entry_id FROM events GROUP BY props ORDER BY min(ts) DESC, content_key LIMIT 50""")
def _(spark, d):
    e = I.table(spark, d, "events").select(F.col("event_id").alias("entry_id"), X.content_key(F.col("props")).alias("content_key"), F.col("ts").alias("stored_at"))
    return CA.newest_entries(e, 50).select("content_key", F.date_format("last_stored", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_stored"), "entry_id")


@query("storable_answers", f"SELECT count(*) AS answers FROM conversations WHERE role = 'assistant' AND length(text) > 900 AND len(list_filter({lst(K.NOT_FOUND_PHRASES)}, lambda p: contains(text, p))) = 0")
def _(spark, d):
    a = conversations(spark, d).where("role = 'assistant'").select(F.col("text").alias("answer"), F.when(F.length("text") > 900, "高").otherwise("低").alias("confidence"))
    return CA.storable(a).agg(F.count("*").alias("answers"))


@query("cache_purge", """SELECT event_id FROM events WHERE ts + INTERVAL (value * 3600) SECOND > TIMESTAMP '2024-01-20' ORDER BY ts + INTERVAL (value * 3600) SECOND DESC, event_id DESC LIMIT 2000""")
def _(spark, d):
    e = I.table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("ts") + F.make_interval(secs=F.floor(F.col("value") * 3600))).alias("expire_at"))
    return CA.purge(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 2000).select(F.col("key").alias("event_id"))


@query("cache_invalidation", "SELECT event_type, count(*) AS entries FROM events WHERE NOT starts_with(event_type || ':' || user_id, 'view:') GROUP BY event_type")
def _(spark, d):
    e = I.table(spark, d, "events").withColumn("key", F.concat("event_type", F.lit(":"), "user_id"))
    return CA.invalidate(e, "view:*").groupBy("event_type").agg(F.count("*").alias("entries"))


# ------------------------------------------------------------------------------ retrieval evaluation
def golden(spark, d):
    q = I.questions(spark, d)
    words = F.filter(F.array_distinct(X.tokens(F.col("question"))), lambda t: F.length(t) >= 9)
    diff = F.when(F.col("query_id") % 3 == 0, "easy").when(F.col("query_id") % 3 == 1, "medium").otherwise("hard")
    return q.select(
        "query_id", "question", words.alias("expected_keywords"), F.array("question").alias("expected_content"),
        diff.alias("difficulty"), F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")).alias("category"),
    )


_GOLD = dict(gold=f"""SELECT item_id AS query_id, text AS question, list_filter(list_distinct({I.TOK.format('text')}), lambda t: length(t) >= 9) AS kw,
   CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, 'c' || (item_id % 4) AS category FROM benchmark""")
_JUDGE = dict(
    top5="SELECT query_id, document_id, rank, lower(parent_content) AS t FROM bm25_ranked JOIN parents USING (document_id, parent_id) WHERE rank <= 5",
    jd="""SELECT t.query_id, rank, list_distinct(list_concat(list_filter(kw, lambda k: contains(t, lower(k))), CASE WHEN contains(t, lower(question)) THEN [question] ELSE []::VARCHAR[] END)) AS m
      FROM top5 t JOIN gold USING (query_id)""",
    ag="""SELECT query_id, count(*) AS retrieved, count(*) FILTER (len(m) > 0) AS relevant_count, min(rank) FILTER (len(m) > 0) AS f, len(list_distinct(flatten(list(m)))) AS mm FROM jd GROUP BY query_id""",
    met="""SELECT query_id, difficulty, category, coalesce(retrieved, 0) AS retrieved, coalesce(relevant_count, 0) AS relevant_count,
      least(1.0, coalesce(mm, 0) / (len(kw) + 1))::DOUBLE AS recall, coalesce(relevant_count / retrieved, 0)::DOUBLE AS precision, coalesce(1.0 / f, 0)::DOUBLE AS mrr,
      coalesce(relevant_count, 0) > 0 AS is_hit, CASE WHEN len(kw) + 1 <= 2 THEN coalesce(relevant_count, 0) > 0 ELSE coalesce(mm, 0) >= greatest(2, floor((len(kw) + 1) * 0.5)) END AS passed,
      len(kw) + 1 - coalesce(mm, 0) AS missing FROM gold LEFT JOIN ag USING (query_id)""",
)


def judged(spark, d):
    g = golden(spark, d)
    hits = few(P.search(I.lexical_index(spark, d), g, 5))
    text = hits.join(I.parents(spark, d), R.KEY).withColumnRenamed("parent_content", "text")
    return g, E.relevance(g, text)


@query("hit_relevance", I.with_parts("bm25_ranked", "parents", **_GOLD, **_JUDGE) + "SELECT query_id, rank, len(m) AS matched, len(m) > 0 AS relevant FROM jd")
def _(spark, d):
    return judged(spark, d)[1].select("query_id", "rank", long(F.size("matched")).alias("matched"), "relevant")


_R6 = "round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr"


@query("retrieval_evaluation_by_question", I.with_parts("bm25_ranked", "parents", **_GOLD, **_JUDGE) + f"""
SELECT query_id, difficulty, retrieved, relevant_count, {_R6}, is_hit, passed, missing FROM met""")
def _(spark, d):
    return metrics(spark, d).select(
        "query_id", "difficulty", "retrieved", "relevant_count", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"),
        F.round("mrr", 6).alias("mrr"), "is_hit", "passed", long(F.size("missing")).alias("missing"),
    )


def metrics(spark, d):
    return E.question_metrics(*judged(spark, d))


@query("retrieval_report", I.with_parts("bm25_ranked", "parents", **_GOLD, **_JUDGE) + """
SELECT difficulty, count(*) AS questions, count(*) FILTER (passed) AS passed, count(*) FILTER (is_hit) AS hits, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr
FROM met GROUP BY ROLLUP (difficulty)""")
def _(spark, d):
    r = E.retrieval_report(metrics(spark, d))
    return r.select("difficulty", "questions", "passed", "hits", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query("golden_subsets", I.with_parts(**_GOLD) + "SELECT query_id, difficulty, category FROM gold WHERE difficulty = 'easy' OR category = 'c1'")
def _(spark, d):
    g = golden(spark, d)
    return S.golden_subset(g, difficulty="easy").unionByName(S.golden_subset(g, category="c1")).select("query_id", "difficulty", "category").distinct()


@query("golden_stats", I.with_parts(**_GOLD) + "SELECT difficulty, category, count(*) AS items FROM gold GROUP BY GROUPING SETS ((), (difficulty), (category))")
def _(spark, d):
    return E.golden_stats(golden(spark, d))


_SQ = "lower(regexp_replace({0}, '\\s+', '', 'g'))"
_FRAG = dict(fr="""SELECT query_id, 'k' AS kind, unnest(kw) AS fragment FROM gold UNION ALL SELECT query_id, 'c', question FROM gold""",
   ds=f"SELECT DISTINCT {_SQ.format('text')} AS t FROM documents", fs=f"SELECT DISTINCT fragment, {_SQ.format('fragment')} AS f FROM fr",
   hit="SELECT DISTINCT fragment FROM fs JOIN ds ON contains(t, f)",
   fd="SELECT query_id, kind, fragment, fragment IN (SELECT fragment FROM hit) AS found FROM fr")


@query("golden_vs_corpus", I.with_parts(**_GOLD, **_FRAG) + "SELECT query_id, count(*) FILTER (kind = 'k') AS keywords, count(*) FILTER (kind = 'k' AND found) AS keyword_hits, count(*) FILTER (kind = 'c' AND found) AS content_hits FROM fd GROUP BY query_id")
def _(spark, d):
    g = golden(spark, d)
    k = g.select("query_id", F.lit("k").alias("kind"), F.explode("expected_keywords").alias("fragment"))
    c = g.select("query_id", F.lit("c").alias("kind"), F.explode("expected_content").alias("fragment"))
    frag = k.unionByName(c).withColumn("fragment_id", F.concat_ws("|", "query_id", "kind", "fragment"))
    found = E.fragments_in_corpus(frag, I.documents(spark, d))
    return found.groupBy("query_id").agg(
        F.count_if(F.col("kind") == "k").alias("keywords"), F.count_if((F.col("kind") == "k") & F.col("found")).alias("keyword_hits"),
        F.count_if((F.col("kind") == "c") & F.col("found")).alias("content_hits"),
    )


# ------------------------------------------------------------------------------ generation evaluation
def qa_log(spark, d):
    """Assistant turns with the user turn before them; user turns of the session are the context."""
    c = conversations(spark, d)
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    ctx = c.where("role <> 'assistant'").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("context")
    )
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    kw = F.filter(F.array_distinct(X.tokens(F.col("question"))), lambda t: F.length(t) >= 6)
    diff = F.when(F.col("conv_id") % 3 == 0, "easy").when(F.col("conv_id") % 3 == 1, "medium").otherwise("hard")
    return a.join(q, ["conv_id", "turn"]).join(ctx, "conv_id").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "question", "answer", "context", kw.alias("keywords"),
        F.array("question").alias("fragments"), diff.alias("difficulty"), (F.length("answer") % 400 / 10.0).alias("latency"),
        (F.col("conv_id") % 3).alias("context_count"), (F.col("turn") % 2).alias("source_count"),
    )


_QA = dict(
    cx="SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context FROM conversations WHERE role <> 'assistant' GROUP BY conv_id",
    qa=f"""SELECT a.conv_id * 100 + a.turn AS answer_id, a.conv_id, a.turn, q.text AS question, a.text AS answer, context,
      list_filter(list_distinct({I.TOK.format('q.text')}), lambda t: length(t) >= 6) AS kw, CASE a.conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
      length(a.text) % 400 / 10.0::DOUBLE AS latency, a.conv_id % 3 AS cc, a.turn % 2 AS sc
      FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND q.role = 'user' JOIN cx ON cx.conv_id = a.conv_id WHERE a.role = 'assistant'""",
    gr=f"""SELECT answer_id, list_distinct({I.TOK.format('answer')}) AS atk, list_distinct({I.TOK.format('context')}) AS ctk FROM qa""",
)
_GR = "CASE WHEN len(atk) > 0 THEN len(list_intersect(atk, ctk)) / len(atk) ELSE 0 END::DOUBLE"


@query("groundedness", I.with_parts(**_QA) + f"SELECT answer_id, round({_GR}, 6) AS grounded FROM gr")
def _(spark, d):
    return qa_log(spark, d).select("answer_id", F.round(E.groundedness(F.col("answer"), F.col("context")), 6).alias("grounded"))


_KW1 = "len(list_filter(kw, lambda k: contains(answer, k) OR (length(k) >= 4 AND len(list_filter(range(1, length(k) - 1), lambda i: contains(answer, substring(k, i, 3)))) > 0)))"
_KW2 = f"len(list_filter(kw, lambda k: contains(answer, k) OR list_contains({I.TOK.format('answer')}, k)))"
_CH = "CASE WHEN len(list_filter(range(1, length(question) - 2, 2), lambda i: contains(answer, substring(question, i, 4)))) > 0 THEN 1 ELSE 0 END"


@query("keyword_match_trigram", I.with_parts(**_QA) + f"SELECT answer_id, len(kw) AS keywords, {_KW1} AS hits FROM qa")
def _(spark, d):
    return qa_log(spark, d).select("answer_id", long(F.size("keywords")).alias("keywords"), long(E.keyword_hits_trigram(F.col("keywords"), F.col("answer"))).alias("hits"))


@query("keyword_match_tokens", I.with_parts(**_QA) + f"SELECT answer_id, {_KW2} AS hits, CASE WHEN len(kw) > 0 THEN round({_KW2} / len(kw), 3) ELSE 0 END::DOUBLE AS ratio FROM qa")
def _(spark, d):
    h = E.keyword_hits_tokens(F.col("keywords"), F.col("answer"))
    return qa_log(spark, d).select("answer_id", long(h).alias("hits"), E.ratio(h, F.col("keywords")).alias("ratio"))


@query("content_coverage", I.with_parts(**_QA) + f"SELECT answer_id, ({_CH})::BIGINT AS hits FROM qa")
def _(spark, d):
    return qa_log(spark, d).select("answer_id", long(E.content_hits(F.col("fragments"), F.col("answer"))).alias("hits"))


def _vec_sql(name, src, col):
    return f"""SELECT {name}, (c >> 1) % 64 AS slot, sum(CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM (SELECT {name}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS c
      FROM (SELECT {name}, unnest({I.TOK.format(col)}) AS t FROM {src})) GROUP BY ALL"""


@query("semantic_groundedness", I.with_parts(**_QA, av=_vec_sql("answer_id", "qa", "answer"), xv=_vec_sql("answer_id", "qa", "context"),
   dp="SELECT answer_id, sum(av.v * xv.v) AS dp FROM av JOIN xv USING (answer_id, slot) GROUP BY ALL", an="SELECT answer_id, sqrt(sum(v * v)) AS n FROM av GROUP BY ALL", xn="SELECT answer_id, sqrt(sum(v * v)) AS n FROM xv GROUP BY ALL") + """
SELECT answer_id, round(coalesce(round(dp / nullif(an.n * xn.n, 0), 6), 0) + 1e-12, 3) AS semantic FROM qa LEFT JOIN dp USING (answer_id) LEFT JOIN an USING (answer_id) LEFT JOIN xn USING (answer_id)""")
def _(spark, d):
    v = qa_log(spark, d).select("answer_id", V.hashed_embedding(F.col("answer")).alias("a"), V.hashed_embedding(F.col("context")).alias("c"))
    return v.select("answer_id", F.round(V.cosine(F.col("a"), F.col("c")), 3).alias("semantic"))


def flagged(spark, d):
    h = E.keyword_hits_tokens(F.col("keywords"), F.col("answer"))
    rows = qa_log(spark, d).select(
        "answer_id", "difficulty", "latency", "context_count", "source_count",
        F.round(E.groundedness(F.col("answer"), F.col("context")), 3).alias("grounded"),
        E.ratio(h, F.col("keywords")).alias("keyword_ratio"), long(h).alias("keyword_hits"), long(F.size("keywords")).alias("keyword_total"),
        E.ratio(E.content_hits(F.col("fragments"), F.col("answer")), F.col("fragments")).alias("content_ratio"),
        F.size("fragments").alias("n_content"), F.round(F.length("answer") % 100 / 100.0, 6).alias("semantic"),
    )
    return E.pass_flags(rows)


_FLAG = dict(_QA, sc0=f"""SELECT qa.answer_id, difficulty, latency, cc, sc, round({_GR}, 3) AS grounded, CASE WHEN len(kw) > 0 THEN round({_KW2} / len(kw), 3) ELSE 0 END::DOUBLE AS kr,
     {_KW2} AS kh, len(kw) AS kn, ({_CH})::DOUBLE AS cr, round(length(answer) % 100 / 100.0::DOUBLE, 6) AS semantic FROM qa JOIN gr USING (answer_id)""",
  fl="""SELECT *, grounded >= CASE difficulty WHEN 'easy' THEN 0.4 WHEN 'medium' THEN 0.3 ELSE 0.2 END AS pg, kr >= 0.25 AS pk,
     cr >= CASE difficulty WHEN 'easy' THEN 0.2 WHEN 'medium' THEN 0.15 ELSE 0.1 END OR (difficulty = 'hard' AND grounded >= 0.3 AND kr >= 0.5) AS pc, latency <= 35 AS pl, cc = 0 OR sc > 0 AS ps FROM sc0""")


@query("generation_pass_flags", I.with_parts(**_FLAG) + "SELECT answer_id, grounded, kr AS keyword_ratio, pg AS pass_grounded, pk AS pass_keyword, pc AS pass_content, pl AS pass_latency, ps AS pass_source, pg AND pk AND pc AND pl AND ps AS passed FROM fl")
def _(spark, d):
    return flagged(spark, d).select("answer_id", "grounded", "keyword_ratio", "pass_grounded", "pass_keyword", "pass_content", "pass_latency", "pass_source", "passed")


@query("generation_summary", I.with_parts(**_FLAG) + """SELECT difficulty, count(*) AS questions, round(avg((pg AND pk AND pc AND pl AND ps)::INT), 6) AS passed_rate, round(avg(pg::INT), 6) AS pass_grounded_rate,
 round(avg(pk::INT), 6) AS pass_keyword_rate, round(avg(pc::INT), 6) AS pass_content_rate, round(avg(pl::INT), 6) AS pass_latency_rate, round(avg(ps::INT), 6) AS pass_source_rate, round(avg(grounded), 6) AS grounded_avg,
 min(grounded) AS grounded_min, max(grounded) AS grounded_max, round(avg(semantic), 6) AS semantic_avg, round(avg(latency), 6) AS latency_avg, max(latency) AS latency_max FROM fl GROUP BY ROLLUP (difficulty)""")
def _(spark, d):
    return E.generation_summary(flagged(spark, d))


@query("generation_run_gates", I.with_parts(**_FLAG) + """, a AS (SELECT round(avg(grounded), 6) AS avg_grounded, round(avg(latency), 6) AS avg_latency, round(sum(kh) / sum(kn), 6) AS keyword_accuracy,
 list_sort(list(latency) FILTER (latency > 0))[floor(0.99 * count(*) FILTER (latency > 0))::INT + 1] AS p99_latency FROM fl)
SELECT *, avg_grounded >= 0.5 AND keyword_accuracy >= 0.3 AND avg_latency <= 30 AND p99_latency <= 45 AS passed FROM a""")
def _(spark, d):
    return E.run_gates(flagged(spark, d))


@query("rejection_check", f"""SELECT conv_id, turn, len(list_filter({lst(K.REJECTION_PHRASES)}, lambda p: contains(a, p))) > 0 OR (turn % 2 = 0 AND length(a) < 50) AS correct
FROM (SELECT conv_id, turn, CASE WHEN turn = 3 THEN '抱歉' || text ELSE text END AS a FROM conversations)""")
def _(spark, d):
    a = F.when(F.col("turn") == 3, F.concat(F.lit("抱歉"), F.col("text"))).otherwise(F.col("text"))
    return conversations(spark, d).select("conv_id", "turn", E.correctly_rejected(a, F.col("turn") % 2).alias("correct"))


@query("edge_input_check", """WITH r AS (SELECT event_id, event_type = 'error' AS f, CASE event_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 200 ELSE 500 END AS s, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS a FROM events)
SELECT event_id, CASE WHEN f THEN s = 400 OR a = '' ELSE (s = 200 AND a <> '') OR s = 400 END AS passed FROM r""")
def _(spark, d):
    k = F.col("event_id") % 3
    status = F.when(k == 0, 400).when(k == 1, 200).otherwise(500)
    answer = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("")
    return I.table(spark, d, "events").select("event_id", E.edge_input_ok(F.col("event_type") == "error", status, answer).alias("passed"))


@query("multi_turn_check", I.with_parts(**_QA) + """SELECT b.conv_id AS session_id, CASE WHEN len(a.kw) > 0 THEN round(len(list_filter(a.kw, lambda k: contains(b.answer, k))) / len(a.kw), 6) ELSE 0 END::DOUBLE AS keyword_ratio,
 CASE WHEN len(a.kw) > 0 THEN round(len(list_filter(a.kw, lambda k: contains(b.answer, k))) / len(a.kw), 6) ELSE 0 END >= 0.3 AND length(b.answer) > 0 AS passed FROM qa a JOIN qa b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2""")
def _(spark, d):
    log = qa_log(spark, d)
    first = log.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("keywords").alias("expected_keywords"))
    rows = log.select("conv_id", "turn", "answer").join(first, ["conv_id", "turn"]).withColumnRenamed("conv_id", "session_id")
    return E.multi_turn(rows).select("session_id", "keyword_ratio", "passed")


# ------------------------------------------------------------------------------ verification
def verified(spark, d):
    """Every third answer carries a disclaimer, every fourth one a citation mark."""
    log = qa_log(spark, d)
    a = F.concat(
        F.when(F.col("conv_id") % 3 == 0, "据我所知，").otherwise(""), F.col("answer"), F.when(F.col("conv_id") % 4 == 0, "[来源：1]").otherwise("")
    )
    ctx = F.when(F.col("conv_id") % 5 == 0, F.concat("context", F.lit(" "), "answer")).otherwise(F.col("context"))
    return log.select("answer_id", "conv_id", "turn", a.alias("answer"), ctx.alias("context"))


_VER = dict(_QA, v0="""SELECT answer_id, conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN '据我所知，' ELSE '' END || answer || CASE WHEN conv_id % 4 = 0 THEN '[来源：1]' ELSE '' END AS a,
      lower(CASE WHEN conv_id % 5 = 0 THEN context || ' ' || answer ELSE context END) AS c FROM qa""",
  v1="""SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(a), '([一-鿿])', ' \\1 ', 'g'), '\\s+'), lambda w: length(w) > 0) AS w FROM v0""",
  v2="""SELECT *, list_distinct(list_filter(list_transform(range(1, len(w) - 1), lambda i: w[i] || w[i + 1] || w[i + 2]), lambda g: length(g) >= 4)) AS ph FROM v1""",
  v3="""SELECT *, CASE WHEN len(ph) > 0 THEN round(len(list_filter(ph, lambda g: contains(c, g))) / len(ph), 9) ELSE 0 END AS cov, contains(a, '[来源：') AS cite,
      (contains(a, '据我所知'))::INT AS disc FROM v2""",
  v4="SELECT *, disc + (cov < 0.3)::INT + (length(a) < 20)::INT AS iss FROM v3",
  v5="SELECT *, round(greatest(0, least(1, 0.4 + 0.6 * cov + CASE WHEN cite THEN 0.1 ELSE 0 END - disc * 0.1 - iss * 0.05)), 9) AS conf FROM v4")


@query("answer_verification", I.with_parts(**_VER) + "SELECT answer_id, conf >= 0.35 AS is_valid, round(conf + 1e-10, 2)::DOUBLE AS confidence, iss::BIGINT AS issues, round(cov + 1e-10, 2)::DOUBLE AS context_coverage, cite AS has_citation FROM v5")
def _(spark, d):
    return A.verify(verified(spark, d)).select("answer_id", "is_valid", "confidence", long(F.size("issues")).alias("issues"), "context_coverage", "has_citation")


_J = "CASE conv_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.2 END"


@query("judge_text_decoding", f"SELECT conv_id, turn, ({_J})::DOUBLE AS confidence FROM conversations")
def _(spark, d):
    """Stored judge replies: the four combinations of the two verdict lines."""
    k = F.col("conv_id") % 4
    reply = F.concat(F.when(k < 2, "是\n").otherwise("否\n"), F.when(k % 2 == 1, "有\n").otherwise("无\n"), F.col("text"))
    return conversations(spark, d).select("conv_id", "turn", A.judge_confidence(reply).alias("confidence"))


@query("answer_verification_judged", I.with_parts(**_VER, v6=f"""SELECT *, ({_J})::DOUBLE AS j, iss + (({_J}) < 0.5)::INT AS iss2 FROM v4""",
   v7="SELECT *, round(greatest(0, least(1, 0.6 * (0.4 + 0.6 * cov + CASE WHEN cite THEN 0.1 ELSE 0 END - disc * 0.1 - iss2 * 0.05) + 0.4 * j)), 9) AS conf FROM v6") + """
SELECT answer_id, NOT (j < 0.4 AND conf < 0.4) AS is_valid, round(conf + 1e-10, 2)::DOUBLE AS confidence, iss2::BIGINT AS issues FROM v7""")
def _(spark, d):
    k = F.col("conv_id") % 4
    judge = F.when(k == 0, 0.9).when(k == 1, 0.7).when(k == 2, 0.4).otherwise(0.2)
    rows = verified(spark, d).withColumn("judge", judge)
    return A.verify(rows, judge="judge").select("answer_id", "is_valid", "confidence", long(F.size("issues")).alias("issues"))


# ------------------------------------------------------------------------------ layer checks
# Questions of known intent: a word of each intent before the beginning of a turn's text.
_CASES = ((K.FACT_KEYWORDS[0], "fact"), (K.PROCESS_KEYWORDS[0], "process"), (K.POLICY_KEYWORDS[0], "policy"))
_LAYERS = dict(
    cases="SELECT conv_id, turn * 3 + k AS turn, w || left(text, 5) AS text, expected FROM conversations, (VALUES "
    + ", ".join(f"({i}, '{w}', '{e}')" for i, (w, e) in enumerate(_CASES)) + ") v(k, w, expected)",
    hits10="SELECT query_id, count(rank) AS n FROM questions LEFT JOIN (SELECT * FROM bm25_ranked WHERE rank <= 10) USING (query_id) GROUP BY query_id",
)


@query("layer_checks", I.with_parts("bm25_ranked", "vec_hits", **_LAYERS).rstrip() + f""", {_INTENT.replace("FROM conversations", "FROM cases")},
docs AS (SELECT count(*) AS v FROM documents WHERE doc_id % 4 <> 3), par AS (SELECT count(*) AS v FROM (SELECT DISTINCT document_id, parent_id FROM children)),
size AS (SELECT floor(avg(length(child_content))) AS v FROM children), lex AS (SELECT avg(n) AS v FROM hits10),
acc AS (SELECT avg((intent = expected)::INT) AS v FROM it JOIN cases USING (conv_id, turn)),
ex AS (SELECT avg((contains(question, 'the') AND NOT (contains(question, 'retition') AND contains(question, 'ntingth')))::INT) AS v FROM questions),
ret AS (SELECT avg((query_id IN (SELECT query_id FROM vec_hits))::INT) AS v FROM questions)
SELECT 'documents' AS layer, 'completed' AS metric, round(v, 6)::DOUBLE AS value, v > 0 AS passed FROM docs
UNION ALL SELECT 'chunks', 'parents', round(v, 6), v BETWEEN 20 AND 300 FROM par UNION ALL SELECT 'chunks', 'mean child size', round(v, 6), v > 0 FROM size
UNION ALL SELECT 'lexical', 'mean hits', round(v, 6), v > 0 FROM lex UNION ALL SELECT 'intent', 'accuracy', round(v, 6), v >= 2 / 3 FROM acc
UNION ALL SELECT 'expansion', 'changed share', round(v, 6), v >= 0.5 FROM ex UNION ALL SELECT 'retrieval', 'answered share', round(v, 6), v >= 0.5 FROM ret""")
def _(spark, d):
    """Six layers over the corpus: three of four documents completed, lines as chunks, benchmark texts as probes."""
    q = I.questions(spark, d)
    docs = I.documents(spark, d).select(F.when(F.col("doc_id") % 4 != 3, "completed").otherwise("pending").alias("status"))
    count = lambda hits, n: q.join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias(n)), "query_id", "left").fillna(0, [n])
    cases = conversations(spark, d).select(
        F.explode(F.array(*[F.struct(F.concat(F.lit(w), F.left("text", F.lit(5))).alias("question"), F.lit(e).alias("expected")) for w, e in _CASES])).alias("c")
    ).select("c.*")
    expanded = q.select("question", Q.expand(F.col("question"), SYNONYMS).alias("expanded"))
    return E.layer_checks(
        docs, I.children(spark, d), count(P.search(I.lexical_index(spark, d), q, 10), "hits"), Q.classify(cases), expanded,
        count(vector_hits(spark, d), "results"),
    )
