"""Usage, listings, quotas, reviews, consistency and data quality over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.operators import maintenance as M
from askloom.operators import quality as QR
from askloom.operators import usage as U
from askloom.plans import inputs as I
from askloom.plans.registry import query


def t(spark, d, name):
    return I.table(spark, d, name)


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ------------------------------------------------------------------------------ domain tables
def users(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        k.alias("user_id"), F.col("c_name").alias("username"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
        F.when(k % 50 == 0, "admin").when(k % 3 == 1, "teacher").otherwise("student").alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"), (k % 4 == 0).alias("pending_approval"),
        F.when(k % 5 == 0, "rejected").otherwise("approved").alias("approval_status"),
        F.when(k % 7 == 0, ntz("2024-01-15 00:00:00")).alias("ban_until"),
        (k % 6).cast("int").alias("max_questions_per_day"), (k % 4).cast("int").alias("max_uploads_per_day"),
    )


def sessions(spark, d):
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at")
    )


def messages(spark, d):
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"),
        F.when(F.col("l_returnflag") == "R", "up").when(F.col("l_returnflag") == "A", "down").alias("feedback"), F.col("l_shipdate").alias("created_at"),
    )


def question_stats(spark, d):
    return t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.col("p_size").cast("bigint").alias("count"),
    )


def reviewed(spark, d):
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("uploaded_by"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected").alias("review_status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "processing").when(F.col("o_orderpriority") == "2-HIGH", "failed").otherwise("completed").alias("status"),
    )


W = {
    "users": """SELECT c_custkey AS user_id, c_name AS username, lower(replace(c_name, '#', '.')) || '@example.org' AS email, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 3 = 1 THEN 'teacher' ELSE 'student' END AS role,
      c_acctbal > 0 AS is_active, c_custkey % 4 = 0 AS pending_approval, CASE WHEN c_custkey % 5 = 0 THEN 'rejected' ELSE 'approved' END AS approval_status,
      CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-01-15' END AS ban_until, (c_custkey % 6)::INT AS max_q, (c_custkey % 4)::INT AS max_u FROM customer""",
    "sessions": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at FROM orders",
    "messages": "SELECT l_orderkey AS session_id, l_orderkey * 10 + l_linenumber AS message_id, CASE l_returnflag WHEN 'R' THEN 'up' WHEN 'A' THEN 'down' END AS feedback FROM lineitem",
    "stats": "SELECT p_partkey AS id, p_name AS content, p_size::BIGINT AS count FROM part",
    "rev": """SELECT o_orderkey AS document_id, o_custkey AS uploaded_by, o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS review_status,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'processing' WHEN '2-HIGH' THEN 'failed' ELSE 'completed' END AS status FROM orders""",
}


def w(*names, **extra):
    return "WITH " + ", ".join([f"{n} AS ({W[n]})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]) + "\n"


# ------------------------------------------------------------------------------ dashboards
@query("dashboard_totals", w("stats", "users", "messages") + """SELECT (SELECT sum(count)::BIGINT FROM stats) AS questions, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM users) AS users,
 (SELECT count(feedback) FROM messages) AS feedback, (SELECT round(count(*) FILTER (feedback = 'up') * 100.0::DOUBLE / count(feedback), 1) FROM messages) AS satisfaction""")
def _(spark, d):
    return U.dashboard(question_stats(spark, d), t(spark, d, "documents"), users(spark, d), messages(spark, d))


@query("popular_questions", w("stats", s="SELECT content, sum(count)::BIGINT AS count FROM stats GROUP BY content") + "SELECT content, count FROM s ORDER BY count DESC, content LIMIT 10")
def _(spark, d):
    s = question_stats(spark, d).groupBy("content").agg(F.sum("count").alias("count"))
    return U.popular_questions(s, 10)


@query("question_bar_share", w("stats", s="SELECT content, sum(count)::BIGINT AS count FROM stats GROUP BY content") + "SELECT content, count, round(count / (SELECT max(count) FROM s), 6) AS share FROM s")
def _(spark, d):
    s = question_stats(spark, d).groupBy("content").agg(F.sum("count").alias("count"))
    return U.with_bar_share(s).withColumn("share", F.round("share", 6))


_CNT = "c AS (SELECT trim(props) AS content, count(*) AS count, min(ts) AS created_at, max(ts) AS updated_at FROM events WHERE event_type {0} GROUP BY 1)"


@query("question_counter_backfill", "SELECT trim(text) AS content, count(*) AS count FROM conversations WHERE role = 'user' GROUP BY 1")
def _(spark, d):
    m = t(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("content"), F.col("turn").alias("asked_at"))
    return U.count_questions(m).select("content", "count")


@query("question_counter_upsert", """WITH a AS (SELECT trim(props) AS content, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'view' GROUP BY 1),
 b AS (SELECT trim(props) AS content, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT content, coalesce(a.n, 0) + coalesce(b.n, 0) AS count, strftime(least(a.lo, b.lo), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(greatest(a.hi, b.hi), '%Y-%m-%d %H:%M:%S') AS updated_at FROM a FULL JOIN b USING (content)""")
def _(spark, d):
    e = t(spark, d, "events").select(F.col("props").alias("content"), F.col("ts").alias("asked_at"), "event_type")
    old = U.count_questions(e.where("event_type = 'view'"))
    new = U.count_questions(e.where("event_type <> 'view'"))
    return U.merge_counters(old, new).select("content", "count", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"))


@query("question_counter_collapse", "SELECT p_name AS content, min(p_partkey) AS id, sum(p_size)::BIGINT AS count FROM part GROUP BY p_name")
def _(spark, d):
    """Every second text carries blanks around it."""
    s = question_stats(spark, d).withColumn("content", F.when(F.col("id") % 2 == 0, F.concat(F.lit("  "), "content", F.lit(" "))).otherwise(F.col("content")))
    s = s.withColumns({"created_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    return U.collapse_trimmed(s).select("content", "id", "count")


# ------------------------------------------------------------------------------ listings
@query("paged_listing", w("stats", f="SELECT * FROM stats WHERE count IN (3, 5, 7, 9) AND content ILIKE '%re%'") + """
SELECT id, content, count, (SELECT count(*) FROM f) AS total, ceil((SELECT count(*) FROM f) / 20)::BIGINT AS pages, 2 < ceil((SELECT count(*) FROM f) / 20) AS has_next, true AS has_prev FROM f ORDER BY count DESC, id LIMIT 20 OFFSET 20""")
def _(spark, d):
    return U.page(question_stats(spark, d), 2, 20, {"count": [3, 5, 7, 9]}, "RE", ["content"], "count")


@query("substring_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%'")
def _(spark, d):
    return U.search(t(spark, d, "part"), "ReD", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("fetch_by_id_list", "SELECT event_id AS pos, p_partkey, p_name FROM events JOIN part ON p_partkey = user_id")
def _(spark, d):
    ids = t(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("p_partkey"))
    return U.fetch_in_order(ids, t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@query("get_or_create", "SELECT c_custkey AS user_id, false AS created FROM customer UNION ALL SELECT DISTINCT o_custkey + 500, true FROM orders WHERE o_custkey + 500 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    cur = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    want = t(spark, d, "orders").select((F.col("o_custkey") + 500).alias("user_id"))
    return U.get_or_create(cur, want, ["user_id"])


def _updates(spark, d):
    return t(spark, d, "supplier").select((F.col("s_suppkey") * 37).alias("c_custkey"), F.round(F.col("s_acctbal"), 2).alias("c_acctbal"))


@query("update_by_id", "SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey * 37 = c_custkey")
def _(spark, d):
    return U.update_by_id(t(spark, d, "customer").select("c_custkey", "c_acctbal"), _updates(spark, d), "c_custkey")[0]


@query("update_missing_ids", "SELECT s_suppkey * 37 AS c_custkey FROM supplier WHERE s_suppkey * 37 NOT IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    return U.update_by_id(t(spark, d, "customer").select("c_custkey", "c_acctbal"), _updates(spark, d), "c_custkey")[1].select("c_custkey")


@query("session_list", w("sessions", "messages", m="SELECT session_id, count(*) AS n FROM messages GROUP BY 1") + "SELECT id, user_id, coalesce(n, 0) AS message_count FROM sessions LEFT JOIN m ON session_id = id")
def _(spark, d):
    return U.session_list(sessions(spark, d), messages(spark, d)).select("id", "user_id", "message_count")


@query("session_transcript", """SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END AS output_tokens, CASE WHEN turn % 2 = 0 THEN role END AS first_source FROM conversations WHERE role IN ('user', 'assistant')""")
def _(spark, d):
    """Every third token column is broken JSON."""
    m = t(spark, d, "conversations").select(
        "conv_id", "turn", "role",
        F.when(F.col("turn") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"output_tokens": '), F.length("text"), F.lit("}"))).alias("token_usage"),
        F.when(F.col("turn") % 2 == 0, F.to_json(F.array("role"))).alias("sources"),
    )
    return U.transcript(m).select("conv_id", "turn", "role", F.col("token_usage.output_tokens").alias("output_tokens"), F.get("sources", F.lit(0)).alias("first_source"))


def logins(spark, d):
    return t(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("login_time"), (F.col("event_type") != "error").alias("success")
    )


@query("login_records", "SELECT event_id AS id, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return U.login_records(logins(spark, d), success=False, start="2024-01-10", end="2024-01-20").select("id", "user_id")


@query("login_retention", "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS removed, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS kept FROM events")
def _(spark, d):
    kept, removed = U.retain_days(logins(spark, d), "login_time", ntz("2024-01-30 00:00:00"), 10)
    return removed.withColumn("kept", kept.agg(F.count("*").alias("n")).select("n").scalar())


@query("active_announcement", """WITH a AS (SELECT page_id AS id, url AS title, page_id % 3 <> 0 AS act FROM pages), l AS (SELECT id, title FROM a WHERE act ORDER BY id DESC LIMIT 1), seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
SELECT c_custkey AS user_id, l.id AS announcement_id, title FROM customer, l WHERE c_custkey NOT IN (SELECT user_id FROM seen)""")
def _(spark, d):
    a = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), (F.col("page_id") % 3 != 0).alias("is_active"), F.lit(True).alias("show_once"), F.col("page_id").alias("created_at"))
    latest = a.where("is_active").agg(F.max("id").alias("m")).select("m").scalar()
    seen = t(spark, d, "events").where("event_type = 'view'").select("user_id").distinct().withColumn("announcement_id", latest)
    return U.announcement_for(users(spark, d), a, seen)


@query("document_status_counts", w("rev") + "SELECT status, review_status, count(*) AS documents FROM rev GROUP BY GROUPING SETS ((status), (review_status))")
def _(spark, d):
    return U.status_counts(reviewed(spark, d))


# ------------------------------------------------------------------------------ quotas, sessions, users
@query("daily_quota", w("users", r="SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events") + """
SELECT event_id AS request_id, coalesce(role = 'admin' OR n <= max_q, false) AS accepted FROM r LEFT JOIN users USING (user_id)""")
def _(spark, d):
    req = t(spark, d, "events").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("asked_at"))
    lim = users(spark, d).select("user_id", "role", F.col("max_questions_per_day").alias("max_per_day"))
    return U.daily_quota(req, lim).select("request_id", "accepted")


@query("live_sessions", """WITH l AS (SELECT user_id, arg_max(event_id, ts) AS cur FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id AS request_id, coalesce(event_id = cur, false) AS valid FROM events LEFT JOIN l USING (user_id)""")
def _(spark, d):
    e = t(spark, d, "events")
    log = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("login_time"))
    return U.live_sessions(log, e.select("user_id", F.col("event_id").alias("request_id"), F.col("event_id").alias("session_id"))).select("request_id", "valid")


@query("login_decisions", w("users") + """
SELECT CASE WHEN role IS NULL OR event_type = 'error' THEN 'bad password' WHEN role = 'teacher' AND pending_approval THEN 'pending' WHEN approval_status = 'rejected' THEN 'rejected'
 WHEN NOT is_active THEN 'disabled' WHEN ban_until > ts THEN 'banned' ELSE 'ok' END AS outcome, count(*) AS attempts FROM events LEFT JOIN users USING (user_id) GROUP BY 1""")
def _(spark, d):
    att = t(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("at"), (F.col("event_type") != "error").alias("password_ok"))
    return U.login_decisions(att, users(spark, d)).groupBy("outcome").agg(F.count("*").alias("attempts"))


@query("user_moderation", w("users", d="SELECT o_orderkey, o_custkey AS user_id, ['limit', 'ban', 'unban', 'approve', 'reject'][o_orderkey % 5 + 1] AS action FROM orders",
  r="""SELECT d.*, u.*, CASE WHEN role IS NULL THEN 'unknown user' WHEN action IN ('limit', 'ban') AND role = 'admin' THEN 'admins are exempt' WHEN action IN ('approve', 'reject') AND role <> 'teacher' THEN 'not a teacher'
     WHEN action IN ('approve', 'reject') AND NOT pending_approval THEN 'already reviewed' END AS reason FROM d LEFT JOIN users u USING (user_id)""") + """
SELECT o_orderkey AS decision_id, reason AS reject_reason, CASE WHEN reason IS NULL AND action = 'limit' THEN 9 ELSE max_q END AS max_questions_per_day,
 CASE WHEN reason IS NULL AND action = 'limit' THEN CASE WHEN role = 'student' THEN 0 ELSE 2 END ELSE max_u END AS max_uploads_per_day,
 CASE WHEN reason IS NULL AND action = 'ban' THEN '2025-01-01 00:00:00' WHEN reason IS NULL AND action = 'unban' THEN NULL ELSE strftime(ban_until, '%Y-%m-%d %H:%M:%S') END AS ban_until,
 CASE WHEN reason IS NULL AND action = 'approve' THEN 'approved' WHEN reason IS NULL AND action = 'reject' THEN 'rejected' ELSE approval_status END AS approval_status FROM r""")
def _(spark, d):
    k = F.col("o_orderkey")
    actions = F.array(*[F.lit(a) for a in ("limit", "ban", "unban", "approve", "reject")])
    dec = t(spark, d, "orders").select(
        k.alias("decision_id"), F.col("o_custkey").alias("user_id"), F.get(actions, (k % 5).cast("int")).alias("action"),
        F.lit(9).alias("new_max_questions"), F.lit(2).alias("new_max_uploads"), ntz("2025-01-01 00:00:00").alias("new_ban_until"),
    )
    out = U.moderate_users(dec, users(spark, d), carry=["decision_id"])
    return out.select("decision_id", "reject_reason", "max_questions_per_day", "max_uploads_per_day", stamp("ban_until").alias("ban_until"), "approval_status")


@query("message_feedback", w("sessions", "messages", m="SELECT DISTINCT message_id, session_id FROM messages",
  f="SELECT l_orderkey * 10 + l_linenumber AS message_id, CASE WHEN l_suppkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS user_id, CASE l_returnflag WHEN 'R' THEN 'up' WHEN 'A' THEN 'down' ELSE 'meh' END AS value, l_shipdate AS voted FROM lineitem JOIN orders ON o_orderkey = l_orderkey") + """
SELECT message_id, arg_max(value, strftime(voted, '%Y%m%d%H%M%S') || value) AS feedback FROM f JOIN m USING (message_id) JOIN sessions s ON s.id = m.session_id AND s.user_id = f.user_id WHERE value IN ('up', 'down') GROUP BY message_id""")
def _(spark, d):
    l = t(spark, d, "lineitem").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    fb = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("user_id"),
        F.when(F.col("l_returnflag") == "R", "up").when(F.col("l_returnflag") == "A", "down").otherwise("meh").alias("value"), F.col("l_shipdate").alias("at"),
    )
    return U.attach_feedback(fb, messages(spark, d).select("message_id", "session_id").distinct(), sessions(spark, d))


@query("duplicate_accounts", w("users", r="SELECT s_suppkey AS registration_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE s_name END AS username, CASE WHEN s_suppkey % 3 = 0 THEN 'customer.' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') || '@example.org' ELSE 'x@y.org' END AS email FROM supplier") + """
SELECT registration_id, username IN (SELECT username FROM users) OR email IN (SELECT email FROM users) AS taken FROM r""")
def _(spark, d):
    s = F.col("s_suppkey")
    reg = t(spark, d, "supplier").select(
        s.alias("registration_id"), F.when(s % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(s.cast("string"), 9, "0"))).otherwise(F.col("s_name")).alias("username"),
        F.when(s % 3 == 0, F.concat(F.lit("customer."), F.lpad((s * 3).cast("string"), 9, "0"), F.lit("@example.org"))).otherwise("x@y.org").alias("email"),
    )
    return U.duplicate_accounts(reg, users(spark, d)).select("registration_id", "taken")


# ------------------------------------------------------------------------------ settings, models, reviews
def settings(spark, d):
    """Latest value each event type was set to."""
    e = t(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", "ts").alias("v"))
    names = F.create_map(*[F.lit(x) for x in ("view", "query_expansion_enabled", "click", "reranking_enabled", "error", "answer_verification_enabled", "signup", "other", "purchase", "login_enabled")])
    return e.select(F.element_at(names, F.col("event_type")).alias("setting_key"), F.when(F.col("v") % 2 == 0, "true").otherwise("false").alias("setting_value"))


_SET = """st AS (SELECT CASE event_type WHEN 'view' THEN 'query_expansion_enabled' WHEN 'click' THEN 'reranking_enabled' WHEN 'error' THEN 'answer_verification_enabled' WHEN 'signup' THEN 'other' ELSE 'login_enabled' END AS k,
  CASE WHEN arg_max(event_id, ts) % 2 = 0 THEN 'true' ELSE 'false' END AS v FROM events GROUP BY event_type)"""


@query("settings_with_defaults", f"WITH {_SET} SELECT d.k AS setting_key, coalesce(st.v, d.v) AS setting_value FROM (VALUES ('login_enabled', 'true'), ('conversation_summary_enabled', 'true'), ('reranking_enabled', 'true'), ('query_expansion_enabled', 'false')) d(k, v) LEFT JOIN st USING (k)")
def _(spark, d):
    return U.settings_with_defaults(settings(spark, d), {"login_enabled": "true", "conversation_summary_enabled": "true", "reranking_enabled": "true", "query_expansion_enabled": "false"})


def models(spark, d):
    p = F.col("p_partkey")
    return t(spark, d, "part").select(
        p.alias("id"), F.when(p % 3 == 0, "llm").when(p % 3 == 1, "reranker").otherwise("embedding").alias("model_type"), F.col("p_name").alias("model_name"),
        (F.col("p_size") == 49).alias("is_active"), F.concat("p_brand", F.lit("-"), "p_type").alias("api_key"),
    )


_MOD = "md AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'reranker' ELSE 'embedding' END AS model_type, p_name AS model_name, p_size = 49 AS is_active, p_brand || '-' || p_type AS api_key FROM part)"


@query("feature_status", f"""WITH {_SET}, {_MOD}, f AS (SELECT coalesce(max(v) FILTER (k = 'query_expansion_enabled'), 'false') = 'true' AS q, coalesce(max(v) FILTER (k = 'answer_verification_enabled'), 'false') = 'true' AS a,
 coalesce(max(v) FILTER (k = 'conversation_summary_enabled'), 'true') = 'true' AS c, coalesce(max(v) FILTER (k = 'reranking_enabled'), 'true') = 'true' AS r FROM st), g AS (SELECT count(*) FILTER (is_active AND model_type = 'llm') > 0 AS m, count(*) FILTER (is_active AND model_type = 'reranker') > 0 AS rr FROM md)
SELECT q AS query_expansion_enabled, a AS answer_verification_enabled, c AS conversation_summary_enabled, r AS reranking_enabled, m AS llm_available, rr AS rerank_api_available, q AND m AS query_expansion_active, a AND m AS answer_verification_active, c AND m AS conversation_summary_active FROM f, g""")
def _(spark, d):
    return U.feature_status(settings(spark, d), models(spark, d))


@query("model_activation", f"WITH {_MOD} SELECT id, CASE model_type WHEN 'llm' THEN id = (SELECT max(id) FROM md WHERE model_type = 'llm') WHEN 'reranker' THEN id = (SELECT max(id) FROM md WHERE model_type = 'reranker') ELSE is_active END AS is_active FROM md")
def _(spark, d):
    m = models(spark, d)
    chosen = m.where("model_type <> 'embedding'").groupBy("model_type").agg(F.max("id").alias("id"))
    return U.activate_models(m, chosen).select("id", "is_active")


@query("model_invariants", f"WITH {_MOD}, n AS (SELECT model_type, model_name, count(*) AS n, count(*) FILTER (is_active) AS a FROM md GROUP BY ALL) SELECT model_type, sum(a)::BIGINT AS active, count(*) FILTER (n > 1) AS repeated_names, sum(n)::BIGINT AS models, sum(a) <= 1 AND count(*) FILTER (n > 1) = 0 AS ok FROM n GROUP BY model_type")
def _(spark, d):
    return U.model_invariants(models(spark, d))


@query("masked_keys", f"WITH {_MOD} SELECT id, CASE WHEN length(api_key) > 8 THEN left(api_key, 4) || '***' || right(api_key, 4) ELSE api_key END AS api_key FROM md")
def _(spark, d):
    return models(spark, d).select("id", X.mask_key(F.col("api_key")).alias("api_key"))


@query("pending_review_queue", w("rev") + "SELECT document_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rev WHERE review_status = 'pending'")
def _(spark, d):
    return U.pending_queue(reviewed(spark, d)).select("document_id", stamp("created_at").alias("created_at"))


@query("my_documents", w("rev") + "SELECT uploaded_by, document_id, row_number() OVER (PARTITION BY uploaded_by ORDER BY created_at DESC, document_id) AS position FROM rev")
def _(spark, d):
    return U.my_documents(reviewed(spark, d)).select("uploaded_by", "document_id", "position")


_DEC = """dec AS (SELECT l_orderkey AS document_id, l_suppkey AS batch, CASE WHEN l_linenumber = 1 THEN 'approve' WHEN l_linenumber = 7 THEN 'other' ELSE 'reject' END AS action, CASE WHEN l_quantity > 10 THEN l_returnflag ELSE '' END AS reason FROM lineitem
   UNION ALL SELECT -s_suppkey - 1, s_suppkey, 'approve', '' FROM supplier),
 o AS (SELECT dec.*, review_status, status, CASE WHEN review_status IS NULL THEN '文档不存在' WHEN review_status <> 'pending' THEN '该文档已经审核过了' WHEN action = 'reject' AND reason = '' THEN '驳回时必须填写理由' WHEN action NOT IN ('approve', 'reject') THEN '无效的操作' END AS error FROM dec LEFT JOIN rev USING (document_id))"""


def decisions(spark, d):
    l = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("batch"),
        F.when(F.col("l_linenumber") == 1, "approve").when(F.col("l_linenumber") == 7, "other").otherwise("reject").alias("action"),
        F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).otherwise("").alias("reason"),
    )
    s = t(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("document_id"), F.col("s_suppkey").alias("batch"), F.lit("approve").alias("action"), F.lit("").alias("reason"))
    return l.unionByName(s)


@query("document_review", w("rev") .rstrip() + f", {_DEC} SELECT action, error, review_status, status, count(*) AS decisions FROM (SELECT action, error, CASE WHEN error IS NULL AND action = 'approve' THEN 'approved' WHEN error IS NULL THEN 'rejected' ELSE review_status END AS review_status, CASE WHEN error IS NULL AND action = 'approve' THEN 'processing' WHEN error IS NULL THEN 'failed' ELSE status END AS status FROM o) GROUP BY ALL")
def _(spark, d):
    return U.review(decisions(spark, d), reviewed(spark, d)).groupBy("action", "error", "review_status", "status").agg(F.count("*").alias("decisions"))


@query("batch_review_outcome", w("rev").rstrip() + f", {_DEC} SELECT batch, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error = '文档不存在') AS unknown FROM o GROUP BY batch")
def _(spark, d):
    out = U.review(decisions(spark, d), reviewed(spark, d), carry=["batch"])
    return U.batch_outcome(out, ["batch"]).select("batch", "succeeded", "failed", F.coalesce(F.element_at("errors", F.lit("文档不存在")), F.lit(0)).cast("bigint").alias("unknown"))


# ------------------------------------------------------------------------------ maintenance
def vectors(spark, d):
    """The given vectors, some under ids no document has, some under invalid ids."""
    v = F.col("vec_id")
    n = t(spark, d, "documents").agg(F.max("doc_id").alias("m")).select("m").scalar()
    return t(spark, d, "embeddings").select(
        F.when(v % 5 == 0, v + n).when(v % 7 == 0, -v).otherwise(v).alias("document_id"), F.lit("p0").alias("parent_id"), "embedding"
    )


_VEC = "vec AS (SELECT CASE WHEN vec_id % 5 = 0 THEN vec_id + (SELECT max(doc_id) FROM documents) WHEN vec_id % 7 = 0 THEN -vec_id ELSE vec_id END AS document_id FROM embeddings)"


def docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("p0").alias("parent_id"), "text")


@query("delete_documents", f"WITH {_VEC} SELECT document_id, count(*) AS n FROM vec WHERE document_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def _(spark, d):
    gone = t(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return M.delete_rows(vectors(spark, d), gone, ["document_id"]).groupBy("document_id").agg(F.count("*").alias("n"))


@query("drop_invalid_vectors", f"WITH {_VEC} SELECT count(*) FILTER (document_id > 0) AS kept, count(*) FILTER (NOT document_id > 0) AS removed FROM vec")
def _(spark, d):
    kept, removed = M.drop_invalid_vectors(vectors(spark, d))
    return kept.agg(F.count("*").alias("kept")).withColumn("removed", removed.scalar())


@query("vectors_per_document", f"WITH {_VEC} SELECT document_id, count(*) AS vectors FROM vec GROUP BY 1")
def _(spark, d):
    return M.vectors_per_document(vectors(spark, d))


_CONS = f"{_VEC}, c AS (SELECT DISTINCT document_id, 'orphan' AS problem FROM vec WHERE document_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT document_id FROM vec))"


@query("index_consistency", f"WITH {_CONS} SELECT * FROM c")
def _(spark, d):
    return M.consistency(docs(spark, d), vectors(spark, d))


@query("index_consistency_report", f"WITH {_CONS} SELECT count(*) FILTER (problem = 'orphan') AS orphans, count(*) FILTER (problem = 'missing') AS missing, count(*) = 0 AS is_consistent FROM c")
def _(spark, d):
    return M.consistency_report(M.consistency(docs(spark, d), vectors(spark, d)))


@query("parent_integrity", f"WITH {_CONS} SELECT document_id, 'p0' AS parent_id, CASE problem WHEN 'orphan' THEN 'no parent row' ELSE 'no vectors' END AS problem FROM c")
def _(spark, d):
    return M.parent_integrity(docs(spark, d), vectors(spark, d))


@query("large_pair_integrity", """WITH a AS (SELECT DISTINCT l_orderkey AS document_id, 'p' || l_linenumber AS parent_id FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_orderkey AS document_id, 'p' || l_linenumber AS parent_id FROM lineitem WHERE l_linestatus = 'F')
SELECT document_id, parent_id, CASE WHEN a.document_id IS NULL THEN 'no parent row' ELSE 'no vectors' END AS problem FROM a FULL JOIN b USING (document_id, parent_id) WHERE a.document_id IS NULL OR b.document_id IS NULL""")
def _(spark, d):
    l = t(spark, d, "lineitem")
    pair = lambda x: x.select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("parent_id"))
    return M.parent_integrity(pair(l.where("l_returnflag <> 'R'")), pair(l.where("l_linestatus = 'F'")))


@query("clean_orphan_vectors", f"WITH {_VEC} SELECT document_id, count(*) AS n FROM vec WHERE document_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def _(spark, d):
    return M.clean_orphans(vectors(spark, d), docs(spark, d)).groupBy("document_id").agg(F.count("*").alias("n"))


@query("cascade_delete_users", w("users", "sessions", "messages", g="SELECT user_id FROM users WHERE NOT is_active", s="SELECT * FROM sessions WHERE user_id NOT IN (SELECT user_id FROM g)") + """
SELECT 'sessions' AS kept, count(*) AS n FROM s UNION ALL SELECT 'messages', count(*) FROM messages WHERE session_id NOT IN (SELECT id FROM sessions WHERE user_id IN (SELECT user_id FROM g))""")
def _(spark, d):
    s, m = M.cascade_delete(users(spark, d).where("not is_active"), sessions(spark, d), messages(spark, d))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
    return n(s, "sessions").unionByName(n(m, "messages"))


# ------------------------------------------------------------------------------ data quality
_XSS = "(?is)" + "|".join(f"(?:{p})" for p in K.XSS_PATTERNS).replace("'", "''")


@query("xss_detection", f"SELECT page_id, regexp_matches(html, '{_XSS}') AS xss FROM pages UNION ALL SELECT -doc_id - 1, regexp_matches(text, '{_XSS}') FROM documents")
def _(spark, d):
    p = t(spark, d, "pages").select("page_id", X.has_xss(F.col("html")).alias("xss"))
    return p.unionByName(I.documents(spark, d).select((-F.col("doc_id") - 1).alias("page_id"), X.has_xss(F.col("text")).alias("xss")))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_key FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("escaped_key"))


@query("sanitize_filenames", r"""WITH b AS (SELECT page_id, string_split(url, '/')[-1] AS n, url FROM pages), c AS (SELECT page_id, regexp_replace(regexp_replace(replace(replace(n, '..', '_'), '\', '_'), '[:*?"<>|]', '_', 'g'), '[^\p{L}\p{M}\p{N}_\-.]', '', 'g') AS t FROM b)
SELECT page_id, coalesce(nullif(t, ''), 'unnamed_file') AS filename FROM c""")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", X.sanitize_filename(F.col("url")).alias("filename"))


@query("truncate_text", """WITH c AS (SELECT doc_id, text, left(text, 197) AS h FROM documents)
SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN contains(substr(h, 2), ' ') THEN left(h, length(h) - length(string_split(h, ' ')[-1]) - 1) ELSE h END || '...' END) AS content_key FROM c""")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.truncate_at_space(F.col("text"), 200)).alias("content_key"))


@query("mask_sensitive", "SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) AS name, CASE WHEN length(c_mktsegment) <= 8 THEN repeat('*', length(c_mktsegment)) ELSE left(c_mktsegment, 4) || repeat('*', length(c_mktsegment) - 8) || right(c_mktsegment, 4) END AS segment FROM customer")
def _(spark, d):
    return t(spark, d, "customer").select("c_custkey", X.mask_middle(F.col("c_name")).alias("name"), X.mask_middle(F.col("c_mktsegment")).alias("segment"))


_RED = "text"
for _p, _r in K.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '(?i){_p}', '{_r}', 'g')"


@query("redact_secrets", f"SELECT doc_id, md5({_RED}) AS content_key, {_RED} <> text AS changed FROM documents")
def _(spark, d):
    r = X.redact_secrets(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.md5(r).alias("content_key"), (r != F.col("text")).alias("changed"))


@query("redact_nested_values", f"SELECT doc_id, md5({_RED}) AS body_key, md5({_RED.replace('(text', '(source').replace('text,', 'source,')}) AS source_key FROM documents")
def _(spark, d):
    m = QR.redact_map(F.create_map(F.lit("body"), F.col("text"), F.lit("source"), F.col("source")))
    return t(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.md5(F.col("m")["body"]).alias("body_key"), F.md5(F.col("m")["source"]).alias("source_key"))


_FIELDS = """f AS (SELECT doc_id, source, regexp_extract(text, '[^ \\n]+@[^ \\n]+', 0) AS email, regexp_extract(text, '[0-9]{7,}', 0) AS phone, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE n_chars::VARCHAR END AS size, lang, n_chars || lang AS pw FROM documents)"""


def fields(spark, d):
    """E-mail-like and phone-like strings of each text with its attributes."""
    return I.documents(spark, d).select(
        "doc_id", "source", "text", F.regexp_extract("text", r"[^ \n]+@[^ \n]+", 0).alias("email"), F.regexp_extract("text", "[0-9]{7,}", 0).alias("phone"),
        F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("size"), "lang", F.concat(F.col("n_chars").cast("string"), "lang").alias("pw"),
    )


def _checked(spark, d):
    return QR.check(fields(spark, d), [
        QR.required("text"), QR.min_length("text", 20), QR.no_xss("text"), QR.email("email"), QR.phone("phone"), QR.in_range("size", 1, 5000),
        QR.in_choices("lang", ["en", "fr", "de"]), QR.alphanumeric("source"), QR.password_strength("pw"),
    ])


_ERR = f"""{_FIELDS}, e0 AS (SELECT f.doc_id, f.source, d.text, email, phone, size, f.lang, pw FROM f JOIN documents d USING (doc_id)),
 e AS (SELECT doc_id, source, list_filter([CASE WHEN NOT regexp_matches(text, '\\S') THEN 'text:required' WHEN length(text) < 20 THEN 'text:min_length_20' WHEN regexp_matches(text, '{_XSS}') THEN 'text:xss' END,
   CASE WHEN email <> '' AND NOT regexp_matches(email, '{K.EMAIL_PATTERN}') THEN 'email:email' END, CASE WHEN phone <> '' AND NOT regexp_matches(phone, '{K.PHONE_PATTERN}') THEN 'phone:phone' END,
   CASE WHEN try_cast(size AS DOUBLE) IS NULL OR NOT try_cast(size AS DOUBLE) BETWEEN 1 AND 5000 THEN 'size:range' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang:choices' END,
   CASE WHEN NOT regexp_matches(source, '^[a-zA-Z0-9_]+$') THEN 'source:alphanumeric' END, CASE WHEN length(pw) < 6 THEN 'pw:password' END], lambda z: z IS NOT NULL) AS errors FROM e0)"""


@query("validation_errors", f"WITH {_ERR} SELECT source, error, count(*) AS rows FROM (SELECT source, unnest(errors) AS error FROM e) GROUP BY ALL")
def _(spark, d):
    return QR.error_counts(_checked(spark, d), ["source"])


@query("validation_split", f"WITH {_ERR} SELECT len(errors) AS problems, count(*) AS rows FROM e GROUP BY 1")
def _(spark, d):
    clean, rejected = QR.split_clean(_checked(spark, d))
    both = clean.select(F.lit(0).cast("bigint").alias("problems")).unionByName(rejected.select(F.size("errors").cast("bigint").alias("problems")))
    return both.groupBy("problems").agg(F.count("*").alias("rows"))


@query("length_limit", "SELECT doc_id, length(left(text, 1000)) AS chars FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(QR.limit_length(F.col("text"), 1000)).cast("bigint").alias("chars"))
