"""Usage statistics, listings, counters, quotas, sessions, users and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.operators.runs import running


# ------------------------------------------------------------------------------ dashboards
def dashboard(question_stats: DataFrame, documents: DataFrame, users: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of totals; satisfaction in percent with one decimal, 0 without feedback."""
    one = lambda df, c: df.agg(c.alias("v")).select("v").scalar()
    fb = messages.agg(F.count("feedback").alias("n"), F.count_if(F.col("feedback") == "up").alias("up"))
    n = fb.select("n").scalar()
    up = fb.select("up").scalar()
    return question_stats.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("questions")).select(
        "questions", one(documents, F.count("*")).alias("documents"), one(users, F.count("*")).alias("users"),
        n.alias("feedback"), F.coalesce(F.round(up * 100.0 / F.nullif(n, F.lit(0)), 1), F.lit(0.0)).alias("satisfaction"),
    )


def popular_questions(question_stats: DataFrame, n: int = 10) -> DataFrame:
    return question_stats.orderBy(F.desc("count"), "content").limit(n)


def with_bar_share(counts: DataFrame) -> DataFrame:
    """Each count over the largest one. The maximum is a scalar aggregate, not a global window."""
    top = counts.agg(F.greatest(F.coalesce(F.max("count"), F.lit(1)), F.lit(1)).alias("m")).select("m").scalar()
    return counts.withColumn("share", F.col("count") / top)


# ------------------------------------------------------------------------------ counters
def count_questions(asked: DataFrame, text: str = "content", at: str = "asked_at") -> DataFrame:
    """(content, count, created_at, updated_at) of trimmed texts."""
    return asked.groupBy(X.strip(F.col(text)).alias("content")).agg(
        F.count("*").alias("count"), F.min(at).alias("created_at"), F.max(at).alias("updated_at")
    )


def merge_counters(current: DataFrame, increments: DataFrame) -> DataFrame:
    """Upsert: counts add up, the first creation and the last update win."""
    a, b = current.alias("a"), increments.alias("b")
    return a.join(b, F.col("a.content") == F.col("b.content"), "full_outer").select(
        F.coalesce("a.content", "b.content").alias("content"),
        (F.coalesce("a.count", F.lit(0)) + F.coalesce("b.count", F.lit(0))).alias("count"),
        F.least("a.created_at", "b.created_at").alias("created_at"),
        F.greatest("a.updated_at", "b.updated_at").alias("updated_at"),
    )


def collapse_trimmed(stats: DataFrame) -> DataFrame:
    """Rows equal after trimming become one: smallest id, summed count, first and last time."""
    return stats.groupBy(X.strip(F.col("content")).alias("content")).agg(
        F.min("id").alias("id"), F.sum("count").alias("count"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )


# ------------------------------------------------------------------------------ listings
def search(df: DataFrame, term: str, fields: list[str]) -> DataFrame:
    """Rows whose fields contain the term in any case; % and _ are plain characters."""
    escaped = term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return df.where(reduce(lambda a, b: a | b, [F.col(f).ilike(f"%{escaped}%") for f in fields]))


def page(
    df: DataFrame, number: int = 1, size: int = 20, filters: dict | None = None, term: str | None = None,
    fields: list[str] | None = None, sort: str | None = None, descending: bool = True, tie: str = "id",
) -> DataFrame:
    """One page of rows with total, pages, has_next and has_prev.

    Sorting uses the given column, else created_at or id. Rows are cut by offset and limit, which
    only moves (offset + limit) rows per task to the driver side of the sort.
    """
    rows = df
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name).isin(value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    if term:
        rows = search(rows, term, fields or [])
    key = sort or ("created_at" if "created_at" in df.columns else tie)
    order = (F.desc if descending else F.asc)(key)
    total = rows.agg(F.count("*").alias("n")).select("n").scalar()
    cut = rows.orderBy(order, tie).offset((number - 1) * size).limit(size)
    return cut.withColumns(
        {
            "total": total, "pages": F.ceil(total / size).cast("bigint"),
            "has_next": F.lit(number) < F.ceil(total / size), "has_prev": F.lit(number > 1),
        }
    )


def fetch_in_order(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows for an id list (pos, key), in its order and with its repeats."""
    return ids.join(df, key).orderBy("pos")


def get_or_create(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and, marked ``created``, wanted rows whose key is new (first of each key)."""
    new = wanted.dropDuplicates(keys).join(current, keys, "left_anti")
    return current.withColumn("created", F.lit(False)).unionByName(
        new.select(*current.columns).withColumn("created", F.lit(True))
    )


def update_by_id(current: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(updated table, updates whose id is missing); null update values leave the old value."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in updates.columns if c != key])
    merged = current.join(u, key, "left").select(
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in u.columns else F.col(c) for c in current.columns]
    )
    return merged, updates.join(current, key, "left_anti")


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return sessions.join(counts, sessions["id"] == counts["session_id"], "left").select(
        sessions["*"], F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count")
    )


def transcript(messages: DataFrame) -> DataFrame:
    """User and assistant turns with their JSON columns decoded; bad JSON gives null."""
    return messages.where(F.col("role").isin("user", "assistant")).withColumns(
        {
            "sources": F.from_json("sources", "array<string>"),
            "token_usage": F.from_json("token_usage", "input_tokens bigint, output_tokens bigint, total_tokens bigint"),
        }
    )


def login_records(log: DataFrame, user_id=None, success=None, start=None, end=None) -> DataFrame:
    """Filters that reach the scan; each one is optional."""
    out = log
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    if success is not None:
        out = out.where(F.col("success") == success)
    if start is not None:
        out = out.where(F.col("login_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("login_time") <= F.lit(end).cast("timestamp_ntz"))
    return out


def retain_days(log: DataFrame, at: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows young enough, one row with the number removed)."""
    cutoff = now - F.make_interval(days=F.lit(days))
    kept = F.col(at) >= cutoff
    return log.where(kept), log.agg(F.count_if(~kept).alias("removed"))


def announcement_for(users: DataFrame, announcements: DataFrame, seen: DataFrame) -> DataFrame:
    """Latest active announcement per user; a show-once one only if the user has not seen it."""
    latest = announcements.where("is_active").agg(F.max_by(F.struct("id", "title", "show_once"), F.struct("created_at", "id")).alias("a"))
    a = latest.select("a").scalar()
    rows = users.select("user_id", a.getField("id").alias("announcement_id"), a.getField("title").alias("title"), a.getField("show_once").alias("_once"))
    rows = rows.where("announcement_id is not null")
    hidden = rows.where("_once").join(seen, ["user_id", "announcement_id"], "left_semi")
    return rows.join(hidden.select("user_id"), "user_id", "left_anti").drop("_once")


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupingSets([[F.col("status")], [F.col("review_status")]], "status", "review_status").agg(
        F.count("*").alias("documents")
    )


# ------------------------------------------------------------------------------ quotas and sessions
def daily_quota(requests: DataFrame, limits: DataFrame, at: str = "asked_at") -> DataFrame:
    """Adds ``accepted``: the n-th request of a user's day passes while n ≤ limit; admins always pass.

    ``limits`` is (user_id, role, max_per_day), 0 blocks. Rejected requests do not use the quota, so
    the first ``limit`` requests of a day are exactly the accepted ones.
    """
    rows = requests.withColumns({"_day": F.to_date(at), "_us": F.unix_micros(F.col(at).cast("timestamp"))})
    # counted in hours of the day, so one very busy user does not end up in one task
    rows = running(
        rows, ["user_id", "_day"], "_us", {"_n": ("sum", F.lit(1))}, block=3_600_000_000, ties=["request_id"]
    ).join(limits, "user_id", "left")
    return rows.withColumn(
        "accepted", F.coalesce((F.col("role") == "admin") | (F.col("_n") <= F.col("max_per_day")), F.lit(False))
    ).select(*requests.columns, "accepted")


def live_sessions(logins: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``valid``: the request's session is the latest one its user logged in with."""
    last = logins.groupBy("user_id").agg(F.max_by("session_id", F.struct("login_time", "session_id")).alias("_current"))
    return requests.join(last, "user_id", "left").withColumn(
        "valid", F.coalesce(F.col("session_id") == F.col("_current"), F.lit(False))
    ).drop("_current")


def login_decisions(attempts: DataFrame, users: DataFrame, login_enabled: bool = True) -> DataFrame:
    """Adds the outcome of each attempt; ``password_ok`` comes from the log."""
    u = users.select("user_id", "role", "is_active", "pending_approval", "approval_status", "ban_until")
    known = F.col("role").isNotNull()
    return attempts.join(u, "user_id", "left").withColumn(
        "outcome",
        F.when(known & (F.col("role") != "admin") & F.lit(not login_enabled), "closed")
        .when(~known | ~F.col("password_ok"), "bad password")
        .when((F.col("role") == "teacher") & F.col("pending_approval"), "pending")
        .when(F.col("approval_status") == "rejected", "rejected")
        .when(~F.col("is_active"), "disabled")
        .when(F.col("ban_until") > F.col("at"), "banned")
        .otherwise("ok"),
    ).select(*attempts.columns, "outcome")


def moderate_users(decisions: DataFrame, users: DataFrame, carry: list[str] = []) -> DataFrame:
    """User state after each decision, with reject reasons.

    Decisions are (user_id, action, new_max_questions, new_max_uploads, new_ban_until) and ``carry``.
    """
    rows = decisions.join(users, "user_id", "left")
    act, role = F.col("action"), F.col("role")
    reason = (
        F.when(role.isNull(), "unknown user")
        .when(act.isin("limit", "ban") & (role == "admin"), "admins are exempt")
        .when(act.isin("approve", "reject") & (role != "teacher"), "not a teacher")
        .when(act.isin("approve", "reject") & ~F.col("pending_approval"), "already reviewed")
    )
    ok = reason.isNull()
    uploads = F.when(role == "student", F.lit(0)).otherwise(F.coalesce("new_max_uploads", "max_uploads_per_day"))
    return rows.select(
        *carry, "user_id", "action", reason.alias("reject_reason"),
        F.when(ok & (act == "limit"), F.coalesce("new_max_questions", "max_questions_per_day")).otherwise(F.col("max_questions_per_day")).alias("max_questions_per_day"),
        F.when(ok & (act == "limit"), uploads).otherwise(F.col("max_uploads_per_day")).alias("max_uploads_per_day"),
        F.when(ok & (act == "ban"), F.col("new_ban_until")).when(ok & (act == "unban"), F.lit(None)).otherwise(F.col("ban_until")).alias("ban_until"),
        F.when(ok & (act == "approve"), "approved").when(ok & (act == "reject"), "rejected").otherwise(F.col("approval_status")).alias("approval_status"),
    )


def attach_feedback(feedback: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Last up/down vote of the owner per message: (message_id, feedback)."""
    valid = feedback.where(F.col("value").isin("up", "down"))
    own = valid.join(messages.select("message_id", "session_id"), "message_id").join(
        sessions.select(F.col("id").alias("session_id"), "user_id"), ["session_id", "user_id"], "left_semi"
    )
    return own.groupBy("message_id").agg(F.max_by("value", F.struct("at", "value")).alias("feedback"))


def duplicate_accounts(registrations: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``taken``: user name or e-mail already in use. Two equi-joins instead of one OR."""
    by = lambda c: registrations.join(users.select(c).distinct(), c, "left_semi").select("registration_id")
    taken = by("username").union(by("email")).distinct().withColumn("taken", F.lit(True))
    return registrations.join(taken, "registration_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


# ------------------------------------------------------------------------------ settings and models
def settings_with_defaults(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """One row per known key: the stored value or the default."""
    spark = settings.sparkSession
    known = spark.createDataFrame(list(defaults.items()), "setting_key string, default_value string")
    return known.join(settings.select("setting_key", "setting_value"), "setting_key", "left").select(
        "setting_key", F.coalesce("setting_value", "default_value").alias("setting_value")
    )


def feature_status(settings: DataFrame, models: DataFrame) -> DataFrame:
    """One row of feature flags from settings and the active models."""
    defaults = {
        "query_expansion_enabled": "false", "answer_verification_enabled": "false",
        "conversation_summary_enabled": "true", "reranking_enabled": "true",
    }
    on = {k: F.coalesce(F.max(F.when(F.col("setting_key") == k, F.col("setting_value"))), F.lit(v)) == "true" for k, v in defaults.items()}
    flags = settings.agg(*[c.alias(k) for k, c in on.items()])
    active = models.agg(
        F.count_if(F.col("is_active") & (F.col("model_type") == "llm")).alias("m"),
        F.count_if(F.col("is_active") & (F.col("model_type") == "reranker")).alias("r"),
    )
    m, r = active.select("m").scalar() > 0, active.select("r").scalar() > 0
    return flags.select(
        "*", m.alias("llm_available"), r.alias("rerank_api_available"),
        (F.col("query_expansion_enabled") & m).alias("query_expansion_active"),
        (F.col("answer_verification_enabled") & m).alias("answer_verification_active"),
        (F.col("conversation_summary_enabled") & m).alias("conversation_summary_active"),
    )


def activate_models(models: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exclusive activation: in each type with a choice only the chosen model is active."""
    c = chosen.select("model_type", F.col("id").alias("_chosen"))
    return models.join(c, "model_type", "left").withColumn(
        "is_active", F.when(F.col("_chosen").isNotNull(), F.col("id") == F.col("_chosen")).otherwise(F.col("is_active"))
    ).drop("_chosen")


def model_invariants(models: DataFrame) -> DataFrame:
    """Per type: active models (at most one is right) and repeated names."""
    names = models.groupBy("model_type", "model_name").agg(F.count("*").alias("_n"), F.count_if("is_active").alias("_a"))
    return names.groupBy("model_type").agg(
        F.sum("_a").alias("active"), F.count_if(F.col("_n") > 1).alias("repeated_names"), F.sum("_n").alias("models"),
    ).withColumn("ok", (F.col("active") <= 1) & (F.col("repeated_names") == 0))


# ------------------------------------------------------------------------------ reviews
def review(decisions: DataFrame, documents: DataFrame, carry: list[str] = []) -> DataFrame:
    """Outcome of each decision (document_id, action, reason) and the document state after it."""
    rows = decisions.join(documents.select("document_id", "review_status", "status"), "document_id", "left")
    error = (
        F.when(F.col("review_status").isNull(), K.REVIEW_UNKNOWN)
        .when(F.col("review_status") != "pending", K.REVIEW_DONE)
        .when((F.col("action") == "reject") & (F.coalesce("reason", F.lit("")) == ""), K.REVIEW_REASON_MISSING)
        .when(~F.col("action").isin("approve", "reject"), K.REVIEW_BAD_ACTION)
    )
    ok = error.isNull()
    return rows.select(
        *carry, "document_id", "action", error.alias("error"), ok.alias("success"),
        F.when(ok & (F.col("action") == "approve"), "approved").when(ok, "rejected").otherwise(F.col("review_status")).alias("review_status"),
        F.when(ok & (F.col("action") == "approve"), "processing").when(ok, "failed").otherwise(F.col("status")).alias("status"),
    )


def batch_outcome(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Success and failure counts with the number of each error, per batch.

    A batch can be large, so ids stay in the outcome table and only counts are gathered.
    """
    per_error = outcomes.groupBy(*by, "error").agg(F.count("*").alias("n"))
    return per_error.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("succeeded"),
        F.coalesce(F.sum(F.when(F.col("error").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("error", "n"))))).alias("errors"),
    )


def pending_queue(documents: DataFrame) -> DataFrame:
    return documents.where("review_status = 'pending'").orderBy("created_at", "document_id")


def my_documents(documents: DataFrame) -> DataFrame:
    """Each uploader's documents with their position, newest first."""
    rows = documents.withColumn("_us", F.unix_micros(F.col("created_at").cast("timestamp")))
    month = 30 * 86_400_000_000
    out = running(
        rows, ["uploaded_by"], "_us", {"position": ("sum", F.lit(1).cast("bigint"))}, descending=True, block=month, ties=["document_id"]
    )
    return out.drop("_us")
