"""Contexts, extractive answers, prompts and answer verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X
from askloom.functions.folds import let
from askloom.operators.retrieval import group_of, rerank_rows


def merge_group_contexts(contexts: DataFrame) -> DataFrame:
    """Hits of one split group become one context, when a question met more than one group.

    Distinct parents are joined in rank order; a group with one hit keeps its own text. Contexts of
    a question are its top-k hits, so groups are short.
    """
    rows = contexts.withColumn("_g", group_of())
    body = F.coalesce(F.nullif("parent_content", F.lit("")), F.nullif("child_content", F.lit("")))
    first_of_parent = Window.partitionBy("query_id", "_g", "document_id", "parent_id").orderBy("rank")
    in_query = Window.partitionBy("query_id")
    rows = rows.withColumns(
        {
            "_n": F.row_number().over(first_of_parent), "_body": body,
            "_many": F.min("_g").over(in_query) != F.max("_g").over(in_query),
        }
    )
    # a question with a single group keeps its hits apart: its group key becomes the hit itself
    key = F.when(F.col("_many"), F.col("_g")).otherwise(F.concat("_g", F.lit("#"), F.col("rank").cast("string")))
    texts = F.transform(
        F.filter(F.array_sort(F.collect_list(F.struct("rank", "_n", "_body"))), lambda s: (s["_n"] == 1) & s["_body"].isNotNull()),
        lambda s: s["_body"],
    )
    merged = rows.groupBy("query_id", key.alias("_key")).agg(
        F.min("rank").alias("rank"), F.max("score").alias("score"), F.count("*").alias("source_count"),
        F.min_by("_g", "rank").alias("group_id"), F.array_join(texts, "\n\n---\n\n").alias("content"),
        F.min_by("child_content", "rank").alias("child_content"),
        F.min_by("source", "rank").alias("source"),
    )
    out = merged.withColumn(
        "child_content",
        F.when(F.col("source_count") > 1, F.col("content")).otherwise(F.col("child_content")),
    ).drop("_key")
    return rerank_rows(out, [F.desc("score"), "rank"])


def confidence_label(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    best = contexts.groupBy("query_id").agg(F.max("score").alias("_m"))
    return questions.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.when(F.col("_m") >= 0.6, "高").when(F.col("_m") >= 0.4, "中").otherwise("低").alias("confidence")
    )


def extractive_answers(questions: DataFrame, contexts: DataFrame, budget: int = 2000) -> DataFrame:
    """Answers out of contexts: distinct texts, 500-character snippets, a total budget.

    Input contexts (query_id, rank, content, source). The last snippet may be cut to what is left,
    if more than 50 characters are.
    """
    body = X.strip(F.coalesce("content", F.lit("")))
    first = Window.partitionBy("query_id", "_c").orderBy("rank")
    rows = (
        contexts.withColumn("_c", body).where(F.length("_c") > 0)
        .withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .withColumn("_source", F.coalesce("source", F.lit("未知来源")))
    )
    need = F.least(F.length("_c"), F.lit(500)) + F.length("_source") + 10
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("_need", need).withColumn(
        "_sum", F.sum("_need").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Sums only grow: everything up to the first overrun fits. That one may be cut short, and
    # later ones may still use what it left, so the overrun part is folded per question.
    fits = F.col("_sum") <= budget
    items = F.array_sort(F.collect_list(F.struct("rank", "_c", "_source", "_need")))
    per = rows.where(fits | (F.col("_sum") - F.col("_need") < budget)).groupBy("query_id").agg(items.alias("_i"))

    def step(acc: Column, s: Column) -> Column:
        room = F.lit(budget) - acc["used"] - F.length(s["_source"]) - 10
        snippet = F.when(
            acc["used"] + s["_need"] <= budget, F.left(s["_c"], F.lit(500))
        ).when(room > 50, F.left(s["_c"], room))
        stop = acc["stop"] | snippet.isNull()
        part = F.concat(F.lit("【来源："), s["_source"], F.lit("】\n"), snippet)
        return F.when(stop, F.struct(acc["parts"].alias("parts"), acc["used"].alias("used"), F.lit(True).alias("stop"))).otherwise(
            F.struct(
                F.concat(acc["parts"], F.array(part)).alias("parts"),
                (acc["used"] + F.length(snippet) + F.length(s["_source"]) + 10).alias("used"),
                F.lit(False).alias("stop"),
            )
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("stop"))
    built = per.select("query_id", F.aggregate("_i", start, step, lambda a: F.array_join(a["parts"], "\n\n")).alias("_a"))
    any_ctx = contexts.select("query_id").distinct().withColumn("_has", F.lit(True))
    return questions.select("query_id").join(any_ctx, "query_id", "left").join(built, "query_id", "left").select(
        "query_id",
        F.when(F.col("_has").isNull(), K.NO_CONTEXT_ANSWER)
        .otherwise(F.coalesce(F.nullif("_a", F.lit("")), F.lit(K.UNUSABLE_CONTEXT_ANSWER))).alias("answer"),
    )


def distinct_sources(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("query_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"])).alias("sources")
    )


def cacheable(answer: Column) -> Column:
    return (F.length(F.coalesce(answer, F.lit(""))) > 0) & ~X.contains_any(answer, K.NOT_FOUND_PHRASES)


def prompts(questions: DataFrame, contexts: DataFrame, history: DataFrame, model: str | None = None) -> DataFrame:
    """One prompt per question: summaries, the last six turns, numbered contexts, the task.

    ``history`` is (query_id, turn, role, content); contexts carry rank, source, score, content.
    """
    summary = F.col("role").isin("summary", "system")
    recent = Window.partitionBy("query_id").orderBy(F.desc("turn"))
    last_six = history.where(~summary).withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= K.PROMPT_TURNS).drop("_r")
    hist = last_six.unionByName(history.where(summary)).withColumn("_s", summary)
    ordered = lambda cond, text: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", text.alias("t"))))), lambda s: s["t"]), "\n"
    )
    spoken = F.concat(F.when(F.col("role") == "user", K.PROMPT_USER).otherwise(K.PROMPT_ASSISTANT), F.col("content"))
    hist = hist.groupBy("query_id").agg(
        ordered(F.col("_s"), F.col("content")).alias("_sum"), ordered(~F.col("_s"), spoken).alias("_turns"),
        F.count_if("_s").alias("_ns"), F.count_if(~F.col("_s")).alias("_nt"),
    )
    one = F.concat(
        F.lit("[来源 "), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit(K.PROMPT_UNKNOWN_SOURCE)),
        F.lit(" (相关度："), F.format_string("%.2f", F.col("score")), F.lit(")\n"), F.col("content"), F.lit(K.PROMPT_CONTEXT_END),
    )
    ctx = contexts.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda s: s["t"]), "\n").alias("_ctx")
    )
    q = F.col("question")
    rules = K.PROMPT_RULES
    if model:
        rules += K.PROMPT_MODEL_RULE.format(model=model)
    with_ctx = F.concat(
        F.lit(K.PROMPT_CONTEXT_HEAD), F.col("_ctx"), F.lit(K.PROMPT_TASK), q, F.lit("\n\n" + rules),
    )
    without = F.concat(
        F.lit(K.PROMPT_NO_CONTEXT_HEAD), q, F.lit(K.PROMPT_NO_CONTEXT_TASK),
    )
    head = F.concat(
        F.when(F.coalesce("_ns", F.lit(0)) > 0, F.concat(F.lit(K.PROMPT_SUMMARY_HEAD), F.col("_sum"), F.lit("\n\n"))).otherwise(""),
        F.when(F.coalesce("_nt", F.lit(0)) > 0, F.concat(F.lit(K.PROMPT_TURNS_HEAD), F.col("_turns"), F.lit("\n\n"))).otherwise(""),
    )
    return questions.join(hist, "query_id", "left").join(ctx, "query_id", "left").select(
        "query_id", F.concat(head, F.when(F.col("_ctx").isNotNull(), with_ctx).otherwise(without)).alias("prompt")
    )


# ------------------------------------------------------------------------------ verification
def context_coverage(answer: Column, context: Column) -> Column:
    """Share of distinct answer three-word phrases (4 characters and more) found in the context.

    CJK text has no word breaks: there every run of five characters is a phrase.
    """
    words = F.filter(
        F.split(F.regexp_replace(F.lower(answer), r"(?U)([一-鿿])", " $1 "), r"(?U)\s+"), lambda w: F.length(w) > 0
    )
    def share(ws: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ws) - 2, F.lit(1))),
            lambda i: F.when(F.size(ws) >= 3, F.array_join(F.slice(ws, i, 3), "")),
        )
        cjk = F.regexp_extract_all(F.lower(answer), F.lit("(?=([一-鿿]{5}))"), F.lit(1))
        phrases = F.array_distinct(F.concat(F.filter(grams, lambda g: F.length(g) >= 4), cjk))
        hit = F.filter(phrases, lambda g: F.lower(context).contains(g))
        return F.when(F.size(phrases) > 0, F.size(hit) / F.size(phrases)).otherwise(0.0)

    return F.when(context.isNull() | (F.length(context) == 0), 0.0).otherwise(let(words, share))


def rule_confidence(coverage: Column, cited: Column, disclaimers: Column, issues: Column, judge: Column | None = None):
    c = 0.4 + 0.6 * coverage + F.when(cited, 0.1).otherwise(0.0) - disclaimers * 0.1 - issues * 0.05
    if judge is not None:
        c = F.when(judge.isNotNull(), 0.6 * c + 0.4 * judge).otherwise(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def judge_confidence(reply: Column) -> Column:
    """Stored judge text to confidence: 0.9, 0.7, 0.4 or 0.2; an unreadable first line gives 0.2."""
    lines = F.filter(F.transform(F.split(reply, "\n"), X.strip), lambda l: F.length(l) > 0)
    bare = lambda i: X.strip(F.regexp_replace(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), "[：:]", ""))
    a, b = bare(0), bare(1)
    based = F.when(a.startswith("是") | X.contains_any(a, ["基于", "准确", "合理"]), True).when(
        a.startswith("否") | X.contains_any(a, ["不基于", "不准确"]), False
    )
    extra = F.when(b.startswith("有") | X.contains_any(b, ["包含", "超出"]), True).otherwise(False)
    return (
        F.when(based.isNull(), 0.2)
        .when(based & ~extra, 0.9).when(based, 0.7).when(~extra, 0.4).otherwise(0.2)
    )


def verify(answers: DataFrame, answer: str = "answer", context: str = "context", judge: str | None = None) -> DataFrame:
    """Adds coverage, issues, citation flag, confidence and validity.

    ``judge`` names a column of judge confidences, null where no judge ran.
    """
    a = F.col(answer)
    coverage = context_coverage(a, F.col(context))
    rows = answers.withColumn("_cov", F.round(coverage, 9))
    said = [F.when(a.contains(d), f"包含不确定表述: {d}") for d in K.DISCLAIMERS]
    j = F.col(judge) if judge else None
    issues = F.filter(
        F.array(
            *said, F.when(F.col("_cov") < 0.3, "上下文覆盖率过低"), F.when(F.length(a) < 20, "答案过短"),
            *([F.when(j < 0.5, "AI 验证不通过")] if judge else []),
        ),
        lambda i: i.isNotNull(),
    )
    rows = rows.withColumns(
        {
            "_issues": issues, "_disc": X.count_contained(a, K.DISCLAIMERS),
            "has_citation": F.coalesce(a.rlike(r"\[来源[：:]"), F.lit(False)),
        }
    )
    conf = rule_confidence(F.col("_cov"), F.col("has_citation"), F.col("_disc"), F.size("_issues"), j)
    rows = rows.withColumn("_conf", F.round(conf, 9))
    valid = F.col("_conf") >= 0.35
    if judge:
        valid = F.when(j.isNotNull(), ~((j < 0.4) & (F.col("_conf") < 0.4))).otherwise(valid)
    blank = X.is_blank(a)
    return rows.select(
        *answers.columns,
        (~blank & valid).alias("is_valid"),
        F.when(blank, 0.0).otherwise(F.round("_conf", 2)).alias("confidence"),
        F.when(blank, F.array(F.lit("答案为空"))).otherwise(F.col("_issues")).alias("issues"),
        F.when(blank, 0.0).otherwise(F.round("_cov", 2)).alias("context_coverage"),
        (~blank & F.col("has_citation")).alias("has_citation"),
    )
