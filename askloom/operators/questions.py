"""Question understanding: intent, strategy, canned replies, synonym expansion, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X


def is_chat(question: Column) -> Column:
    q = X.strip(F.lower(question))
    return X.contains_any(q, K.CHAT_KEYWORDS) | q.rlike(X.any_of(K.CHAT_PATTERNS))


def _score(q: Column, words: list[str], bonus: Column) -> Column:
    return F.least(
        X.count_contained(q, words) * 0.3 + F.when(bonus, 0.2).otherwise(0.0), F.lit(1.0)
    )


def classify(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds intent, confidence and the retrieval strategy of that intent."""
    q = X.strip(F.lower(F.col(text)))
    fact = _score(q, K.FACT_KEYWORDS, F.length(q) < 15)
    process = _score(q, K.PROCESS_KEYWORDS, X.contains_any(q, K.PROCESS_BONUS_WORDS))
    policy = _score(q, K.POLICY_KEYWORDS, X.contains_any(q, K.POLICY_BONUS_WORDS))
    best = F.greatest("_f", "_r", "_p")
    return with_strategy(
        questions.withColumns({"_f": fact, "_r": process, "_p": policy, "_c": is_chat(F.col(text))})
        .withColumns(
            {
                "intent": F.when(F.col("_c"), "chat")
                .when(best < 0.3, "unknown")
                .when(F.col("_f") == best, "fact")
                .when(F.col("_r") == best, "process")
                .otherwise("policy"),
                "confidence": F.when(F.col("_c"), 0.95)
                .when(best < 0.3, 0.5)
                .otherwise(F.round(best, 2)),
            }
        )
        .drop("_f", "_r", "_p", "_c")
    )


def with_strategy(df: DataFrame) -> DataFrame:
    """Strategy columns for each ``intent``; the five-row lookup is folded into the projection."""
    pick = lambda i: F.coalesce(
        F.element_at(
            F.create_map(*[F.lit(x) for kv in K.STRATEGIES.items() for x in (kv[0], kv[1][i])]),
            F.col("intent"),
        ),
        F.lit(K.STRATEGIES["unknown"][i]),
    )
    return df.withColumns(
        {
            "strategy_top_k": pick(0).cast("bigint"),
            "use_expansion": pick(1),
            "require_high_confidence": pick(2),
            "direct_answer": pick(3),
        }
    )


def canned_reply(question: Column) -> Column:
    q = F.lower(question)
    reply = F.when(F.lit(False), "")
    for words, answer in K.CHAT_REPLIES[:-1]:
        reply = reply.when(X.contains_any(q, words), answer)
    return reply.otherwise(K.CHAT_REPLIES[-1][1])


def expansions(question: Column, synonyms: dict[str, list[str]] | None = None, limit: int = K.MAX_SYNONYMS):
    """Synonyms to add, in map order; one reached from two keys appears twice."""
    table = K.SYNONYMS if synonyms is None else synonyms
    parts = [
        F.when(
            question.contains(key),
            F.filter(F.array(*[F.lit(w) for w in words[:limit]]), lambda w: ~question.contains(w)),
        ).otherwise(F.array().cast("array<string>"))
        for key, words in table.items()
    ]
    return F.concat(*parts)


def expand(question: Column, synonyms: dict[str, list[str]] | None = None, limit: int = K.MAX_SYNONYMS):
    return F.array_join(F.concat(F.array(question), expansions(question, synonyms, limit)), " ")


def parse_keyword_list(response: Column, limit: int = 3) -> Column:
    """Keywords of a stored model response (commas, enumeration commas, new lines)."""
    parts = F.transform(F.split(response, r"[，,、\n]+"), X.strip)
    return F.slice(F.filter(parts, lambda p: F.length(p) > 0), 1, limit)


def admission(questions: DataFrame, users: DataFrame, text: str = "question") -> DataFrame:
    """Adds ``reject_reason`` (null when admitted); questions carry user_id and asked_at."""
    q = F.col(text)
    return questions.join(
        users.select("user_id", "is_active", "ban_until"), "user_id", "left"
    ).withColumn(
        "reject_reason",
        F.when(X.is_blank(q), "blank")
        .when(F.length(q) > K.MAX_QUESTION_CHARS, "too long")
        .when(~F.coalesce(F.col("is_active"), F.lit(False)), "disabled")
        .when(F.col("ban_until") > F.col("asked_at"), "banned"),
    )
