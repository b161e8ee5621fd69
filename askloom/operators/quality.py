"""Data-quality rules: per-row first error, counts by rule, clean and rejected rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions import text as X


@dataclass(frozen=True)
class Rule:
    """A named error and the condition that raises it."""

    field: str
    name: str
    bad: Column


def _s(field: str) -> Column:
    return F.col(field).cast("string")


def _filled(field: str) -> Column:
    return ~X.is_blank(_s(field))


def required(field: str) -> Rule:
    return Rule(field, "required", X.is_blank(_s(field)))


def min_length(field: str, n: int) -> Rule:
    return Rule(field, f"min_length_{n}", F.length(_s(field)) < n)


def alphanumeric(field: str) -> Rule:
    return Rule(field, "alphanumeric", ~_s(field).rlike("^[a-zA-Z0-9_]+$"))


def no_xss(field: str) -> Rule:
    return Rule(field, "xss", X.has_xss(_s(field)))


def email(field: str) -> Rule:
    return Rule(field, "email", _filled(field) & ~X.strip(_s(field)).rlike(K.EMAIL_PATTERN))


def phone(field: str) -> Rule:
    return Rule(field, "phone", _filled(field) & ~X.strip(_s(field)).rlike(K.PHONE_PATTERN))


def in_range(field: str, low: float, high: float) -> Rule:
    n = F.try_cast(F.col(field), "double") if hasattr(F, "try_cast") else F.col(field).try_cast("double")
    return Rule(field, "range", F.col(field).isNotNull() & (n.isNull() | ~n.between(low, high)))


def in_choices(field: str, choices: list) -> Rule:
    return Rule(field, "choices", ~F.col(field).isin(choices))


def password_strength(field: str) -> Rule:
    return Rule(field, "password", F.length(_s(field)) < 6)


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``errors``: for each field its first failing rule, as ``field:rule``."""
    by_field: dict[str, list[Rule]] = {}
    for r in rules:
        by_field.setdefault(r.field, []).append(r)
    firsts = [
        F.coalesce(*[F.when(F.coalesce(r.bad, F.lit(False)), f"{field}:{r.name}") for r in rs])
        for field, rs in by_field.items()
    ]
    return df.withColumn("errors", F.filter(F.array(*firsts), lambda e: e.isNotNull()))


def error_counts(checked: DataFrame, by: list[str]) -> DataFrame:
    return checked.select(*by, F.explode("errors").alias("error")).groupBy(*by, "error").agg(F.count("*").alias("rows"))


def split_clean(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.size("errors") == 0
    return checked.where(good).drop("errors"), checked.where(~good)


def limit_length(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def redact_map(values: Column) -> Column:
    """Secrets removed from every value of a string map."""
    return F.transform_values(values, lambda _, v: X.redact_secrets(v))


def redact_list(values: Column) -> Column:
    return F.transform(values, X.redact_secrets)
