"""Host and path rules over URLs, matched through short hash prefixes.

Every URL is expanded into host-suffix + path-prefix expressions, the expressions meet the rules
on the first bytes of their digests, full digests confirm a match and the longest rule wins.
Only DataFrame functions are used.

Results for special input: a null URL or one without ``://`` has an empty host and an empty path,
and no rule fits it; rows that repeat are returned as often as they occur; null keys are kept; an
empty table gives no rows; equal rules with different verdicts resolve to ``block``. A rule's path
is a directory (it ends in ``/``) or a whole path. Columns other than the keys and the URL are not
returned, so their names may clash with anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.operators.sizes import broadcast_if

PREFIX_HEX = 8  # 32 bits of a SHA-256 digest


def url_host(url: Column) -> Column:
    return F.coalesce(
        F.translate(
            F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
        ),
        F.lit(""),
    )


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tails(parts: Column, sep: str, depth: int) -> Column:
    """The last 1 .. ``depth`` parts, joined."""
    n = F.least(F.size(parts), F.lit(depth))
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), sep),
    )


def _heads(path: Column, depth: int) -> Column:
    """``/``-ended prefixes of at most ``depth`` slashes, and the whole path."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, F.lit(depth))
    ended = F.when(
        n >= 1,
        F.transform(
            F.sequence(F.lit(1), n), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(ended, F.array(path)))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, rule_length, rule_verdict) of rules (host, path, verdict)."""
    rule = F.concat("host", "path")
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(rule.alias("rule"))
        .agg(F.max("verdict").alias("rule_verdict"))  # block sorts after allow
        .select(
            F.substring(F.sha2(F.col("rule"), 256), 1, PREFIX_HEX).alias("prefix"),
            F.sha2(F.col("rule"), 256).alias("digest"),
            "rule", F.length("rule").alias("rule_length"), "rule_verdict",
        )
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("page_id",), url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(keys, url, host, path, rule, verdict) of each row of ``pages`` under ``rules``.

    Expansion stops at the rules' own depth, so long URLs cost no more than short ones. Rules are
    broadcast only under a counted bound; beyond it the join shuffles on the hash prefix. The best
    rule of a row is found by grouping on the row itself, so no host gathers in one task.
    """
    known = prepared_rules(rules)
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(1)).alias("parts"),
    ).first()
    rows = (
        pages.select(*keys, F.col(url).alias("url"))
        .withColumn("host", url_host(F.col("url")))
        .withColumn("path", url_path(F.col("url")))
    )
    hosts = _tails(F.split("host", r"\."), ".", shape["labels"])
    heads = _heads(F.col("path"), shape["parts"])
    told = F.when(
        F.instr("url", "://") > 0,
        F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p)))),
    ).otherwise(F.array().cast("array<string>"))
    expanded = (
        rows.select("*", F.posexplode_outer(told).alias("_n", "_expression"))
        .withColumn("_digest", F.sha2(F.col("_expression"), 256))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
    )
    met = expanded.join(
        broadcast_if(known, shape["n"]),
        (F.col("_prefix") == F.col("prefix")) & (F.col("_digest") == F.col("digest")), "left",
    )
    group = list(keys) + ["url"]
    best = met.groupBy(*group).agg(
        F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.struct("rule_length", "rule", "rule_verdict")).alias("_best"),
        F.count(F.when(F.coalesce("_n", F.lit(0)) == 0, 1)).alias("_copies"),
    )
    return best.select(
        *group, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
