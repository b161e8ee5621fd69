"""Not-modified revisits of a web archive, resolved to the full response they stand for.

A revisit (status 304) is matched, by canonical URL, with the latest full response captured before
it. Its validators are compared with that response's, and headers which a 304 may update are laid
over the stored ones.

Results for special input: a revisit with no earlier response is ``unresolved``; one whose entity
tags (or, where either tag is missing, dates) differ is ``mismatch``; one with no comparable
validator is ``unchecked``; otherwise ``resolved``. Captures at the same instant are not earlier.
Of responses at one instant the largest record id counts. A null URL matches nothing, a null
capture time is unresolved, repeated revisits are each returned, empty tables give no rows.
Header names are taken and given back in lower case; entity tags are compared weakly (``W/"x"`` is ``"x"``);
a canonical URL has http for https. Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.operators.runs import running

# Headers that a 304 response may update; all others come from the stored response.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not identify a resource.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid")
BLOCK = 3_600_000_000  # one hour of microseconds


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment, default port, tracking parameters and last slash dropped."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([^:/?#]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^:/?#]+://([^/?]*)", 1)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^:/?#]+://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
        lambda p: (F.length(p) > 0) & ~p.rlike("^(" + "|".join(TRACKING) + ")(=|$)"),
    )
    asked = F.array_join(F.array_sort(query), "&")
    return F.when(
        F.length(host) > 0,
        F.concat(
            F.when(scheme == "https", "http").otherwise(scheme), F.lit("://"), host, path,
            F.when(F.length(asked) > 0, F.concat(F.lit("?"), asked)).otherwise(""),
        ),
    )


def header(headers: Column, name: str) -> Column:
    """Value of a header in an array of (name, value), names in lower case."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the updatable ones of a 304 laid over them, by name."""
    over = F.filter(fresh, lambda h: h["name"].isin(*UPDATABLE))
    names = F.transform(over, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), over))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, captured_at, status, headers).

    Both kinds of record are merged into one time line per canonical URL and the latest response
    is carried forward in time blocks, so a URL holding a third of all captures spreads over tasks
    and no pair of captures is ever listed.
    """
    fresh = F.col("status") == 304
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured_at", "status",
        F.array_sort(F.transform(
            F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")),
            lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")),
        )).alias("headers"),
    ).where(fresh | (F.col("status") == 200))
    line = rows.where(F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()).select(
        "*", F.unix_micros("captured_at").alias("_at"), F.when(fresh, 0).otherwise(1).alias("_kind")
    )
    carried = running(
        line, ["canonical_url"], "_at",
        {"_full": ("max", F.when(~fresh, F.struct("_at", "record_id", "captured_at", "headers")))},
        block=BLOCK, ties=["_kind", "record_id"],
    ).where(fresh).select("record_id", "canonical_url", "captured_at", "headers", "_full")
    outside = rows.where(fresh & (F.col("canonical_url").isNull() | F.col("captured_at").isNull())).select(
        "record_id", "canonical_url", "captured_at", "headers",
        F.lit(None).cast(carried.schema["_full"].dataType).alias("_full"),
    )
    both = carried.unionByName(outside)
    stored = F.col("_full.headers")
    mine = F.col("headers")
    tags = [F.regexp_replace(header(h, "etag"), "^W/", "") for h in (mine, stored)]  # weak comparison
    dates = (header(mine, "last-modified"), header(stored, "last-modified"))
    state = (
        F.when(F.col("_full").isNull(), "unresolved")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), F.when(dates[0] == dates[1], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    return both.withColumn("state", state).select(
        "record_id", "canonical_url", "captured_at", "state",
        F.when(F.col("state").isin("resolved", "unchecked"), F.col("_full.record_id")).alias("response_id"),
        F.when(F.col("state").isin("resolved", "unchecked"), merged_headers(stored, mine)).alias("headers"),
    )
