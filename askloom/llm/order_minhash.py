"""Order MinHash fingerprints of documents, in DataFrame functions alone.

A text is cut into units (runs of up to 16 characters without white space; single ideographs), and
every ``K`` neighbouring units form a k-mer. k-mers are numbered by occurrence, so repetition counts.
One hash deals the numbered k-mers to ``SLOTS`` slots and orders them; each slot selects its
``PICKED`` minimal ones, puts them back into text order and hashes the tuple. Two texts agree in a
slot only where they share its k-mers in the same order, which follows edit distance. A slot that
got no k-mer borrows the next slot's tuple.

Results for special input: a null text is empty; an empty or blank text has the fingerprint of no
k-mers (all slots 0), like only to itself; fewer than ``K`` units make one k-mer; equal texts have
equal fingerprints. The next document is that with the next smaller id, after the last comes the
first, and a lone document is its own next; a null id counts as the smallest; of rows that repeat an
id the smallest text's beginning and the smallest fingerprint stand for it, and each row is returned.
An empty table gives no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.components import stored

K = 3
SLOTS = 64
PICKED = 2
LEAST_RANGES, ROWS_A_RANGE, MOST_RANGES = 64, 500_000, 4096
_NO_ID = -(2**63)
_IDEOGRAPHS = r"⺀-鿿가-힯豈-﫿"
UNIT = rf"[{_IDEOGRAPHS}]|[^\s{_IDEOGRAPHS}]{{1,16}}"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def numbered_kmers(text: Column) -> Column:
    """Array of (slot, e, pos): each k-mer's slot, its hash with its occurrence number, its place."""

    def hashed(units):
        n = F.size(units)
        return (
            F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < K, F.array(F.xxhash64(F.array_join(units, " "))))
            .otherwise(
                F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(K)]))
            )
        )

    def numbered(rows):  # rows sorted by hash, then place
        first = F.filter(
            F.transform(rows, lambda x, j: F.when((j == 0) | (x["h"] != F.get(rows, j - 1)["h"]), j)), lambda j: j.isNotNull()
        )
        return bind(
            first,
            lambda starts: F.flatten(
                F.transform(
                    starts,
                    lambda s, i: F.transform(
                        F.slice(rows, s + 1, F.coalesce(F.get(starts, i + 1), F.size(rows)) - s),
                        lambda x, o: F.struct(F.xxhash64(x["h"], o).alias("e"), x["pos"].alias("pos")),
                    ),
                )
            ),
        )

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    kmers = bind(units, hashed)
    rows = F.sort_array(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("pos"))))
    return F.transform(
        bind(rows, numbered), lambda x: F.struct(F.pmod(x["e"], F.lit(SLOTS)).alias("slot"), x["e"].alias("e"), x["pos"].alias("pos"))
    )


def order_min_hash(text: Column) -> Column:
    """Fingerprint as an array of ``SLOTS`` integers."""

    def tuples(rows):  # sorted by slot and hash: the first rows of each slot are its minimal k-mers
        return F.filter(
            F.transform(
                rows,
                lambda x, j: F.when(
                    (j == 0) | (x["slot"] != F.get(rows, j - 1)["slot"]),
                    F.struct(x["slot"].alias("slot"), _in_text_order(rows, x, j).alias("t")),
                ),
            ),
            lambda x: x.isNotNull(),
        )

    def filled(found):
        return F.when(F.size(found) == 0, F.array_repeat(F.lit(0), SLOTS)).otherwise(
            F.flatten(
                F.transform(
                    found,
                    # a tuple serves its own slot and the empty ones before it; the last serves those after it
                    lambda x, i: F.array_repeat(
                        x["t"],
                        (
                            F.when(i == F.size(found) - 1, F.lit(SLOTS - 1)).otherwise(x["slot"])
                            - F.when(i == 0, F.lit(-1)).otherwise(F.get(found, i - 1)["slot"])
                        ).cast("int"),
                    ),
                )
            )
        )

    return bind(bind(F.sort_array(numbered_kmers(text)), tuples), filled)


def _in_text_order(rows: Column, x: Column, j: Column) -> Column:
    picked = F.filter(F.slice(rows, j + 1, PICKED), lambda y: y["slot"] == x["slot"])
    ordered = F.transform(F.sort_array(F.transform(picked, lambda y: F.struct(y["pos"], y["e"]))), lambda y: y["e"])
    return F.xxhash64(ordered).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(SLOTS))


def text_form(fingerprint: Column) -> Column:
    """Fingerprint as hexadecimal text, eight digits a slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, n, next) of distinct ids (id, n): the next smaller id, the largest after the smallest.

    Ids are cut into ranges by quantiles, so each window holds one range; a range's last id looks up
    the largest id of the range below, of which there are at most ``MOST_RANGES``.
    """
    total = ids.count()
    parts = min(MOST_RANGES, max(LEAST_RANGES, total // ROWS_A_RANGE))
    cuts = sorted(set(ids.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = ids.withColumn("range", F.size(F.filter(bounds, lambda c: c < F.col("id"))))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("id").alias("top")).collect()}
    below, held = {}, max(tops.values(), default=None)
    for r in sorted(tops):
        below[r] = held if r == min(tops) else below_top
        below_top = tops[r]
    under = F.create_map(*[F.lit(x) for r, t in below.items() for x in (r, t)]) if below else F.create_map(F.lit(0), F.lit(0))
    order = Window.partitionBy("range").orderBy(F.desc("id"))
    return ranged.select("id", "n", F.coalesce(F.lead("id").over(order), under[F.col("range")].cast("long")).alias("next"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has its last third replaced by the beginning of the next document. Whole texts
    are shuffled once, on their id; the second join reads the same exchange, and what moves besides
    are beginnings of at most a third of a text, and fingerprints.
    """
    # both joins read exactly these two columns, so the exchange of the texts is made once
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = stored(rows.groupBy("id").agg(F.max(F.char_length("text")).cast("long").alias("n")), "ids")
    order = stored(next_ids(ids), "order")
    asked = order.select(F.col("next").alias("id"), F.col("id").alias("asker"), F.floor(F.col("n") / 3).alias("need"))
    starts = (
        rows.join(asked, "id").select(F.col("asker").alias("id"), F.expr("substring(text, 1, cast(need as int))").alias("start"))
        .groupBy("id").agg(F.min("start").alias("start"))
    )
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("start", F.lit(1), third))
    made = rows.join(starts, "id").select("id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    made = stored(
        made.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    order_min_hash(F.col("text")).alias("f"), order_min_hash(F.col("edited")).alias("g")),
        "fingerprints",
    )
    following = made.groupBy("id").agg(F.min("f").alias("h")).join(order.select(F.col("next").alias("id"), F.col("id").alias("asker")), "id").select(
        F.col("asker").alias("id"), "h"
    )
    return made.join(following, "id").select(
        F.when(F.col("id") != _NO_ID, F.col("id")).cast(docs.schema[key].dataType).alias(key), "n_chars", "edited_sha256", text_form(F.col("f")).alias("fingerprint"),
        text_form(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("h")).alias("near_next"),
    )
