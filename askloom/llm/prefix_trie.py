"""Trie of conversations by their first turns, peeled from the deepest truncations to the root.

A conversation is a row of turns. Cutting turns off its end gives its truncations; equal truncations
of any conversations are one node of the trie. The trie is peeled from the maximum depth down, a band
of depths at a time: conversations that end inside the band are merged by their whole sequence and
join the nodes that survived the band above, each held by its smallest member; turns are stripped and
the truncations regrouped by depth and prefix, which discovers the band's nodes and adds up their
members; leaves and saved tokens are summed up along each smallest member, as every node of a subtree
has its smallest member among the subtree's own. The nodes at the band's foot, grouped by parent,
survive into the next. Bands grow eightfold, so their number follows the logarithm of the longest
conversation, and no pass handles one depth alone.

A prefix is known by 128 bits: the exclusive or of hashes of (place, role, text), which blocks of a
long conversation add up apart. Texts never leave the scan, copies are merged before their turns are
shuffled, and sums of equal prefixes are combined before every shuffle; a conversation or a first turn
that holds a third of all rows is spread over tasks. Only the ids of conversations that end at one
node pass through one task, in order and as a stream, as their digest is one SHA-256.

Results for special input: rows without a conversation id belong to no conversation and are left out;
a null role or text is an empty one; turns are ordered by number, null first, equal numbers by role
and then by a hash of the text, repeated rows are turns of their own; an empty table has no nodes, not
even a root; empty and very long texts are hashed whole. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.components import stored

BLOCK = 4096  # turns of one conversation handled in one piece
FIRST_BAND = 8  # depths of the lowest band; each further one reaches eight times as deep
HEAVY = 256  # parents with over 1/HEAVY of all nodes as children are broadcast: fewer than HEAVY
IDS = 512  # conversation ids, by value, that are joined into one piece of text before hashing
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("depth", "k1", "k2")


def _running(rows: DataFrame, pos: str, values: dict[str, str], down: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each column of ``values`` becomes its running "sum" or "xor" along ``pos`` inside its conversation.

    Blocks of positions are added up apart; what the blocks before one come to is joined by the
    key that the rows are already dealt by.
    """
    agg = {"sum": F.sum, "xor": F.bit_xor}
    order = [F.desc(pos) if down else F.asc(pos), *ties]
    rows = rows.withColumn("_block", F.expr(f"{pos} div {BLOCK}"))
    before = Window.partitionBy("conv").orderBy(F.desc("_block") if down else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv", "_block").agg(*[agg[a](c).alias(f"_c_{c}") for c, a in values.items()]).select(
        "conv", "_block", *[agg[a](f"_c_{c}").over(before).alias(f"_c_{c}") for c, a in values.items()]
    )
    inside = Window.partitionBy("conv", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: agg[a](c).over(inside) for c, a in values.items()}).join(carry, ["conv", "_block"])
    both = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    return rows.withColumns(
        {c: both[a](F.col(c), F.coalesce(f"_c_{c}", F.lit(0).cast("long"))) for c, a in values.items()}
    ).drop("_block", *[f"_c_{c}" for c in values])


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, p, content, words): turns numbered from 1, role and text as one digest."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"),
        F.unhex(F.md5(F.concat(F.length(empty(role)).cast("string"), F.lit(":"), empty(role), empty(text)))).alias("content"),
        F.regexp_count(empty(text), F.lit(WORD)).cast("long").alias("words"),
    )
    rows = rows.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "content")
    return rows.withColumn("at", F.row_number().over(inside)).join(blocks, ["conv", "block"]).select(
        "conv", (F.col("offset") + F.col("at")).alias("p"), "content", "words"
    )


def ends(turns: DataFrame) -> DataFrame:
    """(conv, length) of every conversation that has a turn."""
    return turns.groupBy("conv").agg(F.max("p").alias("length"))


def share_heads(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) in which the first turns of every ``every``-th conversation stand before others' own.

    Conversation c gets the first h turns of conversation c - c % ``every`` in place of its own first
    h, where h is the unsigned CRC-32 of its decimal id modulo ``most`` + 1. A head is asked for by
    at most ``every`` conversations; lengths are joined per block of turns, so no long one is a hot key.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % (most + 1)
    base = F.col("conv") - F.col("conv") % every
    lengths = stored(ends(turns), "lengths")
    plan = lengths.select("conv", "length", base.alias("base"), h("conv").alias("h")).join(
        lengths.select(F.col("conv").alias("base"), F.col("length").alias("base_length")), "base", "left"
    ).select("conv", "base", "length", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("m"))
    plan = stored(plan, "plan")
    own = turns.withColumn("block", F.expr(f"p div {BLOCK}")).join(
        plan.select("conv", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {BLOCK}"))).alias("block")),
        ["conv", "block"],
    ).where("p > h").select("conv", (F.col("m") + F.col("p") - F.col("h")).alias("p"), "content", "words")
    heads = turns.where(F.col("p") <= most).withColumnRenamed("conv", "base").join(
        plan.where("m > 0").select("conv", "base", "m"), "base"
    ).where("p <= m").select("conv", "p", "content", "words")
    length = (F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")
    return own.unionByName(heads), plan.select("conv", length)


def _paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, words): every truncation with its prefix and that of its parent."""
    mark = lambda n: F.xxhash64(F.lit(n), "p", "content")
    rows = turns.select("conv", F.col("p").alias("depth"), "words", mark(1).alias("g1"), mark(2).alias("g2"))
    rows = rows.withColumns({"k1": F.col("g1"), "k2": F.col("g2")})
    return _running(rows, "depth", {"k1": "xor", "k2": "xor"}).select(
        "conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"), "words"
    )


def _peel(paths: DataFrame, ended: DataFrame, above: DataFrame | None, low: int, high: int) -> DataFrame:
    """The nodes of depths ``low`` < depth <= ``high``.

    ``ended`` has (conv, depth, n) of sequences that end in the band, one row each; ``above`` the nodes
    of depth ``high`` that survive from below the band, with what their subtrees came to so far.
    """
    zero = F.lit(0).cast("long")
    units = ended.select("conv", F.col("depth").alias("at"), "n", zero.alias("children"))
    if above is not None:
        units = units.unionByName(above.select("conv", F.col("depth").alias("at"), "n", "children"))
    rows = paths.where((F.col("depth") > low) & (F.col("depth") <= high)).join(units, "conv").where("depth <= at")
    rows = stored(rows.withColumn("inner", (F.col("depth") < F.col("at")) | (F.col("children") > 0)).drop("at", "children"), "rows")
    found = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("inner").alias("inner"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"),
    )
    found = stored(found, "found")
    none = F.lit(None).cast("long")
    adds = found.select("conv", "depth", none.alias("k1"), none.alias("k2"),
                        (~F.col("inner")).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")).where("leaves > 0 or saved > 0")
    if above is not None:
        adds = adds.unionByName(above.select("conv", "depth", none.alias("k1"), none.alias("k2"), "leaves", "saved"))
    line = rows.select("conv", *KEY, zero.alias("leaves"), zero.alias("saved"), F.lit(1).alias("turn"))
    line = line.unionByName(adds.withColumn("turn", F.lit(0)))
    summed = _running(line, "depth", {"leaves": "sum", "saved": "sum"}, down=True, ties=("turn",)).where("turn = 1")
    parts = summed.select(*KEY, "leaves", "saved", zero.alias("children"), none.alias("conv"), none.alias("n"), none.alias("p1"), none.alias("p2"))
    parts = parts.unionByName(found.select(*KEY, zero.alias("leaves"), zero.alias("saved"), zero.alias("children"), "conv", "n", "p1", "p2"))
    child = [zero.alias("leaves"), zero.alias("saved")]
    rest = [none.alias(c) for c in ("conv", "n", "p1", "p2")]
    below = found.where(F.col("depth") > low + 1).select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), *child, F.lit(1).cast("long").alias("children"), *rest)
    parts = parts.unionByName(below)
    if above is not None:
        parts = parts.unionByName(above.select(*KEY, *child, "children", *rest))
    return parts.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.max("n").alias("n"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )


def _survivors(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of depth ``depth``, as far as their children make them up."""
    return nodes.where(F.col("depth") == depth + 1).groupBy(F.lit(depth).cast("long").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )


def _digests(last: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ids in ``last`` (key, conv), ascending and joined by commas."""
    pieces = last.groupBy(*KEY, F.expr(f"conv div {IDS}").alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")  # under 2 * IDS of them
    )
    dealt = pieces.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY, "piece")

    def run(batches):
        now, sha = None, None

        def told(key, digest):
            return pa.RecordBatch.from_pylist([dict(zip(KEY, key, strict=True), ends_sha256=digest.hexdigest())], schema)

        schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("ends_sha256", pa.string())])
        for b in batches:
            done = []
            for *key, ids in zip(*[b.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key != now:
                    if sha:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
        if sha:
            yield told(now, sha)

    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``: the smallest member of each one's parent.

    All children of one node ask for the same row. The few nodes with more than a stated share of
    all nodes as children are broadcast, at most HEAVY rows, and the others meet their children by key.
    """
    most = max(1, -(-nodes.count() // HEAVY))
    up = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent")]
    heavy = F.broadcast(nodes.where(F.col("children") > most).select(*up))
    on = ["depth", "p1", "p2"]
    many = nodes.join(heavy, on)
    few = nodes.join(heavy, on, "left_anti").join(nodes.where(F.col("children") <= most).select(*up), on, "left")
    return many.unionByName(few)


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct truncation of the conversations of ``turns`` (conv, p, content, words).

    ``lengths`` (conv, length) names every conversation, those of length 0 too; p runs from 1 to length.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 as the module describes them.
    """
    paths = stored(_paths(turns), "paths")
    last = paths.join(lengths.where("length > 0").select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("conv", *KEY)
    root = [F.lit(0).cast("long").alias(c) for c in KEY]
    last = stored(last.unionByName(lengths.where("length = 0").select("conv", *root)), "last")
    ended = stored(last.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "ended")
    deepest = ended.agg(F.max("depth")).first()[0] or 0
    bounds = [0, FIRST_BAND]
    while bounds[-1] < deepest:
        bounds.append(bounds[-1] * 8)
    levels, above = [], None
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        nodes = stored(_peel(paths, ended.where((F.col("depth") > low) & (F.col("depth") <= high)), above, low, high), "nodes")
        levels.append(nodes)
        above = stored(_survivors(nodes, low), "above")
    turnless = ended.where("depth = 0")
    zero = F.lit(0).cast("long")
    top = above.unionByName(turnless.select("conv", "n", *KEY, *[zero.alias(c) for c in ("children", "leaves", "saved")]))
    top = top.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.sum("children").alias("children"), F.greatest(F.sum("leaves"), F.lit(1)).alias("leaves"), F.sum("saved").alias("saved"),
    )
    nodes = top
    for level in levels:
        nodes = nodes.unionByName(level)
    nodes = _with_parents(stored(nodes, "nodes")).join(_digests(last), list(KEY), "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they stand."""
    turns = stored(numbered(conversations, **columns), "turns")
    return trie(turns, ends(turns))


def shared_head_trie(conversations: DataFrame, every: int = 20, most: int = 3, **columns: str) -> DataFrame:
    """The trie of conversations rebuilt by ``share_heads``."""
    turns = stored(numbered(conversations, **columns), "turns")
    return trie(*share_heads(turns, every, most))
