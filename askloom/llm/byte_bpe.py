"""Byte-level BPE: pre-tokenisation by class arrays and function scans, cached pair merging, decoding.

A text becomes an array of code-point classes. Each class is a transition function of a small
automaton; functions compose, composition is associative, and a prefix scan over blocks gives the
state before every code point at once, from which piece boundaries follow. No regular expression
runs. The pieces tile the text's bytes, equal pieces are encoded once, and the pair merges of all
new pieces go forward together as one matrix.

Results for special input: a null or empty text has no ids; text is never altered (special tokens'
strings are ordinary text), so decoding returns its bytes; rows that repeat are each encoded; an
empty table gives no rows; columns besides those named are not returned.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import textbytes as B

CACHE = 150_000  # pieces a worker remembers at least, once it has met them
STORE = 4_000_000  # ids a worker holds before it lets go of the older pieces
WIDTHS = (4, 8, 16, 48)  # pieces of up to so many bytes are merged in one matrix
SLICE_TEXT = 1 << 20  # bytes of text encoded at once
SLICE_IDS = 1 << 17  # ids decoded at once
WIDEST = WIDTHS[-1]  # longer pieces are merged alone
NONE = np.int32(2**31 - 1)

# Classes of code points, the last four by what follows them.
LETTER, NUMBER, OTHER, GAP, LEADING_SPACE, LAST_GAP, SHORT_FORM, LONG_FORM = range(8)
# States: what the next code point could still join.
CUT, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_GAP, ONE_LEFT, TWO_LEFT = range(8)
# Letters after an apostrophe that make a piece of their own.
SHORT_FORMS = ("s", "t", "m", "d")
LONG_FORMS = ("re", "ve", "ll")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _after(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece begins at it."""
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (CUT if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind == OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_SPACE)
    if kind in (SHORT_FORM, LONG_FORM):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_LEFT if kind == SHORT_FORM else TWO_LEFT), True
    if kind == GAP:
        return IN_GAP, state != IN_GAP
    return (AFTER_SPACE if kind == LEADING_SPACE else CUT), True


@functools.cache
def _automaton():
    """Begins[state, class]; the functions of classes, at a text's start too; all their compositions."""
    begins = np.array([[_after(s, k)[1] for k in range(8)] for s in range(8)])
    plain = [tuple(_after(s, k)[0] for s in range(8)) for k in range(8)]
    first = [(_after(CUT, k)[0],) * 8 for k in range(8)]  # forgets what came before
    known = {tuple(range(8)): 0}
    for f in plain + first:
        known.setdefault(f, len(known))
    done, todo = [], list(known)
    while todo:
        f = todo.pop()
        done.append(f)
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
    every = list(known)
    then = np.array([[known[tuple(g[x] for x in f)] for g in every] for f in every], np.int32)
    apply = np.array(every, np.int8)
    return begins, np.array([known[f] for f in plain + first], np.int32), then, apply


def prefix_scan(functions: np.ndarray, then: np.ndarray, width: int = 512) -> np.ndarray:
    """Composition of all functions up to and including each place: inside blocks, then over blocks."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = then[out[i - 1], out[i]]
        return out
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, np.int32)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    flat, k = then.ravel(), then.shape[1]
    for c in range(1, width):
        grid[c] = flat[grid[c - 1] * k + grid[c]]
    before = np.zeros(blocks, np.int32)
    before[1:] = prefix_scan(grid[-1], then, width)[:-1]
    return flat[before[None, :] * k + grid].T.ravel()[:n]


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.int8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = GAP
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of a code-point array at which pieces begin; ``first`` marks the texts' first places."""
    begins, number, then, apply = _automaton()
    kind = _classes()[points]
    n = len(points)
    ahead = np.full(n, -1, np.int8)  # the next class inside the text
    ahead[:-1] = np.where(first[1:], -1, kind[1:])
    gap = kind == GAP
    stops = gap & (ahead != GAP) & (ahead >= 0)
    kind[stops] = np.where(points[stops] == 32, LEADING_SPACE, LAST_GAP)
    for at in np.flatnonzero(points == 39):
        room = int(np.argmax(first[at + 1 : at + 3])) if first[at + 1 : at + 3].any() else min(2, n - at - 1)
        told = "".join(map(chr, points[at + 1 : at + 1 + room]))
        if told[:1] in SHORT_FORMS and told:
            kind[at] = SHORT_FORM
        elif told in LONG_FORMS:
            kind[at] = LONG_FORM
    states = apply[prefix_scan(number[kind + 8 * first], then), CUT]
    before = np.full(n, CUT, np.int8)
    before[1:] = np.where(first[1:], CUT, states[:-1])
    return np.flatnonzero(begins[before, kind] | first)


class Merges:
    """Ranks of a byte-level vocabulary, asked with many pieces at once."""

    def __init__(self, tokens: dict[bytes, int]):
        self.ids = tokens
        self.byte = np.array([tokens[bytes([i])] for i in range(256)], np.int32)
        left, right, made = [], [], []
        for t, r in tokens.items():
            for i in range(1, len(t)):
                a, b = tokens.get(t[:i]), tokens.get(t[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left_over):  # the first key that reaches a free slot has it, the others move on
            at = slot[left_over]
            free = self.keys[at] == -1
            took = np.unique(np.where(free, at, -1), return_index=True)
            chosen = took[1][took[0] >= 0]
            self.keys[at[chosen]] = keys[left_over[chosen]]
            self.made[at[chosen]] = np.array(made, np.int32)[left_over[chosen]]
            left_over = np.delete(left_over, chosen)
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.cache: dict[bytes, int] = {}
        self.store, self.used = np.zeros(0, np.int32), 0
        self.starts_at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = max(tokens.values()) + 1
        self.lengths = np.zeros(top, np.int64)
        for t, r in tokens.items():
            self.lengths[r] = len(t)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        table = bytearray(int(self.starts[-1]))
        for t, r in tokens.items():
            table[self.starts[r] : self.starts[r] + len(t)] = t
        self.bytes = np.frombuffer(bytes(table), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (B.mix(keys.view(np.uint64), 21) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair's merge, or ``NONE``."""
        out = np.full(len(a), NONE, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[open_].astype(np.int64) << 32 | b[open_]
        slot = self._slot(keys)
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.keys[slot]
            hit = found == keys
            out[open_[hit]] = self.made[slot[hit]]
            more = ~hit & (found != -1)
            open_, keys = open_[more], keys[more]
            slot = (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per piece): the lowest-ranked leftmost pair of each merges, step by step, together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts, counts, order = [np.zeros(0, np.int32)], np.zeros(len(pieces), np.int64), []
        low = 2
        for high in WIDTHS:
            rows = np.flatnonzero((sizes >= low) & (sizes <= high))
            if len(rows):
                flat, counts[rows] = self._matrix([pieces[i] for i in rows], high)
                parts.append(flat)
                order.append(rows)
            low = high + 1
        rows = np.flatnonzero(sizes > WIDEST)
        for i in rows:
            parts.append(self._long(pieces[i]))
            counts[i] = len(parts[-1])
        order = np.concatenate([*order, rows]).astype(np.int64)
        flat, ends = np.concatenate(parts), np.zeros(len(pieces), np.int64)
        ends[order] = np.cumsum(counts[order])
        return flat[ranges(ends - counts, counts)], counts

    def _matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces)
        raw = np.array(pieces, f"S{width}").view(np.uint8).reshape(n, width)
        held = np.fromiter(map(len, pieces), np.int64, n)
        m = np.where(np.arange(width) < held[:, None], self.byte[raw], -1).astype(np.int32)
        ranks = self.pair(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, width - 1)
        live, columns = np.arange(n), np.arange(width)
        while len(live):
            r = ranks[live]
            best = r.argmin(axis=1)
            least = r[np.arange(len(live)), best]
            going = least != NONE
            live, best, least = live[going], best[going], least[going]
            if not len(live):
                break
            take = np.minimum(columns + (columns > best[:, None]), width - 1)
            part = np.take_along_axis(m[live], take, axis=1)
            part[:, -1] = -1
            part[np.arange(len(live)), best] = least
            m[live] = part
            old = np.take_along_axis(ranks[live], np.minimum(take[:, :-1], width - 2), axis=1)
            old[:, -1] = NONE
            rows = np.arange(len(live))
            old[rows, np.minimum(best, width - 2)] = self.pair(part[rows, best], part[rows, np.minimum(best + 1, width - 1)])
            has = best > 0
            old[rows[has], best[has] - 1] = self.pair(part[rows[has], best[has] - 1], part[rows[has], best[has]])
            ranks[live] = old
        return m[m >= 0], (m >= 0).sum(axis=1)

    def _long(self, piece: bytes) -> np.ndarray:
        """One long piece: linked symbols, pairs taken from a heap by (rank, place)."""
        import heapq

        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        text = [bytes([c]) for c in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := self.ids.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if text[i] is not None else n
            if text[i] != a or j >= n or text[j] != b:
                continue
            text[i], ids[i], text[j] = a + b, r, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := self.ids.get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (q, i, text[i], text[after[i]]))
            if before[i] >= 0 and (q := self.ids.get(text[before[i]] + text[i])) is not None:
                heapq.heappush(heap, (q, before[i], text[before[i]], text[i]))
        return np.array([x for x, t in zip(ids, text, strict=True) if t is not None], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(store, starts, sizes): the ids of piece i are store[starts[i]:starts[i] + sizes[i]].

        The store holds the ids of all pieces met, end to end; the dictionary has each piece's number in it.
        """
        if len(self.cache) > 2 * CACHE or self.used > STORE:
            self._forget()
        get, known = self.cache.get, self.ids.get
        number = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        new = [pieces[i] for i in missing]
        whole = np.fromiter((known(p, -1) for p in new), np.int64, len(new))
        hard = np.flatnonzero(whole < 0)
        flat, counts = self.merged([new[i] for i in hard])
        sizes = np.ones(len(new), np.int64)
        sizes[hard] = counts
        starts = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[starts[whole >= 0]] = whole[whole >= 0]
        ids[ranges(starts[hard], counts)] = flat
        first = len(self.sizes)
        number[missing] = np.arange(first, first + len(new))
        self.store = _grown(self.store, self.used, ids)
        self.starts_at = np.concatenate((self.starts_at, self.used + starts))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(ids)
        self.cache.update((p, first + i) for i, p in enumerate(new) if len(p) <= WIDEST)
        return self.store, self.starts_at[number], self.sizes[number]

    def _forget(self) -> None:
        """Keeps the later half of the pieces held, and their ids alone."""
        kept = list(self.cache.items())[-CACHE:]
        number = np.fromiter((n for _, n in kept), np.int64, len(kept))
        self.store, self.sizes = self.store[ranges(self.starts_at[number], self.sizes[number])], self.sizes[number]
        self.starts_at, self.used = np.cumsum(self.sizes) - self.sizes, len(self.store)
        self.cache = {p: i for i, (p, _) in enumerate(kept)}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])]


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind its first ``used`` places, in twice the room where it is too small."""
    if used + len(more) > len(held):
        held = np.concatenate((held[:used], np.empty(used + 2 * len(more), np.int32)))
    held[used : used + len(more)] = more
    return held


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated index ranges starts[i] .. starts[i] + lengths[i] - 1."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ids of a tokenizer's JSON file, its printable stand-ins turned back into bytes."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["content"] for t in held.get("added_tokens", [])}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(back[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file and their ids: found in a text, each is its one id."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


_HELD: dict = {}


def shared(df: DataFrame, tokens: dict[bytes, int]):
    """The vocabulary as a broadcast under a name of its own; it does not grow with the data."""
    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tokens))


def _merges(held) -> Merges:
    """The worker's table for a broadcast vocabulary, made once."""
    name, tokens = held.value
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Merges(tokens)
    return _HELD[name]


def encode_slice(batch: pa.RecordBatch, column: str, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, and each text's offset into them."""
    data, off = B.utf8(batch.column(column))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = at[piece_starts(points, first[at])]
    edges = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    codes = np.asarray(pieces.indices).astype(np.int64)
    flat, places, sizes = merges.encode(pieces.dictionary.to_pylist())
    ids = flat[ranges(places[codes], sizes[codes])]
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))
    return ids, ends[np.searchsorted(starts, off)]


def encode_added(batch: pa.RecordBatch, column: str, merges: Merges, added: dict[str, int], lengths: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``encode_slice`` of texts cut at the added tokens, their own ids between the parts; with ``lengths``, each id's bytes."""
    raw = B.utf8(batch.column(column))[0].tobytes()
    if not any(t.encode() in raw for t in added):
        ids, at = encode_slice(batch, column, merges)
        return ids, at, merges.lengths[ids] if lengths else None
    cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    parts, after, rows = [], [], [0]
    for text in batch.column(column).to_pylist():
        split = cuts.split(text or "")
        parts += split[::2]
        after += [*split[1::2], None]  # the token behind each part
        rows.append(len(parts))
    ids, at = encode_slice(pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=[column]), column, merges)
    sizes = merges.lengths[ids] if lengths else None
    has = np.array([t is not None for t in after], bool)
    found = [t for t in after if t is not None]
    ids = np.insert(ids, at[1:][has], [added[t] for t in found])
    sizes = np.insert(sizes, at[1:][has], [len(t.encode()) for t in found]) if lengths else None
    return ids, (at + np.concatenate(([0], np.cumsum(has))))[rows], sizes


def encoder(held, offsets: bool = True, last: int | None = None, added: dict[str, int] | None = None):
    """Function of Arrow batches (key, text) that yields (key, ids, ends), slice by slice."""

    def run(batches):
        merges = _merges(held)
        for whole in batches:
            for batch in B.slices(whole, "text", SLICE_TEXT):
                ids, at, sizes = encode_added(batch, "text", merges, added or {}, offsets)
                n = len(at) - 1
                if last is not None:
                    ids = np.insert(ids, at[1:], last)
                    sizes = np.insert(sizes, at[1:], 0) if offsets else None
                    at = at + np.arange(n + 1)
                columns = [batch.column("key"), B.lists(ids, at, pa.int32())]
                if offsets:
                    sums = np.concatenate(([0], np.cumsum(sizes)))
                    ends = sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))
                    columns.append(B.lists(ends.astype(np.int32), at, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "ends"][: len(columns)])

    return run


def encode(docs: DataFrame, tokens: dict[bytes, int], key: str = "doc_id", text: str = "text", offsets: bool = True, last: int | None = None) -> DataFrame:
    """(key, ids, ends) of every text: its ids and, with ``offsets``, where each id's bytes end.

    ``last`` is an id to add after each text.
    """
    run = encoder(shared(docs, tokens), offsets, last)
    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, ids array<int>" + (", ends array<int>" if offsets else "")
    )
    return got.withColumnRenamed("key", key)


def decode(encoded: DataFrame, tokens: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """(key, ids, bytes) of encoded rows (key, ids, ends): each id's bytes, laid at its offset."""
    held = shared(encoded, tokens)

    def run(batches):
        merges = _merges(held)
        for whole in batches:
            for b in B.list_slices(whole, "ids", SLICE_IDS):
                ids = b.column("ids")
                flat = np.asarray(ids.flatten())
                ends = np.asarray(b.column("ends").flatten()).astype(np.int64)
                per = np.diff(np.asarray(ids.offsets))
                at = np.concatenate(([0], np.cumsum(per)))
                last = np.where(per > 0, ends[np.maximum(at[1:] - 1, 0)] if len(ends) else 0, 0)
                base = np.concatenate(([0], np.cumsum(last)))
                data = np.zeros(int(base[-1]), np.uint8)
                sizes = merges.lengths[flat]
                data[ranges(ends - sizes + np.repeat(base[:-1], per), sizes)] = merges.decode(flat)
                raw = pa.Array.from_buffers(
                    pa.binary(), len(per), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays([b.column("key"), ids, raw], names=["key", "ids", "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    got = encoded.select(F.col(key).alias("key"), "ids", "ends").mapInArrow(run, f"key {kind}, ids array<int>, bytes binary")
    return got.withColumnRenamed("key", key)
