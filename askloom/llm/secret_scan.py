"""Secrets in texts: three fixed patterns, and strings whose letters look drawn at random.

Candidate strings are the longest runs of the widest character class that lie outside the pattern
matches. A candidate belongs to the narrowest class that holds all its characters; a window of the
class's width moves along it, the counts of its characters are kept by adding one and taking one off,
and with them the window's Shannon entropy. Windows that reach the class's entropy are joined to spans.
An allow-list takes back spans that are known to be harmless: parts of addresses, UUIDs, words joined by
marks, alphabets in order, samples. It touches only the spans that entropy adds.

Work is one narrow pass over whole texts with a table of counts per candidate; nothing is shuffled.

Results for special input: a null or empty text has no spans; rows that repeat an id, and rows without
one, are scanned each on its own; an empty table gives no rows; the longest texts are scanned whole, in
time that grows with their length. Columns besides id and text are not read. Positions are code points,
ends are exclusive.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns: (kind, expression, group that is measured, least length).
PATTERNS = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = (*(p[0] for p in PATTERNS), "entropy")


@dataclass(frozen=True)
class Kind:
    """A character class with the width of its window and the entropy, in bits, that a window must reach."""

    characters: str
    window: int
    bits: float


CLASSES = (
    Kind("0123456789abcdefABCDEF", 24, 3.0),
    Kind("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 24, 4.0),
    Kind("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 24, 4.1),
)
ALLOWED = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    r"[A-Za-z]+",  # letters alone: a word or a name made of words
    r"[0-9/_=+-]+",  # numbers alone: dates, rules of dashes
    r"(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8})(?:[/_=+-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8}))+[/_=+-]*",  # words and numbers joined by marks
    r"(?i).*(?:example|sample|placeholder|xxxx|abcdefgh|01234567|12345678).*",  # samples and alphabets in order
)
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+"


@dataclass
class Scanner:
    """Spans of one text after another; patterns and tables are made once per worker."""

    classes: tuple[Kind, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    made: dict = field(default_factory=dict)

    def __post_init__(self):
        widest = self.classes[-1]
        self.patterns = [(k, re.compile(p), g, n) for k, p, g, n in PATTERNS]
        least = min(c.window for c in self.classes)
        self.runs = re.compile(f"[{re.escape(widest.characters)}]{{{least},}}")
        self.fits = [(c, frozenset(c.characters)) for c in self.classes]
        self.allow = [re.compile(p) for p in self.allowed]
        self.address = re.compile(ADDRESS)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of the pattern matches; matches that are too short use up their text."""
        found = []
        for number, (_, pattern, group, least) in enumerate(self.patterns):
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), number, m.end()))
        return found

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of high entropy in what the pattern matches leave over."""
        taken = sorted((s, e) for s, _, e in base)
        addresses, found, at = None, [], 0
        for run in self.runs.finditer(text):
            while at < len(taken) and taken[at][1] <= run.start():
                at += 1
            start = run.start()
            for s, e in [*self._within(taken, at, run.end()), (run.end(), run.end())]:
                for a, b in self._spans(text, start, s):
                    addresses = [m.span() for m in self.address.finditer(text)] if addresses is None else addresses
                    if not self._harmless(text, start, s, addresses):
                        found.append((a, len(self.patterns), b))
                start = max(start, e)
        return found

    @staticmethod
    def _within(taken, at, end):
        while at < len(taken) and taken[at][0] < end:
            yield taken[at]
            at += 1

    def _spans(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        part = text[start:end]
        kind = next((c for c, held in self.fits if held.issuperset(part)), None) if part else None
        if kind is None or len(part) < kind.window:
            return []
        return [(start + a, start + b) for a, b in high_windows(part, kind.window, kind.bits)]

    def _harmless(self, text: str, start: int, end: int, addresses) -> bool:
        part = text[start:end]
        if any(p.fullmatch(part) for p in self.allow):
            return True
        lo, hi = 0, len(addresses)
        while lo < hi:  # the last address that begins at or before the candidate
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if addresses[mid][0] <= start else (lo, mid)
        return lo > 0 and addresses[lo - 1][1] >= end

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        base = self.base(text)
        return sorted(base + self.added(text, base))


def high_windows(part: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows whose entropy is at least ``bits``.

    The entropy of a window of n characters is log2 n - (sum of c log2 c) / n over the counts c; as the
    window moves on, two counts and their two terms change.
    """
    terms = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = window * (math.log2(window) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, new in enumerate(part):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += terms[c + 1] - terms[c]
        if i >= window - 1:
            if total <= most:
                begin = i - window + 1
                if out and begin <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((begin, i + 1))
            old = part[i - window + 1]
            c = counts[old]
            counts[old] = c - 1
            total -= terms[c] - terms[c - 1]
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[Kind, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(key, spans): every row's spans by start, then kind in the order of KINDS."""

    def run(batches):
        scanner = Scanner(classes, allowed)
        for b in batches:
            found = [scanner.scan(t or "") for t in b.column("text").to_pylist()]
            kind = pa.array([KINDS[k] for rows in found for _, k, _ in rows], pa.string())
            start = pa.array([s for rows in found for s, _, _ in rows], pa.int64())
            end = pa.array([e for rows in found for _, _, e in rows], pa.int64())
            ends = [0]
            for rows in found:
                ends.append(ends[-1] + len(rows))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([kind, start, end], names=["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column("key"), spans], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)
