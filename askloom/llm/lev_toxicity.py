"""Toxic documents by a learned lexicon, matched with misspellings and weighed by context.

The lexicon holds the words whose document counts in a bounded labelled sample speak for the toxic
class, each with a cautious log-odds weight. A Levenshtein automaton for the word at hand walks the
lexicon's trie, so misspelled terms are found without listing variants. Hits count in full in plain
text and little between quotation marks or next to words that report speech; the strongest context
window makes the score.

Results for special input: a null, empty or blank text has no hits and gets the score of none;
without toxic labelled rows the lexicon is empty and all documents get that score; rows that repeat
are each scored; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import labelled
from askloom.llm import textbytes as B
from askloom.llm.components import stored

SAMPLE_ROWS = 8000  # labelled documents the fit may see, both classes together
SKETCH = 6  # smallest word hashes by which near copies in the sample are told
TERMS = 20000  # most terms of a lexicon
LEAST_DOCUMENTS = 4  # toxic documents a term must occur in
LEAST_WEIGHT = 2.0  # cautious log odds from which a word is a term
LEAST_GAIN = 10.0  # log likelihood a term must win over chance; chance terms of 10 000 words stay rare
CAUTION = 1.64  # standard errors taken off a term's log odds
WINDOW = 24  # words of one context window
QUOTED = 0.25  # share of a hit's weight that counts inside a quotation
REPORTING = 6  # words before a hit in which a reporting word makes it a quotation, if quotes follow
LONGEST = 60  # most words of a quotation
CACHE = 300_000  # words a worker remembers
STEPS = 300_000  # transitions of the automaton a worker remembers

# Quotation marks and words that report speech.
OPENING = "\"“„«‹"
CLOSING = "\"”“»›"
REPORTS = frozenset("said says say wrote writes called quote quoted quotes term word sagte schrieb nannte dit écrit dijo escribió".split())

_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[^\W_]+|[" + OPENING + CLOSING + "\n]")


def edits(n: int) -> int:
    """Edits within which a term of ``n`` letters may be misspelled."""
    return 0 if n < 5 else 1 if n < 12 else 2


class Lexicon:
    """Weighted terms in a trie, walked by a Levenshtein automaton.

    A state of the automaton is the set of trie nodes that the letters read so far can have reached,
    each with the fewest edits spent; a node is given up once no term below it allows as many. States
    are made when first reached and remembered, so most words cost one look-up a letter and stop at
    the first letter after which no term is near.
    """

    def __init__(self, terms: dict[str, float], known: frozenset[str], discount: float):
        self.terms, self.known, self.discount = terms, known, discount
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed = [0]  # most edits of a term at or below each node
        for t in sorted(terms):
            node, k = 0, edits(len(t))
            self.allowed[0] = max(self.allowed[0], k)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            self.term[node] = t
        self._forget()
        self.cache: dict[str, float] = {}

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of a state, closed under letters of a term that the word leaves out; -1 if empty."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < reached.get(child, e + 1):
                    reached[child] = e
                    todo.append(child)
        state = tuple(sorted(reached.items()))
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node, e):
            if e <= self.allowed[node] and e < after.get(node, e + 1):
                after[node] = e

        for node, e in self.states[number]:
            reach(node, e + 1)  # a letter too many
            for c, child in self.children[node].items():
                reach(child, e if c == letter else e + 1)
        found = self.steps[(number, letter)] = self._state(after)
        return found

    def near(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) of the terms that the word may be a misspelling of."""
        if len(self.steps) > STEPS:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            after = steps.get((state, c))
            state = self._step(state, c) if after is None else after
            if state < 0:
                return []
        return sorted((e, t) for node, e in self.states[state] if (t := self.term[node]) is not None and e <= edits(len(t)))

    def weight(self, word: str) -> float:
        """A term's weight, a misspelled term's share of it, or 0."""
        w = self.cache.get(word)
        if w is None:
            w = self.terms.get(word)
            if w is None:
                w = 0.0
                if len(word) >= 4 and word not in self.known and (found := self.near(word)):
                    least = found[0][0]
                    w = max(self.terms[t] for e, t in found if e == least) * self.discount**least
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = w
        return w


def _opens(text: str, m: re.Match) -> bool:
    """Whether a mark opens: a straight one stands before a word and not right after one (no inch mark)."""
    if m.group() != '"':
        return m.group() in OPENING
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    return not before.isalnum() and bool(after) and not after.isspace()


def _quotations(text: str, parts: list[re.Match]) -> dict[int, int]:
    """Part of each opening mark and the part that closes it, on one line and within ``LONGEST`` words."""
    found, first, words = {}, None, 0
    for n, m in enumerate(parts):
        mark = m.group()
        if mark[0].isalnum():
            words += 1
            continue
        if mark == "\n" or words > LONGEST:
            first = None
        if mark == "\n":
            continue
        straight = first is not None and parts[first].group() == '"'
        closes = mark in CLOSING and first is not None and (mark == '"') == straight
        if closes and not (straight and text[m.start() - 1].isspace()):
            found[first], first = n, None
        elif _opens(text, m):
            first, words = n, 0
    return found


def evidence(text: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Weight of a text's strongest window, weight of its other terms, and log of its words.

    Each term counts once in a window. Hits inside a quotation that closes on its line within
    ``LONGEST`` words count ``QUOTED`` of their weight; where the closing mark is lost, only hits
    within ``REPORTING`` words of a reporting word before the opening mark do.
    """
    hits, at, report, held = [], 0, -REPORTING - 1, {}
    low = text.lower()
    parts = list(_PART.finditer(low))
    spans = _quotations(low, parts)
    opened, until = -1, -1  # last opening mark's word, and the place where its quotation closes
    for n, m in enumerate(parts):
        part = m.group()
        if not part[0].isalnum():
            if n in spans:
                until = max(until, spans[n])
            elif _opens(low, m):
                opened = at  # its closing mark is lost
            continue
        if part in REPORTS:
            report = at
        if w := lexicon.weight(part):
            lost = report < opened <= at and at - report <= REPORTING
            hits.append((at, w * (QUOTED if n < until or lost else 1.0), part))
        at += 1
    best, lo, total = 0.0, 0, 0.0
    for i, (_, w, term) in enumerate(hits):
        held[term] = held.get(term, 0) + 1
        total += w if held[term] == 1 else 0.0
        while hits[i][0] - hits[lo][0] > WINDOW:
            gone = hits[lo]
            held[gone[2]] -= 1
            if not held[gone[2]]:
                total -= gone[1]
            lo += 1
        best = max(best, total)
    spread = sum({t: w for _, w, t in hits}.values())
    return best, max(spread - best, 0.0), math.log1p(at)


def evidences(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Evidence of each text. Distinct tokens are asked first; only texts with a hit are read in context."""
    data, off = B.utf8(column)
    starts, ends, first = B.words(data, off)
    codes, hashes = pd.factorize(B.span_hashes(data, starts, ends))
    at = np.zeros(len(hashes), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    raw, weight = data.tobytes(), lexicon.weight
    hit = np.array([any([weight(w) for w in _WORD.findall(raw[starts[i] : ends[i]].decode("utf-8", "replace").lower())]) for i in at], bool)
    hits = np.concatenate(([0], np.cumsum(hit[codes] if len(codes) else np.zeros(0, bool))))
    words = np.diff(first)
    out = np.zeros((len(off) - 1, 3))
    out[:, 2] = np.log1p(words)
    for i in np.flatnonzero(hits[first[1:]] > hits[first[:-1]]):
        out[i] = evidence(column[int(i)].as_py(), lexicon)
    return out


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of each class that hold a word."""

    def run(batches):
        for whole in batches:
            for batch in B.slices(whole, "text"):
                terms, kinds = [], []
                for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                    own = {w for w in _WORD.findall(t.lower()) if len(w) >= 3}
                    terms += own
                    kinds += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(kinds, pa.int32())], names=["term", "label"])

    return sample.mapInArrow(run, "term string, label int").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], frozenset[str], float, np.ndarray]:
    """Term weights, clean words near terms, the share a misspelling keeps, and the score's weights.

    Term counts are made by Spark over the bounded sample; what reaches the driver is at most
    ``TERMS`` terms, the sample's clean words near them, and three numbers per sampled document.
    """
    # near copies count once, else each rare word of a copied document would look like a term
    sketch = F.slice(F.sort_array(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w)))), 1, SKETCH)
    single = labelled.sample(docs, labels, target, rows).groupBy("label", sketch.alias("_s")).agg(F.min(F.struct("id", "text")).alias("d"))
    chosen = stored(single.select("d.text", "label"), "sample")
    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}, frozenset(), 0.5, PRIOR
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    sure = odds - CAUTION * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    share, both = n1 / (n1 + n0), F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))
    ).otherwise(0.0)
    counts = _term_counts(chosen)
    best = counts.where((F.col("toxic") >= LEAST_DOCUMENTS) & (sure > LEAST_WEIGHT) & (gain > LEAST_GAIN) & (F.col("toxic") > 4 * F.col("clean") * n1 / n0))
    terms = {r["term"]: r["w"] for r in best.select("term", sure.alias("w")).orderBy(F.desc("w"), "term").limit(TERMS).collect()}
    lexicon = Lexicon(terms, frozenset(), 0.5)

    def near(batches):
        for b in batches:
            yield b.filter(pa.array([t not in lexicon.terms and lexicon.weight(t) > 0 for t in b.column("term").to_pylist()], pa.bool_()))

    by = counts.select("term", "toxic", "clean").mapInArrow(near, "term string, toxic long, clean long")
    spelled = by.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = (spelled["t"] or 0) / n1, (spelled["c"] or 0) / n0
    discount = float(np.clip((t + 1 / n1) / (t + c + 2 / n1), 0.2, 0.8)) if t + c else 0.5
    known = frozenset(
        r["term"] for r in by.where("clean > 0").orderBy(F.desc("clean"), "term").limit(TERMS).select("term").collect()
    )
    lexicon = Lexicon(terms, known, discount)

    def told(batches):
        for whole in batches:
            for b in B.slices(whole, "text"):
                e = evidences(b.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([b.column("label"), *[pa.array(c) for c in e.T]], names=["label", "x", "y", "z"])

    seen = chosen.mapInArrow(told, "label int, x double, y double, z double").toPandas()
    seen = seen.sort_values(list(seen.columns))
    return terms, known, discount, calibrated(seen[["x", "y", "z"]].to_numpy(), seen["label"].to_numpy(float))


PRIOR = np.array([1.5, 0.5, -0.1, -3.0])  # evidence weights and offset the fit is drawn towards


def calibrated(x: np.ndarray, y: np.ndarray, pull: float = 4.0, steps: int = 30) -> np.ndarray:
    """Logistic weights of the evidence and an offset, classes weighing alike, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    share = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))

    def loss(w):
        z = x @ w
        return (share * (np.logaddexp(0, z) - y * z)).sum() + pull / 2 * ((w - PRIOR) ** 2).sum()

    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + pull * (w - PRIOR)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """(key, columns of ``keep``, ``out``) of every document, in one narrow pass over whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS
    names = list(dict.fromkeys([key, *keep]))
    read = text if text in names else "_text"

    def run(batches):
        terms, known, discount, fitted = held.value
        lexicon = Lexicon(terms, known, discount)
        for whole in batches:
            for batch in B.slices(whole, read):
                z = evidences(batch.column(read), lexicon) @ fitted[:3] + fitted[3]
                yield B.with_columns(batch, names, **{out: pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))})

    rows = docs.select(*names, *([] if text in names else [F.col(text).alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")
