"""Text quality from supervised subword embeddings.

Words and the character n-grams inside them are hashed to rows of one table of vectors; a document
is the average of its rows, a softmax over that average gives the classes, and table and softmax are
fitted together by mini-batch stochastic gradient descent in NumPy on a bounded labelled sample. A
word that repeats the one before it adds one further feature, the word bigram (w, w) with its word
left out.

Results for special input: a null, empty or blank text scores as the average of no rows, which is
the softmax of the bias alone; without labelled rows of both classes every score is 0.5; rows that
repeat are each scored; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import labelled
from askloom.llm import textbytes as B

SAMPLE_ROWS = 4000  # labelled documents the fit may see, both classes together
BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
EPOCHS = 6
BATCH = 32
RATE = 0.2


def token_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of every token (word, then n-grams with word edges) and the tokens' offsets."""
    text = np.frombuffer((" " + " ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = text == 32
    edges = np.flatnonzero(gap)
    owner = np.cumsum(gap) - 1  # a gap belongs to the token after it
    found_rows, found_owner = [], []
    powers = [np.uint64(pow(0x9FB21C651E98DF25, i + 1, 1 << 64)) for i in range(max(GRAMS))]
    word = B.span_sums(B.mix(text, 11), edges[:-1] + 1, edges[1:])
    found_rows.append(word)
    found_owner.append(np.arange(len(tokens)))
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h += text[i : i + m] * powers[i]
        inside = np.ones(m, bool)
        for i in range(1, n - 1):
            inside &= ~gap[i : i + m]
        if n == 2:
            inside &= ~(gap[:m] & gap[1:])
        at = np.flatnonzero(inside)
        found_rows.append(B.mix(h[at] + np.uint64(n), 15))
        found_owner.append(owner[at])
    rows, own = np.concatenate(found_rows), np.concatenate(found_owner)
    order = np.argsort(own, kind="stable")
    rows = (rows[order] % np.uint64(BUCKETS - 1)).astype(np.int64)
    return rows, np.searchsorted(own[order], np.arange(len(tokens) + 1))


REPEAT = BUCKETS - 1  # the row of a repeated word


def distinct_tokens(data: np.ndarray, off: np.ndarray):
    """Each row's first word, the words' codes, the distinct words, and whether a word repeats the last."""
    starts, ends, first = B.words(data, off)
    codes, hashes = pd.factorize(B.span_hashes(data, starts, ends))
    at = np.zeros(len(hashes), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = data.tobytes()
    tokens = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in at]
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[first[:-1][first[:-1] < len(codes)]] = False
    return first, codes, tokens, again


def document_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of one document and their shares."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    _, codes, tokens, again = distinct_tokens(data, np.array([0, len(data)]))
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    rows, off = token_features(tokens)
    times = np.bincount(codes, minlength=len(tokens))
    total = np.bincount(rows, weights=np.repeat(times, np.diff(off)), minlength=BUCKETS)
    total[REPEAT] += again.sum()
    kept = np.flatnonzero(total)
    return kept, total[kept] / total.sum()


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row vectors, class vectors and bias. Gradients are scaled per coordinate by their past squares."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    if len(set(labels.tolist())) < 2:
        return table, np.zeros((DIM, 2)), bias
    docs = [document_rows(t) for t in texts]
    g_table, g_out, g_bias = np.full((BUCKETS, DIM), 1e-8), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(docs))
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            sizes = [len(docs[i][0]) for i in part]
            rows = np.concatenate([docs[i][0] for i in part])
            share = np.concatenate([docs[i][1] for i in part])
            who = np.repeat(np.arange(len(part)), sizes)
            uniq, inv = np.unique(rows, return_inverse=True)
            mean = np.zeros((len(part), DIM))
            np.add.at(mean, who, table[rows] * share[:, None])
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = error @ out.T
            grad = np.zeros((len(uniq), DIM))
            np.add.at(grad, inv, back[who] * share[:, None])
            step_out, step_bias = mean.T @ error, error.sum(axis=0)
            g_table[uniq] += grad**2
            g_out += step_out**2
            g_bias += step_bias**2
            table[uniq] -= rate * grad / np.sqrt(g_table[uniq])
            out -= rate * step_out / np.sqrt(g_out)
            bias -= rate * step_bias / np.sqrt(g_bias)
    return table, out, bias


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Per-row logit of class 1 over class 0, and the bias, from at most ``rows`` labelled documents.

    The softmax of two classes only needs the difference of their logits, which is linear in the
    averaged rows, so each row's vector folds into one number for scoring.
    """
    got = labelled.sample(docs, labels, target, rows).toPandas()
    got = got.sort_values(["id", "text"], kind="stable")
    table, out, bias = fit(got["text"].tolist(), got["label"].to_numpy(np.int64))
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """(key, columns of ``keep``, ``out``) of every document, in one narrow pass over whole texts."""
    logits, bias = model
    held = docs.sparkSession.sparkContext.broadcast(logits)  # BUCKETS numbers of 4 bytes
    names = list(dict.fromkeys([key, *keep]))
    read = text if text in names else "_text"

    def run(batches):
        for whole in batches:
            for batch in B.slices(whole, read):
                data, off = B.utf8(batch.column(read))
                first, codes, tokens, again = distinct_tokens(data, off)
                z = np.zeros(len(off) - 1)
                if tokens:
                    rows, at = token_features(tokens)
                    sums = np.concatenate(([0.0], np.cumsum(held.value[rows], dtype=np.float64)))
                    each = np.concatenate(([0.0], np.cumsum((sums[at[1:]] - sums[at[:-1]])[codes] + again * float(held.value[REPEAT]))))
                    count = np.concatenate(([0], np.cumsum(np.diff(at)[codes] + again)))
                    n = count[first[1:]] - count[first[:-1]]
                    z = (each[first[1:]] - each[first[:-1]]) / np.maximum(n, 1)
                p = 1 / (1 + np.exp(-np.clip(z + bias, -60, 60)))
                yield B.with_columns(batch, names, **{out: pa.array(p)})

    rows = docs.select(*names, *([] if text in names else [F.col(text).alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")
