"""Column expressions over text: tokens, shingles, cleaning steps, estimates.

Every function maps Columns to Columns and stays in JVM expressions, but for the counts of
``quality_score``. All of them are linear in the length of the text: character n-grams come from one look-ahead regex pass, because
``substring`` walks the string from its start on every call.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom import constants as K
from askloom.functions.folds import let

_WORD = r"(?U)\w{2,}+"
# A word run that holds no CJK, or any two neighbouring CJK characters (overlapping).
_WORD_OR_BIGRAM = (
    r"(?U)(?=([一-鿿]{2}"
    r"|(?<![\w&&[^一-鿿]])[\w&&[^一-鿿]]{2,}+))"
)
_CJK = r"[一-鿿]"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space at both ends."""
    return F.btrim(text, F.lit(K.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def any_of(patterns: Sequence[str]) -> str:
    """One alternation out of several patterns (inline flags stay local to each branch).

    Where all begin at the start of the text, that is asked once, before the branches: else each of them is tried
    at every place of a text.
    """
    bodies = [f"(?i:{p[5:]})" if p.startswith("(?i)^") else f"(?:{p[1:]})" if p.startswith("^") else None for p in patterns]
    return "|".join(f"(?:{p})" for p in patterns) if None in bodies else f"^(?:{'|'.join(bodies)})"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def count_contained(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def tokens(text: Column, stop_words: Sequence[str] = tuple(K.STOP_WORDS)) -> Column:
    """Lower-case tokens of length two and more: word runs, and bigrams for CJK text."""
    low = F.lower(text)
    found = F.when(
        text.rlike(_CJK), F.regexp_extract_all(low, F.lit(_WORD_OR_BIGRAM), F.lit(1))
    ).otherwise(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)))
    drop = [w for w in stop_words if len(w) > 1]
    return F.filter(found, lambda t: ~t.isin(drop)) if drop else found


def ngrams(text: Column, n: int = 3) -> Column:
    """All overlapping character n-grams, in order."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams."""
    return F.array_distinct(ngrams(text, n))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """|a∩b| / |a∪b| of two distinct arrays; 0 when either is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        inter.cast("double") / union
    )


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of character trigram sets."""
    return jaccard_of_sets(shingles(a), shingles(b))


def content_key(text: Column) -> Column:
    return F.md5(text)


# ------------------------------------------------------------------------------ cleaning
def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _drop_lines(text: Column, dropped) -> Column:
    """Remove lines for which ``dropped(stripped)`` holds; blank lines become empty."""
    kept = F.filter(_lines(text), lambda l: is_blank(l) | ~dropped(strip(l)))
    return F.array_join(F.transform(kept, lambda l: F.when(is_blank(l), "").otherwise(l)), "\n")


def drop_decorative_lines(text: Column) -> Column:
    return _drop_lines(
        text,
        lambda s: s.rlike(K.DECORATIVE_LINE)
        | ((F.length(s) < K.PURE_SYMBOL_MAX) & s.rlike(K.PURE_SYMBOL_LINE)),
    )


def drop_page_number_lines(text: Column) -> Column:
    return _drop_lines(text, lambda s: s.rlike(any_of(K.PAGE_NUMBER_PATTERNS)))


def coarse_clean(text: Column) -> Column:
    """Whole-text cleaning; blank or null input gives an empty string."""
    # classes of many ranges are slow, so Latin texts are told by one range, and spared what matches no Latin text
    wide = text.rlike("[^\\x00-\u024f]")
    special = wide | text.contains("\u00a0") | text.contains("\u00ad")
    t = F.when(special, F.regexp_replace(text, K.SPECIAL_WHITESPACE, " ")).otherwise(text)
    t = F.regexp_replace(t, K.CONTROL_CHARS, "")
    t = F.regexp_replace(t, " {2,}", " ")
    t = F.regexp_replace(t, r"(?md)^[ \t]+|[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    t = drop_decorative_lines(t)
    t = drop_page_number_lines(t)
    steps = [
        *[(p, "", p.startswith("(?i)")) for p in K.BOILERPLATE_PATTERNS], (K.BROKEN_LINE, "$1$2", False), (K.CJK_GAP, "$1$2", False),
        (K.REVISION_MARKS, "", True), (K.STRIKETHROUGH, "", False),
    ]

    def run(t: Column, all_: bool) -> Column:
        for pattern, by, latin in steps:
            t = F.regexp_replace(t, pattern, by) if all_ or latin else t
        return t

    t = let(t, lambda t: F.when(wide, run(t, True)).otherwise(run(t, False)))
    t = F.regexp_replace(t, K.HIDDEN_FORMAT, "")
    t = strip(F.regexp_replace(t, r"\n{4,}", "\n\n"))
    return F.when(is_blank(text), F.lit("")).otherwise(t)


def fine_clean(text: Column) -> Column:
    """Parent-level cleaning; null for blank text."""
    t = F.regexp_replace(strip(text), r"\n{4,}", "\n\n")
    t = strip(F.regexp_replace(t, " {2,}", " "))
    return F.when(~is_blank(text), t)


_KINDS = ("cjk", "punct", "digits", "letters", "spaces")


@functools.cache
def _kinds() -> np.ndarray:
    """The kinds of every code point, one bit each in the order of ``_KINDS``."""
    table = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0x4E00, 0x9FFF), (0x3000, 0x303F), (0xFF00, 0xFFEF)):
        table[lo : hi + 1] |= 1
    table[[ord(c) for c in '，。！？；：、"（）《》【】—…']] |= 2
    table[[i for i in range(0x110000) if chr(i).isdecimal()]] |= 4
    table[[*range(65, 91), *range(97, 123)]] |= 8
    table[[ord(c) for c in K.WHITE_SPACE]] |= 16
    return table


_ISOLATED = re.compile(rf"(?:\A|[{K.WHITE_SPACE}])\d+(?:[{K.WHITE_SPACE}]|\Z)")


def _character_counts(texts: pa.Array) -> pa.Array:
    """Characters of each kind, numbers that stand alone, and the mean length of lines where there is CJK text."""
    table, rows = _kinds(), []
    for t in texts.to_pylist():
        t = t or ""
        seen = np.bincount(table[np.frombuffer(t.encode("utf-32-le"), np.uint32)], minlength=32)
        row = {k: int(seen[np.arange(32) >> bit & 1 == 1].sum()) for bit, k in enumerate(_KINDS)}
        lines = [len(s) for s in (x.strip(K.WHITE_SPACE) for x in t.split("\n")) if s] if row["cjk"] else []
        rows.append(row | {"isolated": len(_ISOLATED.findall(t)) if row["digits"] else 0, "mean_line": sum(lines) / len(lines) if lines else None})
    ints = [pa.array([r[k] for r in rows], pa.int32()) for k in (*_KINDS, "isolated")]
    return pa.StructArray.from_arrays([*ints, pa.array([r["mean_line"] for r in rows], pa.float64())], names=[*_KINDS, "isolated", "mean_line"])


def quality_score(text: Column) -> Column:
    """0..1 share of meaningful text; low for digits, fragments and junk.

    Characters are counted in Arrow batches, all kinds in one look at a text.
    """
    kinds = ", ".join(f"{k}: int" for k in (*_KINDS, "isolated"))
    n, c = F.length(text), F.arrow_udf(_character_counts, f"struct<{kinds}, mean_line: double>")(text)
    weighted = c["cjk"] / n * 0.6 + c["punct"] / n * 0.25 + c["letters"] / n * 0.15
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted - F.least(F.lit(0.5), c["isolated"] * 0.05)))
    return (
        F.when(text.isNull() | (n < 10), 0.0)
        .when((c["digits"] + c["spaces"]) / n > 0.7, 0.05)
        .when(c["mean_line"] < 2.0, F.when((c["cjk"] > 100) & (c["cjk"] / n > 0.30), 0.25).otherwise(0.08))
        .otherwise(score)
    )


# ------------------------------------------------------------------------------ line classes
def heading_level(line: Column) -> Column:
    """0 for ordinary lines, else heading level 1 to 3."""
    s = strip(line)
    level = F.when((F.length(s) == 0) | (F.length(s) > K.HEADING_MAX), 0)
    for i, pattern in enumerate(K.HEADING_PATTERNS):
        level = level.when(s.rlike(pattern), min(i + 1, 3))
    return level.otherwise(0)


def is_heading(line: Column) -> Column:
    s = strip(line)
    return (F.length(s) > 0) & (F.length(s) <= K.HEADING_MAX) & s.rlike(any_of(K.HEADING_PATTERNS))


def is_clause_start(line: Column) -> Column:
    return strip(line).rlike(any_of(K.CLAUSE_PATTERNS))


def may_start(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any line of a text may begin like one of the patterns: never false where one does.

    One pass over the text, by which texts without such lines are spared the work line by line.
    """
    begins = [re.sub(r"\.\{[\d,]+\}\$$", "", p.removeprefix("^")) for p in patterns]
    return text.rlike(r"(?U:(?:\A|\n)\s*)(?:%s)" % any_of(begins))


def is_list_item(line: Column) -> Column:
    return strip(line).rlike(any_of(K.LIST_PATTERNS))


def looks_like_toc(text: Column) -> Column:
    hits = F.filter(
        F.transform(_lines(strip(text)), strip),
        lambda l: l.rlike(r"[.·•]{3,}|\.{2,}\s*\d+$|^.{2,30}\s+\d{1,4}$"),
    )
    return F.size(hits) >= 3


def looks_like_references(text: Column) -> Column:
    hits = F.filter(
        F.transform(_lines(strip(text)), strip),
        lambda l: l.rlike(r"^\[\d+\]") | (l.rlike(r"^\d+\.\s") & (F.length(l) > 20)),
    )
    return F.size(hits) >= 3


# ------------------------------------------------------------------------------ token estimates
def tokens_half_length(text: Column) -> Column:
    return F.floor(F.length(text) / 2)


def tokens_by_script(text: Column) -> Column:
    """1.5 per CJK character and 0.25 per other one, at least 1; 0 for empty text."""
    cjk = F.regexp_count(text, F.lit(_CJK))
    est = F.floor(cjk * 1.5 + (F.length(text) - cjk) * 0.25)
    return F.when(text.isNull() | (F.length(text) == 0), F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), est)
    )


def last_resort_usage(answer: Column) -> tuple[Column, Column]:
    """(input, output) token guesses when nothing better is known."""
    floor10 = lambda d: F.greatest(F.lit(10).cast("long"), F.floor(F.length(answer) / d))
    return floor10(3), floor10(2)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_CJK))


# ------------------------------------------------------------------------------ masking
def html_escape(text: Column) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t


def has_xss(text: Column) -> Column:
    # every pattern needs one of these characters, which plain prose rarely has
    return F.coalesce(
        text.rlike("[<:=(@]") & text.rlike("(?is)" + any_of(K.XSS_PATTERNS)), F.lit(False)
    )


def sanitize_filename(name: Column) -> Column:
    t = F.element_at(F.split(name, "/"), -1)
    for token in K.DANGEROUS_FILE_TOKENS:
        t = F.replace(t, F.lit(token), F.lit("_"))
    t = F.regexp_replace(t, r"(?U)[^\w\-_.]", "")
    ext = F.regexp_extract(t, r"(?<=[^.])(\.[^.]*)$", 1)
    stem = F.substring(t, F.lit(1), F.lit(255) - F.length(ext))
    t = F.when(F.length(t) > 255, F.concat(stem, ext)).otherwise(t)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "unnamed_file").otherwise(
        F.coalesce(F.nullif(t, F.lit("")), F.lit("unnamed_file"))
    )


def truncate_at_space(text: Column, limit: int = 1000, suffix: str = "...") -> Column:
    cut = F.substring(text, 1, limit - len(suffix))
    at_space = F.regexp_replace(cut, r"(?s)(?<=.) [^ ]*$", "")
    return (
        F.when(text.isNull(), "")
        .when(F.length(text) <= limit, text)
        .when(F.lit(len(suffix) >= limit), F.lit(suffix[:limit]))
        .otherwise(F.concat(at_space, F.lit(suffix)))
    )


def mask_middle(text: Column, visible: int = 4, char: str = "*") -> Column:
    n = F.length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, char * 8)
        .when(n <= visible * 2, F.repeat(F.lit(char), n))
        .otherwise(
            F.concat(
                F.left(text, F.lit(visible)),
                F.repeat(F.lit(char), n - 2 * visible),
                F.right(text, F.lit(visible)),
            )
        )
    )


def mask_key(key: Column) -> Column:
    return F.when(
        F.length(key) > 8, F.concat(F.left(key, F.lit(4)), F.lit("***"), F.right(key, F.lit(4)))
    ).otherwise(key)


def redact_secrets(text: Column) -> Column:
    t = text
    for pattern, replacement in K.REDACTIONS:
        t = F.regexp_replace(t, "(?i)" + pattern, replacement.replace("$", r"\$"))
    return t
