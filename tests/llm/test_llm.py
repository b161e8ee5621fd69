"""The operators and the pipeline against brute force on small fixtures, with odd rows."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows, extra=True):
    """Documents with nulls, empty and repeated rows as given, and columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for name in ("id", "key", "ids", "score", "n", "component", "_text", "label", "a", "b", "marks", "start", "next"):
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(rng, n, words=None):
    words = words or ["w%d" % i for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "lost words here"), (5, "é" * 20), (6, "a b c d"), (7, "A b C d")]


# ------------------------------------------------------------------------------ 1
def test_order_minhash(spark):
    from askloom.llm.order_minhash import fingerprint_edits

    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(10, 40)] + [(50, rows_text := prose(rng, 3000)), (51, rows_text), (52, ""), (53, None)]
    got = {r.doc_id: r for r in fingerprint_edits(docs_of(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[50].fingerprint == got[51].fingerprint and got[51].near_next == 1.0
    assert got[52].fingerprint == got[53].fingerprint and got[53].near_next == 1.0
    assert fingerprint_edits(docs_of(spark, ODD)).count() == len(ODD)
    assert fingerprint_edits(docs_of(spark, [])).count() == 0
    alone = fingerprint_edits(docs_of(spark, [(9, "abcdef")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_order_minhash_against_brute_force(spark):
    from askloom.llm import order_minhash as O

    rng = random.Random(2)
    texts = [prose(rng, n, ["a", "bb", "c", "dd", "e"]) for n in (0, 1, 2, 3, 7, 60, 400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        O.numbered_kmers(F.col("t")).alias("k"), O.order_min_hash(F.col("t")).alias("f")
    ).collect()
    for t, r in zip(texts, got, strict=True):
        units = re.findall(r"\S{1,16}", t)
        assert len(r.k) == (0 if not units else max(1, len(units) - O.K + 1))
        assert len({x.e for x in r.k}) == len(r.k)  # occurrence numbers tell repeats apart
        slots = {}
        for x in r.k:
            slots.setdefault(x.slot, []).append((x.e, x.pos))
        picked = {s: [e for e, _ in sorted(sorted(v)[: O.PICKED], key=lambda p: p[1])] for s, v in slots.items()}
        same = {}
        for s, p in picked.items():
            assert same.setdefault(r.f[s], p) == p
        assert len(r.f) == O.SLOTS and (units or set(r.f) == {0})


# ------------------------------------------------------------------------------ 2
def test_revisits(spark):
    from askloom.llm.revisits import resolve_revisits

    h = lambda **k: [(a.replace("_", "-"), b) for a, b in k.items()]
    rows = [
        (1, "http://A.net/x", 10, 200, h(etag="1", server="s", date="d1")),
        (2, "https://a.net/x#f", 20, 304, h(etag="1", date="d2", server="no")),
        (3, "http://a.net/x?utm_source=q", 30, 200, h(etag="2")),
        (4, "http://a.net/x/", 40, 304, h(etag="1")),
        (5, "http://a.net/x", 30, 304, h(etag="1")),  # same instant as 3: not earlier than it
        (6, "http://b.net/", 5, 304, None), (7, None, 5, 304, None), (8, "http://a.net/x", None, 304, None),
        (9, "http://a.net/x", 50, 304, None), (9, "http://a.net/x", 50, 304, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, t long, status int, headers array<struct<name:string,value:string>>")
    df = df.withColumn("captured_at", F.timestamp_seconds("t")).withColumn("_at", F.lit(1))
    got = [(r.record_id, r.state, r.response_id, dict((x.name, x.value) for x in r.headers or [])) for r in resolve_revisits(df).collect()]
    got = sorted(got, key=str)
    assert got == sorted([
        (2, "resolved", 1, {"etag": "1", "server": "s", "date": "d2"}), (4, "mismatch", None, {}),
        (5, "resolved", 1, {"etag": "1", "server": "s", "date": "d1"}), (6, "unresolved", None, {}), (7, "unresolved", None, {}),
        (8, "unresolved", None, {}), (9, "unchecked", 3, {"etag": "2"}), (9, "unchecked", 3, {"etag": "2"}),
    ], key=str)
    assert resolve_revisits(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------ 3
def test_permutation_index(spark):
    from askloom.llm.permutation_index import nearest

    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(900)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (1200, [1.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(1))
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = 0
    assert set(got) == set(range(0, 900, 50))
    for q, rows_ in got.items():
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(900), -np.round(s, 12))) if i != q][:5]
        assert [r for r, _, _ in sorted(rows_)] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - c) < 1e-12 for _, i, c in rows_)
        found += len(set(want) & {i for _, i, _ in rows_})
    assert found / (5 * len(got)) >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert nearest(few, few.where("vec_id % 50 = 0")).count() == 4
    assert nearest(few.limit(0), few.limit(0)).count() == 0


# ------------------------------------------------------------------------------ 4, 5
def labelled_docs(spark, bad, n=240):
    rng = random.Random(4)
    rows = [(i, bad(rng) if i % 3 == 0 else prose(rng, rng.randint(20, 60))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs_of(spark, rows), labels


def accuracy(scores, least, good):
    held = [(r.score >= least) == good(r.doc_id) for r in scores.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(held) / len(held)


def test_quality(spark):
    from askloom.llm import subword_quality as Q

    docs, labels = labelled_docs(spark, lambda rng: " ".join(w.upper() + "!!" for w in prose(rng, 30).split()))
    model = Q.train(docs, labels)
    assert accuracy(Q.score(docs, model), 0.5, lambda i: i % 3 != 0) > 0.95
    odd = Q.score(docs_of(spark, ODD), model, keep=("text",)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    blank = [r.score for r in odd if not (r.text or "").strip()]
    assert len(set(blank)) == 1
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs_of(spark, []), model).count() == 0


def test_toxicity(spark):
    from askloom.llm import lev_toxicity as T

    def bad(rng):
        words = prose(rng, 30).split()
        for _ in range(3):
            words[rng.randrange(30)] = rng.choice(["nastyword", "vileperson"])
        return " ".join(words)

    docs, labels = labelled_docs(spark, bad)
    model = T.train(docs, labels)
    assert accuracy(T.score(docs, model), 0.5, lambda i: i % 3 == 0) > 0.95
    lexicon = T.Lexicon(*model[:3])
    assert T.evidence("you nastywrod", lexicon)[0] == 0  # a swap is two edits
    plain, miss = T.evidence("you nastyword", lexicon)[0], T.evidence("you nastywod", lexicon)[0]
    quoted = T.evidence('he said "you nastyword" then', lexicon)[0]
    assert plain > miss > 0 and plain > quoted > 0
    odd = T.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert T.train(docs, labels.limit(0))[0] == {}
    assert T.score(docs_of(spark, []), model).count() == 0


def test_quotation_bounds():
    from askloom.llm import lev_toxicity as T

    lexicon = T.Lexicon({"nastyword": 4.0}, frozenset(), 0.5)
    weight = lambda t: T.evidence(t, lexicon)[0]
    for whole in ('a 5" screen you nastyword', 'lost "mark here ' + "w " * 90 + "nastyword", 'an "open line\nyou nastyword', "“lost you nastyword",
                  "she said you nastyword", "in other word nastyword", '"one" and nastyword "two"', '"w ' + "w " * 90 + 'nastyword" end'):
        assert weight(whole) == 4.0, whole
    for part in ('he said "you nastyword" then', "“you nastyword”", "„you nastyword“", "«you nastyword»", 'she said "you nastyword', '5" and "nastyword" is'):
        assert weight(part) == 1.0, part


def test_levenshtein_automaton_against_table():
    from askloom.llm.lev_toxicity import Lexicon, edits

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + row[1:], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = {word(rng.randint(4, 13)): 1.0 for _ in range(40)}
    lexicon = Lexicon(terms, frozenset(), 0.5)
    for _ in range(600):
        w = word(rng.randint(3, 14))
        assert lexicon.near(w) == sorted((e, t) for t in terms if (e := distance(w, t)) <= edits(len(t)))


# ------------------------------------------------------------------------------ 6
PAGE = (
    '<html><head><title>t</title><style>p{}</style></head><body><nav><li>m</li></nav><div class="ad">buy</div>'
    '<article><h1>Ti&amp;tle</h1><p><b>one  two<br>x<br><p>a &lt; b &copy;</article><footer>f</footer>'
)


@pytest.mark.parametrize(
    "source, want",
    [
        (PAGE, "Ti&tle\none two x\na < b ©"), (None, ""), ("", ""), ("plain < text", "plain < text"),
        ("<script>var a='<p>no</p>'</script><p>yes", "yes"), ("<!-- <p>no</p> --><p>ok &am", "ok &am"),
        ('<div class="sidebar-2"><p>s</p></div><main><p>m</p><div id="comments"><p>c</p></div></main>', "m"),
    ],
)
def test_page_text(source, want):
    from askloom.llm.host_paths import Page

    assert Page(source or "").text([]) == want


def test_host_paths(spark):
    from askloom.llm.host_paths import extract

    page = lambda main, side: f'<body><div class="c{1}"><p>{main}</p></div><div class="box"><p>{side}</p></div></body>'
    rows = [(i, "http://h.net/%d" % i, page("main text " * 20, "note")) for i in range(5)]
    rows += [(9, "http://h.net/9", page("short", "long note " * 30)), (10, None, PAGE), (None, "x", None), (10, None, PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("paths", F.lit(1))
    got = sorted(((r.page_id, r.text) for r in extract(df).collect()), key=str)
    assert (9, "short") in got and len(got) == len(rows) and got.count((10, "Ti&tle\none two x\na < b ©")) == 2
    assert extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------ 7, 8
@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    from askloom.llm.byte_bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, tiktoken_encoding):
    from askloom.llm import byte_bpe as E

    ranks, known = tiktoken_encoding
    rng = random.Random(6)
    rows = ODD + [(100 + i, "".join(rng.choice("ab 's'tre l\n\t 1é中! ?") for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(900, "x" * 5000), (901, "'" * 300), (902, "<|endoftext|>'ll  \n\n"), (903, prose(rng, 4000))]
    got = E.decode(E.encode(docs_of(spark, rows), ranks), ranks).collect()
    want = sorted(((k, known.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in got), key=str) == want
    assert E.encode(docs_of(spark, []), ranks).count() == 0


def test_prefix_scan_is_composition():
    from askloom.llm.byte_bpe import _automaton, prefix_scan

    _, number, then, _ = _automaton()
    f = np.random.default_rng(0).choice(number, 5000).astype(np.int32)
    want = [f[0]]
    for x in f[1:]:
        want.append(then[want[-1], x])
    assert (prefix_scan(f, then, 64) == want).all()


def test_vocabulary_files_agree(tiktoken_encoding):
    import public_tokenizers

    from askloom.llm.byte_bpe import read_vocabulary

    assert read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")) == tiktoken_encoding[0]


def test_packing(spark):
    from askloom.llm.packing import Packer, cut, pack

    rng = random.Random(7)
    rows = [(i, [rng.randrange(50000) for _ in range(rng.choice([0, 1, 5, 90, 100, 101, 250, 300]))]) for i in range(300)] + [(None, None), (1, [7])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("key", F.lit(1))
    got = pack(df, size=100, open_bins=8).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    total = sum(len(x or []) for _, x in rows)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    ids = dict(rows[:300])
    for k in range(2, 300):
        want = [(p, s, n, zlib.crc32(np.array(ids[k][s : s + n], "<u4").tobytes())) for p, (s, n) in enumerate(cut(len(ids[k]), 100))]
        assert sorted(by[k]) == want
    one = Packer(10, 2)
    assert [one.place(n) for n in (6, 7, 4, 3, 8)] == [(0, 0), (1, 0), (0, 6), (1, 7), (2, 0)]
    assert pack(df.limit(0)).count() == 0


def test_packing_of_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from askloom.llm.queries import END_ID, packed_documents

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    rows = [(1, f"end {e} next"), (2, e), (3, f"{e}{e}'ll \n {e}"), (4, ""), (5, None), (6, f"é{e}é <|endoftext|"), (7, "plain text")]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packed_documents(docs_of(spark, rows).coalesce(1)).collect()}
    for k, t in rows:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, END_ID]
        assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# ------------------------------------------------------------------------------ 9
def brute_components(rows):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("all_pairs", [24, 2])
def test_superminhash(spark, monkeypatch, all_pairs):
    """With a small limit nearly every bucket takes the way of large ones: pivots, then strays."""
    from askloom.llm import superminhash
    from askloom.llm.superminhash import near_duplicates

    monkeypatch.setattr(superminhash, "ALL_PAIRS", all_pairs)
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " "), (4, "One two"), (5, "one  TWO"), (6, "one two three")]
    for g in range(12):  # groups of near copies, and chains in which only neighbours are alike
        base = prose(rng, rng.randint(20, 120), ["w%d" % i for i in range(4000)]).split()
        for c in range(rng.randint(1, 40) if g else 60):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "z%d" % rng.randrange(10**6)
            if g % 3 == 1:
                base = copy
            rows.append((100 + 100 * g + c, " ".join(copy)))
    got = near_duplicates(docs_of(spark, rows)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {k: (n, c, k == c) for k, (n, c) in want.items()}
    assert len(got) == len(rows)
    odd = near_duplicates(docs_of(spark, ODD + [(8, "lost words here"), (None, "never seen")])).collect()
    assert sorted((r.component_id, r.kept) for r in odd if r.doc_id is None and r.component_id) == [(8, False)]
    assert [r.kept for r in odd if r.doc_id is None and not r.component_id] == [True]
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_superminhash_links_of_a_crowded_bucket(spark):
    """600 documents of one template at 0.72; 30 pairs among them at 0.758 are found all the same."""
    from askloom.llm import superminhash as S

    rng = random.Random(12)
    shared, rows = prose(rng, 144, [f"s{i}" for i in range(900)]), []
    for i in range(600):
        pair = [f"p{i // 2}x{j}" for j in range(4)] if i < 60 else [f"q{i}x{j}" for j in range(4)]
        rows.append((i + 1, " ".join([shared, *pair, *[f"o{i}x{j}" for j in range(23)]])))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs_of(spark, rows)).collect()}
    want = {k: c for k, (_, c) in brute_components(rows).items()}
    assert {want[i] for i in range(1, 61)} == set(range(1, 61, 2)) and len(set(want.values())) == 570
    assert got == want


def test_superminhash_signature_is_unbiased():
    from askloom.llm.superminhash import super_min_hash

    rng = np.random.default_rng(9)
    off = []
    for n in (1, 3, 20, 300):
        for j in (0.2, 0.75):
            common = rng.integers(0, 2**63, max(1, round(2 * n * j / (1 + j)))).astype(np.uint64)
            a, b = (np.concatenate((common, rng.integers(0, 2**63, max(0, n - len(common))).astype(np.uint64))) for _ in "ab")
            sig = super_min_hash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            off.append((sig[0] == sig[1]).mean() - len(common) / (len(a) + len(b) - len(common)))
    assert np.abs(off).max() < 0.2 and abs(np.mean(off)) < 0.06


def test_components(spark):
    from askloom.llm.components import components

    rng = random.Random(10)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {k: v for k, v in up.items() if k in got} and set(got) >= {k for k, v in up.items() if k != v}


# ------------------------------------------------------------------------------ 10
def test_url_filters(spark):
    from askloom.llm.queries import RULES
    from askloom.llm.url_filters import judge_urls

    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://example.net/fr/"), (3, "https://x.org/fr/a"), (4, "http://net"), (5, None),
        (6, "no scheme/net/"), (7, "http://b.example.com/de/"), (8, "http://example.com/den"), (9, "a://b://c.net/x"), (3, "https://x.org/fr/a"),
        (None, "http://u.net/"), (11, "http://badexample.net/en/"), (12, "http://x.net/" + "y/" * 3000), (13, ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("prefix", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()), key=str)
    want = []
    for k, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(ASCII), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((k, host, path, best[1], best[2]))
    assert got == sorted(want, key=str)
    assert {r.verdict for r in judge_urls(df, rules.limit(0)).collect()} == {"allow"} and judge_urls(df.limit(0), rules).count() == 0


# ------------------------------------------------------------------------------ pipeline
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit(1))
    kept = [docs]
    for _, stage in P.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], FOLDER).persist())
        assert kept[-1].columns == docs.columns and kept[-1].exceptAll(kept[-2]).isEmpty()
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert {r.doc_id for r in kept[3].collect()} == {k for k, (_, c) in brute_components(rows).items() if k == c}
    assert {r.doc_id for r in P.best_fit_packing(spark, kept[3], FOLDER).select("doc_id").collect()} == {r.doc_id for r in kept[3].collect()}
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_queries_registered():
    from askloom.llm.queries import ORACLES, QUERIES

    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert html.unescape("&amp;") == "&" and pa.array([1])  # the libraries in use are there
