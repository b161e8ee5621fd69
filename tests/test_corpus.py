import itertools
import random

from pyspark.sql import functions as F

from askloom.functions import folds
from askloom.operators import chunking as C
from askloom.operators import dedup as D
from askloom.operators import pages as P
from askloom.operators.runs import running
from askloom.sources import tables as S


def grams(t):
    return {t[i:i + 3] for i in range(len(t) - 2)}


def brute_keep_first(texts, threshold=0.95):
    kept = []
    for i, t in enumerate(texts):
        g = grams(t)
        if g and any(len(g & grams(texts[j])) / len(g | grams(texts[j])) >= threshold for j in kept if grams(texts[j])):
            continue
        kept.append(i)
    return kept


def test_keep_first_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for doc in range(6):
        base = [" ".join(word() for _ in range(rng.choice([3, 20, 60, 120]))) for _ in range(5)]
        texts = []
        for _ in range(40):
            t = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        texts += ["", "ab", "ab"]
        rows += [(doc, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc int, pos int, text string")
    got = {}
    for r in D.keep_first(df, ["doc"], "pos", "text").collect():
        got.setdefault(r["doc"], []).append(r["pos"])
    for doc in range(6):
        texts = [t for d, _, t in rows if d == doc]
        assert sorted(got[doc]) == brute_keep_first(texts)


def test_keep_first_is_not_transitive(spark):
    base = "".join(chr(0x4E00 + i) for i in range(200))
    a, b = base, base[:198] + "甲乙"
    c = b[:190] + "丙" + b[191:196] + "甲乙丁戊"
    ja = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    assert ja(a, b) >= 0.95 and ja(a, c) < 0.95
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([a, b, c])], "doc int, pos int, text string")
    assert sorted(r["pos"] for r in D.keep_first(df, ["doc"], "pos", "text").collect()) == brute_keep_first([a, b, c])


def py_pack(units, limit):
    out, buf, size = [], [], 0
    for u in units:
        if size + len(u) > limit and buf:
            out.append("\n\n".join(buf))
            buf, size = [u], len(u)
        else:
            buf.append(u)
            size += len(u)
    return out + (["\n\n".join(buf)] if buf else [])


def test_pack_and_merge_around_thresholds(spark):
    sizes = [10, 99, 100, 700, 801, 1499, 1501, 3001, 1, 1499, 1500, 2]
    units = ["x" * n for n in sizes]
    df = spark.createDataFrame([(units,)], "u array<string>")
    assert df.select(folds.pack(F.col("u"), 1500)).first()[0] == py_pack(units, 1500)
    merged = df.select(folds.merge_tiny(F.col("u"))).first()[0]
    assert merged == ["x" * 10 + "\n\n" + "x" * 99, "x" * 100, "x" * 700, "x" * 801, "x" * 1499, "x" * 1501, "x" * 3001, "x", "x" * 1499, "x" * 1500, "xx"]


def test_chunking_chinese_structure(spark):
    text = "校训\n第一章 总则\n第一条 目的。\n第二条 范围。\n第二章 学籍\n" + "内容" * 60 + "\n第三章 附则\n短。"
    df = spark.createDataFrame([(1, text), (2, "甲段。\n\n乙段。"), (3, "  ")], "document_id bigint, text string")
    rows = C.chunk_documents(df).orderBy("document_id", "parent_id", "child_no").collect()
    one = [r for r in rows if r["document_id"] == 1]
    assert one[0]["parent_id"] == "p0" and "校训" in one[0]["parent_content"]
    assert any(r["child_content"] == "第二条 范围。" for r in one)
    two = [r for r in rows if r["document_id"] == 2]
    assert [r["child_content"] for r in two] == ["甲段。", "乙段。"]
    assert {r["child_id"] for r in two} == {"p0_c0", "p0_c1"}
    assert not [r for r in rows if r["document_id"] == 3]
    pre = C.chunk_documents(df.where("document_id = 2"), prefix=F.lit("s3_")).first()
    assert pre["parent_id"] == "s3_p0"


def test_sentences(one):
    assert one("甲。乙！ 丙？丁", C.sentences) == ["甲。", "乙！", "丙？", "丁"]
    long = "子" * 500 + "，" + "丑" * 400 + "。"
    assert [len(s) for s in one(long, C.sentences)] == [501, 401]


def test_page_classes_follow_runs(spark):
    pages = ["正文" * 60, "目录目录目录 page list of contents", "a ... 1\nb ... 2\nc ... 3", "正文" * 80, "参考文献 list of works cited here", "[1] x\n[2] y\n[3] z and a long tail to pass fifty characters, really", "正文" * 80,
             "附录：补充材料的说明文字放在这里以便测试长度", "表一" * 30, "正文" * 300]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc_id bigint, page_no int, text string")
    got = [r["page_class"] for r in P.classify_pages(df).orderBy("page_no").collect()]
    assert got == [None, "toc", "toc", None, "references", "references", None, "appendix", "appendix", None]


def test_paragraph_fold(spark):
    paras = ["某出版社", "正文一" * 40, "目录", "第一章 1", "正文二" * 40, "参考文献", "[1] a", "正文三" * 40, "附录", "表", "长" * 501, "版权所有 某校", ""]
    got = P.paragraph_fold(spark.createDataFrame([(1, paras)], "doc_id bigint, paragraphs array<string>")).first()["keep"]
    assert got == [1, 4, 6, 7, 10]  # one line alone does not look like references


def test_running_blocks_equal_plain_window(spark):
    from pyspark.sql import Window

    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 9)) for g in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    got = running(df, ["g"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") > 7, F.col("i")))}, block=16)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.max(F.when(F.col("v") > 7, F.col("i"))).over(w).alias("m"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def py_merge(sizes, minimum=2000):
    cur = [[s] for s in sizes]
    while True:
        out, i, changed = [], 0, False
        while i < len(cur):
            if sum(cur[i]) < minimum and i + 1 < len(cur):
                out.append(cur[i] + cur[i + 1])
                i += 2
                changed = True
            else:
                out.append(cur[i])
                i += 1
        cur = out
        if not changed:
            return [sum(c) for c in cur]


def test_merge_small_sections_equals_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(20):
        sizes = [rng.choice([0, 10, 500, 1500, 1999, 2000, 5000]) for _ in range(rng.randint(1, 40))]
        want[doc] = py_merge(sizes)
        rows += [(doc, i + 1, i + 1, f"t{i}", "", i, i, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id bigint, entry_no bigint, number bigint, title string, category string, start_page bigint, end_page bigint, chars bigint")
    got = {}
    for r in C.merge_small_sections(df).orderBy("doc_id", "section_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chars"])
    assert got == want


def test_files_with_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("学生手册".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("学生手册".encode("gbk"))
    (tmp_path / "c.md").write_bytes(b"caf\xe9")
    (tmp_path / "d.xlsx").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in S.read_text_files(spark, f"file://{tmp_path}/*").collect()}
    assert got["a.txt"] == got["b.txt"] == "学生手册" and got["c.md"] == "café" and "d.xlsx" not in got


def test_split_groups_from_names(spark):
    df = spark.createDataFrame([("a_part01.pdf", ""), ("a_part2.pdf", None), ("b.pdf", ""), ("c_part1.pdf", "set")], "filename string, split_group_id string")
    assert [r[1] for r in C.split_group_from_name(df).collect()] == ["a", "a", "", "set"]


def test_templated_lines_take_a_constant_number_of_jobs(spark):
    """Lines of one template that are no duplicates of each other: the work does not go round by round."""
    from askloom.operators import dedup as D

    def jobs(n):
        lines = [(1, i, f"Invoice number {i * 7919 % 100000:05d} total paid") for i in range(n)]
        before = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"templated-{n}", "count jobs")
        kept = D.keep_first(spark.createDataFrame(lines, "doc_id long, line_no int, line string"), ["doc_id"], "line_no", "line")
        assert kept.count() == n
        found = len(before.getJobIdsForGroup(f"templated-{n}"))
        spark.sparkContext.setJobGroup("rest", "")
        return found

    assert jobs(3000) <= jobs(300) + 10


def test_keep_first_follows_chains(spark):
    """A is like B, B is like C, A is unlike C: B drops, and C stays because B is not kept."""
    from askloom.operators import dedup as D

    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    a, b, c = base, base[:-3] + "XYZ", base[:-6] + "PQRXYZ"
    rows = [(1, 0, a), (1, 1, b), (1, 2, c)] + [(2, i, base + "tail %d" % (i // 200)) for i in range(200)]
    kept = D.keep_first(spark.createDataFrame(rows, "doc_id long, line_no int, line string"), ["doc_id"], "line_no", "line", 0.9)
    got = sorted((r.doc_id, r.line_no) for r in kept.collect())
    def grams(t):
        return {t[i : i + 3] for i in range(len(t) - 2)}

    want = []
    for doc in (1, 2):
        held = []
        for d, n, t in rows:
            if d == doc and not any(len(grams(t) & g) / len(grams(t) | g) >= 0.9 for g in held):
                held.append(grams(t))
                want.append((d, n))
    assert got == want


def test_a_mean_confidence_at_the_limit_is_kept_in_any_order(spark):
    """Mean 0.6 of four lines, whose sum comes out just below 2.4 in some orders of adding them."""
    orders = list(itertools.permutations([0.5, 0.59, 0.59, 0.72]))
    assert any((((a + b) + c) + d) / 4 < 0.6 for a, b, c, d in orders)
    rows = [(doc, 0, n, "recognised line of text", c) for doc, order in enumerate(orders) for n, c in enumerate(order)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no long, line_no long, text string, confidence double").coalesce(1)
    assert {r.verdict for r in P.recognized_pages(lines).collect()} == {"kept"}
