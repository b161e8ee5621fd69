import math
import random

from pyspark.sql import functions as F

from askloom.functions import vector as V
from askloom.operators import answers as A
from askloom.operators import lexical as L
from askloom.operators import questions as Q
from askloom.operators import retrieval as R
from askloom.operators import vectors as VS


def corpus(n=50, seed=5):
    rng = random.Random(seed)
    words = ["w" + str(i) for i in range(40)]
    return [" ".join(rng.choices(words, weights=range(40, 0, -1), k=rng.randint(1, 30))) for _ in range(n)]


def brute_bm25(q, docs, k1=1.5, b=0.75):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    out = []
    for i, t in enumerate(toks):
        s = 0.0
        for w in q.split():
            df = sum(w in x for x in toks)
            if df:
                tf = t.count(w)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if round(s, 4) > 0:
            out.append((round(s, 4), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))]


def test_bm25_equals_brute_force(spark):
    docs, qs = corpus(), ["w1 w2 w2 w39", "w5", "zz w0", "nothing here"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(qs)), "query_id int, question string")
    got = {}
    for r in L.bm25_search(q, d, 7, ["doc_id"]).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for i, text in enumerate(qs):
        want = brute_bm25(text, docs)[:7]
        assert [x for x, _ in got.get(i, [])] == [x for x, _ in want]
        assert all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(got.get(i, []), want))


def test_bm25_survives_many_question_blocks(spark, monkeypatch):
    docs = corpus(30, 9)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    q = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "query_id int, question string")
    want = L.bm25_search(q, d, 3, ["doc_id"]).collect()
    monkeypatch.setattr(L, "QUESTION_BLOCK", 3)
    monkeypatch.setattr(L, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(L, "TILE_ROWS", 4)
    assert sorted(want) == sorted(L.bm25_search(q, d, 3, ["doc_id"]).collect())


def test_vector_topk_equals_cosine_and_ties(spark):
    rng = random.Random(2)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    vecs += [(100 + i, vecs[3][1]) for i in range(20)] + [(200, [0.0] * 8)]
    chunks = spark.createDataFrame(vecs, "id int, embedding array<float>").repartition(5)
    qs = spark.createDataFrame([(i, vecs[i][1]) for i in range(10)], "query_id int, qvec array<float>")
    pairs = qs.join(chunks).select("query_id", "id", V.cosine(F.col("qvec"), F.col("embedding")).alias("score"))
    want = L.top_k(pairs, 5, [F.desc("score"), "id"])
    for block in (1024, 3):
        got = VS.vector_scores_topk(qs, chunks, 5, ["id"], block=block)
        assert sorted(got.select("query_id", "id", "rank").collect()) == sorted(want.select("query_id", "id", "rank").collect())


def test_few_questions_scan_vectors_without_packed_tiles(spark, monkeypatch):
    """Small slices against a loop, with ties, a window and a minimum; no tile of a whole batch is built, and late slices give on little."""
    rng = random.Random(6)
    vecs = [(i, i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300 + i, i, [1.0, 1.0, 0.0, 0.0]) for i in range(40)]
    chunks = spark.createDataFrame(vecs, "id int, at long, embedding array<float>").coalesce(1)
    qs = spark.createDataFrame([(i, 100 + 10 * i, vecs[i][2]) for i in range(9)], "query_id int, asked long, qvec array<float>")
    pairs = qs.join(chunks).select("query_id", "id", "at", "asked", V.cosine(F.col("qvec"), F.col("embedding")).alias("score"))

    def packed(*_):
        raise AssertionError("packed")

    monkeypatch.setattr(VS, "_pack_chunks", packed)
    monkeypatch.setattr(VS, "SCAN_ROWS", 7)
    want = L.top_k(pairs, 5, [F.desc("score"), "id"])
    got = VS.vector_scores_topk(qs, chunks, 5, ["id"], block=4)
    assert sorted(got.select("query_id", "id", "rank").collect()) == sorted(want.select("query_id", "id", "rank").collect())
    within = pairs.where("at < asked and asked < at + 50 and score >= 0.2")
    want = L.top_k(within, 5, [F.desc("score"), "id"])
    got = VS.vector_scores_topk(qs, chunks, 5, ["id", "at"], block=4, window=("asked", "at", 50), minimum=0.2)
    assert sorted(got.select("query_id", "id", "rank").collect()) == sorted(want.select("query_id", "id", "rank").collect())
    given = VS._scanned(qs, chunks, 5, ["id"], "qvec", "embedding", 4, None, None).count()
    assert 9 * 5 <= given < 9 * 5 * 49 / 2  # 49 slices of at most 7 rows


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, document_id bigint, parent_id string, child_id string, split_group_id string, score double, rank bigint")


def test_rrf_keys_on_document_and_parent(spark):
    a = hits(spark, [(1, 1, "p0", "p0_c0", "g", 0.9, 1), (1, 2, "p0", "p0_c1", "g", 0.8, 2)])
    b = hits(spark, [(1, 2, "p0", "p0_c3", "g", 0.9, 1), (1, 3, "p0", "p0_c0", "g", 0.1, 2)])
    one = {r["document_id"]: r for r in R.rrf([a, b], 10).collect()}
    two = {r["document_id"]: r for r in R.rrf([b, a], 10).collect()}
    assert len(one) == 3 and one[2]["rank"] == 1 and one[2]["score"] == 1.0
    assert {k: r["rrf_score"] for k, r in one.items()} == {k: r["rrf_score"] for k, r in two.items()}
    assert one[2]["child_id"] == "p0_c1" and two[2]["child_id"] == "p0_c3"


def test_diversity_reserves_two_per_group(spark):
    rows = [(1, i, "p0", "c", "group_A" if i < 4 else "group_B", 1 - i / 10, i) for i in range(1, 6)]
    order = [r["document_id"] for r in R.diversify(hits(spark, rows)).orderBy("rank").collect()]
    assert order == [1, 2, 4, 5, 3]
    same = [(1, i, "p0", "c", "g", 1 - i / 10, i) for i in range(1, 4)]
    assert [r["document_id"] for r in R.diversify(hits(spark, same)).orderBy("rank").collect()] == [1, 2, 3]


def test_quality_filter_tiers(spark):
    rng = random.Random(4)
    body = ["".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(5)]
    rows = [(1, i, "p", "c", "", s, i + 1, t) for i, (s, t) in enumerate(zip([0.8, 0.5, 0.3, 0.1, 0.05], body))]
    rows += [(2, i, "p", "c", "", s, i + 1, t) for i, (s, t) in enumerate(zip([0.8, 0.2, 0.1], body))]
    rows += [(3, i, "p", "c", "", s, i + 1, "short") for i, s in enumerate([0.8, 0.5, 0.3, 0.1])]
    df = spark.createDataFrame(rows, "query_id int, document_id bigint, parent_id string, child_id string, split_group_id string, score double, rank bigint, content string")
    got = {}
    for r in R.quality_filter(df).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 2, 3], 2: [1, 2], 3: [1, 2, 3]}


def test_roles(spark):
    df = spark.createDataFrame([(r, v) for r in ("student", "teacher", "admin", "guest") for v in ("public", "internal", "confidential", None)], "role string, visibility string")
    n = {r["role"]: r["n"] for r in R.filter_by_role(df).groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert n == {"student": 2, "teacher": 3, "admin": 4}


def test_intents(spark):
    qs = ["你好", "奖学金的申请条件和要求是什么", "怎么办理休学", "图书馆电话", "天气情况如何呀今天外面的风大不大呢", "这句话没有任何关键字而且也比较长一些"]
    df = spark.createDataFrame(list(enumerate(qs)), "query_id int, question string")
    got = {r["query_id"]: (r["intent"], r["confidence"]) for r in Q.classify(df).collect()}
    assert got[0] == ("chat", 0.95) and got[1][0] == "policy" and got[2][0] == "process" and got[3][0] == "fact"
    assert got[4][0] == "process" and got[5] == ("unknown", 0.5)


def test_expansion_and_replies(one):
    assert one("学籍注册", Q.expand) == "学籍注册 档案 休学 入学 报到 办理"
    assert one("谢谢你", Q.canned_reply).startswith("不客气")
    assert one("a，b、、c\nd", Q.parse_keyword_list) == ["a", "b", "c"]


def test_retrieve_end_to_end(spark):
    texts = ["奖学金评定办法：学生综合测评优秀者可申请奖学金，名额有限。", "宿舍管理规定：学生应按时归寝，不得留宿外人。", "图书馆借阅规则：每人可借阅十本图书，期限三十天。", "军训安排：新生入学后进行两周军事训练。"]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "document_id bigint, text string")
    chunks = docs.select("document_id", F.lit("p0").alias("parent_id"), F.lit("p0_c0").alias("child_id"), F.col("text").alias("child_content"), F.lit("").alias("split_group_id"), V.hashed_embedding(F.col("text")).alias("embedding"))
    parents = docs.select("document_id", F.lit("p0").alias("parent_id"), F.col("text").alias("parent_content"))
    info = docs.select("document_id", F.concat(F.lit("f"), "document_id").alias("filename"), F.when(F.col("document_id") == 2, "internal").otherwise("public").alias("visibility"))
    qs = spark.createDataFrame([(1, "奖学金怎么申请"), (2, "图书馆可以借阅多少图书"), (3, "宿舍管理规定")], "query_id int, question string")
    top = {r["query_id"]: r for r in R.retrieve(qs, chunks, parents, info, 3).where("rank = 1").collect()}
    assert top[1]["document_id"] == 1 and top[2]["document_id"] == 3 and top[3]["document_id"] == 2 and top[1]["source"] == "f1"
    student = R.retrieve(qs, chunks, parents, info, 3, role="student")
    assert student.where("document_id = 2").count() == 0


def test_prompt_text(spark):
    q = spark.createDataFrame([(1, "问"), (2, "无")], "query_id int, question string")
    ctx = spark.createDataFrame([(1, 1, "文件", 0.876, "内容")], "query_id int, rank bigint, source string, score double, content string")
    hist = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1, 9)] + [(1, 0, "summary", "摘要")], "query_id int, turn int, role string, content string")
    got = {r["query_id"]: r["prompt"] for r in A.prompts(q, ctx, hist, "m1").collect()}
    assert got[1].startswith("对话历史摘要：\n摘要\n\n最近对话：\n助手: t3\n用户: t4") and "t2" not in got[1]
    assert "[来源 1] 文件 (相关度：0.88)\n内容\n" + "-" * 30 + "\n" + "=" * 50 in got[1] and got[1].endswith("【模型：m1】")
    assert got[2].startswith("用户问题：无") and got[2].endswith("回答:")


def test_verification_cases(spark):
    rows = [(1, "", "ctx"), (2, "我不确定，据说是这样的，也许可以吧同学们请再确认", "别的内容"), (3, "学生可以申请奖学金并且需要提交材料给学院审核[来源：1]", "学生可以申请奖学金并且需要提交材料给学院审核")]
    df = spark.createDataFrame(rows, "id int, answer string, context string")
    got = {r["id"]: r for r in A.verify(df).collect()}
    assert not got[1]["is_valid"] and got[1]["issues"] == ["答案为空"]
    assert not got[2]["is_valid"] and len(got[2]["issues"]) == 3
    assert got[3]["is_valid"] and got[3]["has_citation"] and got[3]["context_coverage"] > 0.7


def test_judge_text(one):
    for text, want in {"是\n无\nx": 0.9, "是\n有": 0.7, "否\n无": 0.4, "否：\n有": 0.2, "???": 0.2}.items():
        assert one(text, A.judge_confidence) == want
