from askloom import constants as K
from askloom.functions import text as X
from askloom.functions import vector as V


def test_tokens_words_and_cjk_bigrams(one):
    assert one("Hello, a World_1!", X.tokens) == ["hello", "world_1"]
    assert one("奖学金 GPA要求", X.tokens) == ["奖学", "学金", "gpa", "要求"]
    assert one("如何申请", X.tokens) == ["何申", "申请"]  # a stop word goes


def test_shingles_and_similarity(one):
    assert one("abcd", X.shingles) == ["abc", "bcd"]
    assert one("ab", X.shingles) == []
    assert one("aé😀b", X.shingles) == ["aé😀", "é😀b"]


def test_coarse_clean_steps(one):
    raw = "标题　行\n=====\n2024-01-02\n12\n- 3 -\nPage 1 of 9\n第 3 页 共 9 页\n学生应当遵守\n规定 的 要求\n<del>旧</del>正文  结束\n\n\n\n\n尾"
    out = one(raw, X.coarse_clean)
    for gone in ("=====", "2024-01-02", "Page 1", "- 3 -", "第 3 页", "旧", "  "):
        assert gone not in out
    assert "标题行学生应当遵守规定的 要求" in out
    assert out.endswith("\n\n尾")
    assert one("  \n ", X.coarse_clean) == "" and one(None, X.coarse_clean) == ""


def test_boilerplate_is_cut(one):
    assert one("正文\n版权所有©（2024）某校保留\n后文", X.coarse_clean) == "正文\n\n后文"
    assert "Copyright" not in one("text Copyright © 2024 x", X.coarse_clean)


def test_headings_clauses_lists(one):
    cases = {"第一章 总则": 1, "一、目": 0, "一、目的": 2, "1. 适用范围": 3, "1.2 小节标题": 3, "## 标题文字": 3, "普通一行文字": 0, "（1）条目": 3}
    for line, level in cases.items():
        assert one(line, X.heading_level) == level, line
    assert one("第三条 学生", X.is_clause_start) and one("（二）内容", X.is_clause_start)
    assert not one("学生第三条", X.is_clause_start)
    assert one("• 条目", X.is_list_item) and not one("-条目", X.is_list_item)


def test_quality_score(one):
    assert one("短", X.quality_score) == 0.0
    assert one("12 34 56 78 90 12", X.quality_score) == 0.05
    assert one("明\n德\n厚\n学\n求\n是\n笃\n行", X.quality_score) == 0.08
    assert one("学" * 90 + "，" * 10, X.quality_score) > 0.6


def test_token_estimates(one):
    assert one("学生abcd", X.tokens_by_script) == 4
    assert one("", X.tokens_by_script) == 0 and one("a", X.tokens_by_script) == 1
    assert one("abcde", X.tokens_half_length) == 2


def test_masks_and_names(one):
    assert one("13812345678", X.mask_middle) == "1381***5678"
    assert one("short", X.mask_middle) == "*****" and one(None, X.mask_middle) == "********"
    assert one("abcdefghij", X.mask_key) == "abcd***ghij" and one("abcd", X.mask_key) == "abcd"
    assert one("../../etc/pass wd?.txt", X.sanitize_filename) == "passwd_.txt"
    assert one("", X.sanitize_filename) == "unnamed_file"
    assert len(one("x" * 300 + ".pdf", X.sanitize_filename)) == 255
    assert one("aaa bbb ccc", lambda c: X.truncate_at_space(c, 9)) == "aaa..."
    assert one("password: hunter2 sk-" + "a" * 24, X.redact_secrets) == "password=[REDACTED] sk-[REDACTED]"
    assert one("<script>x</script>", X.has_xss) and one("a onclick = 1", X.has_xss) and not one("plain text", X.has_xss)


def test_cosine_zero_and_hashed_embedding(spark, one):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    e = one("alpha beta alpha", V.hashed_embedding)
    assert len(e) == 64 and sum(abs(x) for x in e) in (1.0, 3.0)
    assert one("", V.hashed_embedding) == [0.0] * 64


def test_fixed_tables():
    assert len(K.SYNONYMS) == 24 and len(K.XSS_PATTERNS) == 17
