"""Unit vectors of the text, date and privacy expressions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers, privacy, text
from quillspark.operators import anonymise, clean, extract, ranking, sampling


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c").alias("x")).first().x


@pytest.mark.parametrize("f, value, want", [
    (text.utrim, "　 a b\xa0", "a b"),
    (text.lines, "a\r\nb\x0bc\n", ["a", "b", "c"]),
    (text.lines, "a\n\n", ["a", ""]),
    (lambda c: text.without_leading_dots(c, r"\."), ".abc\n..  xyz\n   ...abc", "abc\nxyz\nabc"),
    (text.without_page_markers, "第1頁,共10頁\n內容\n第 1 頁 ， 共 2 頁", "內容"),
    (text.visible, "ＡＢ​Ｃ", "ABC"),
    (text.trimmed_lines, " 內容 \n。。\n\n ... ", "內容"),
    (text.without_inline_noise, "前 J<f 後", "前 Jf 後"),  # the mark goes before the pair is looked at
    (text.without_inline_noise, "前 J*f 後 ##", "前 後"),
    (text.joined_soft_wraps, "這是\n一行\n主旨：另起", "這是一行\n主旨：另起"),
    (text.joined_soft_wraps, "exam-\nple text\nnext。\nend", "example text next。\nend"),
    (text.joined_hard_wraps, "甲\n乙。\n丙\n\n丁\n1. 項", "甲 乙。\n丙  丁\n1. 項"),
    (text.joined_broken_lines, "甲\n乙。\n丙\n一、項", "甲 乙。\n丙\n一、項"),
    (text.fixed_digits, "O912 BOSS l0", "0912 BOSS 10"),
    (lambda c: text.fixed_digits(c, need_digit=False), "BOSS", "8055"),
    (text.collapsed_blanks, "a\n\n \n\nb", "a\n\nb"),
    (text.without_adjacent_repeats, "a\na\nb\n主旨\n主旨", "a\nb\n主旨\n主旨"),
    (text.corrected, "王旨：測試\r\n---\n 3  內容", "主旨:測試\n內容"),
    (text.html, "<a&b>", "&lt;a&amp;b&gt;"),
    (lambda c: text.short(c, 3), " abcd\n", "abc…"),
    (numbers.seconds, "2分15秒", 135.0), (numbers.seconds, "125.5秒", 125.5), (numbers.seconds, "3分", 180.0), (numbers.seconds, "", None), (numbers.seconds, "junk", None),
    (numbers.numeral, "十", 10), (numbers.numeral, "十三", 13), (numbers.numeral, "二十五", 25), (numbers.numeral, "兩", 2), (numbers.numeral, "366", None),
    (numbers.model_family, "qwen2.5:3b", "qwen2.5"), (numbers.model_family, "Llama3:8B", "llama3"), (numbers.safe_double, "x", None),
    (privacy.masked_id, "A123456789", "A123****89"), (privacy.masked_policy, "AB12345678", "AB1*****78"), (privacy.masked_policy, "AB12", "AB12"),
    (privacy.redacted_name, "王小明", "王○明"), (privacy.redacted_name, "歐陽小明", "歐○○明"), (privacy.redacted_name, "王", "○"),
    (lambda c: text.must_keep(c, F.lit(99)), "字A123456789", False), (lambda c: text.must_keep(c, F.lit(99)), "號 A123456789，", True),
    (lambda c: text.must_keep(c, F.lit(99)), "自114.01.02起", False), (lambda c: text.must_keep(c, F.lit(99)), "自 114.01.02 起", True),
    (privacy.valid_id, "A123456789", True), (privacy.valid_id, "A123456788", False), (privacy.valid_id, "a123456789", False),
    (privacy.mobile, "+886912000111", "0912000111"), (privacy.mobile, "02-1234", "02-1234"),
    (privacy.phone_fragment, "R: 09 12", "R: [PHONE_FRAGMENT:0912]"), (privacy.phone_fragment, "R: 1234567", "R: 1234567"),
    (lambda c: text.sentences(c), "甲。 乙！丙 丁", ["甲。", "乙！丙 丁"]),
])
def test_vectors(spark, f, value, want):
    assert one(spark, value, f) == want


def test_cleaners_settle(spark):
    t = spark.createDataFrame([(1, "第 1 頁 共 2 頁\n..主旨：請 J<f 查照\n裝\n訂\n線\n說明\n如下。"), (2, None), (3, "")], "doc_id bigint, text string")
    once = t.select("doc_id", clean.noise_free("text").alias("text"))
    again = once.select("doc_id", clean.noise_free("text").alias("text"))
    assert once.collect() == again.collect()
    assert {r.doc_id for r in clean.structured(t).collect()} == {1}


def test_rows_are_numbered_without_gaps(spark):
    t = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("g"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("s"))
    assert sorted(r.n for r in ranking.numbered(t, "s", out="n").collect()) == list(range(1000))
    by = ranking.numbered(t, "id", ["g"], "n").collect()
    assert all(r.n == (r.id // 3 if r.g else r.id - r.id // 3 - 1) for r in by)


def test_split_and_sample_cover_all_rows_once(spark):
    t = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "a").otherwise("b").alias("label"))
    s = sampling.stratified_split(t).groupBy("label").pivot("split").count().collect()
    assert {(r.label, r.train, r.valid, r.test) for r in s} == {("a", 280, 60, 60), ("b", 70, 15, 15)}
    p = sampling.per_category_sample(t, "label", "doc_id", {"b": 7}, n=5).collect()
    assert len(p) == 500 and sum(r.picked for r in p if r.label == "b") == 7 and sum(r.picked for r in p if r.label == "a") == 5
    assert sampling.parse_sizes("甲=5，乙=8") == {"甲": 5, "乙": 8}
    with pytest.raises(ValueError):
        sampling.parse_sizes("甲")


def test_spans_are_rewritten_over_segments():
    out = anonymise.rewrite_segments(["a 09", "12", "34 b"], [(1, 7, "X")])
    assert out == ["a X", "", " b"]


def test_summary(spark):
    t = spark.createDataFrame([(1, "扣押命令", "發文機關：臺北地方法院\n主旨：請扣押\n要保人：王小明 A123456789\n於7日內函覆")], "doc_id bigint, class string, text string")
    r = extract.summaries(t, "2025-08-30").first()
    assert r.who[0].name == "王○明" and r.ids == ["A1******89"] and r.urgency.due_date == "2025-09-06"
