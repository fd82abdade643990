"""Golden rows of the text functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("day", "want"),
    [(date(2026, 9, 8), "2026-2027秋季"), (date(2027, 1, 15), "2026-2027秋季"), (date(2026, 2, 20), "2025-2026春季"), (date(2026, 7, 10), "2025-2026暑期")],
)
def test_semester(spark, day, want):
    assert one(spark, X.semester(F.col("d")), d=day) == want


def test_effective_semester(spark):
    assert one(spark, X.effective_semester(F.lit("发布学期"), F.col("d")), d="2026-13-40") == "长期有效"
    assert one(spark, X.effective_semester(F.lit("长期有效"), F.col("d")), d="2026-09-08") == "长期有效"


def test_clean_text(spark):
    text = "复旦大学 首页\n\n\n 正文一 \n浏览次数：\n10\n版权所有 2026\n\n\n正文二\u200b\n沪ICP备1号\n"
    assert one(spark, X.clean_text(F.col("t")), t=text) == "正文一\n\n正文二"
    assert one(spark, X.clean_text(F.col("t")), t="") == ""


def test_clean_text_twice_is_once(spark):
    c = X.clean_text(F.col("t"))
    once = one(spark, c, t=" a \n\n\n b\n\n")
    assert once == "a\n\nb" and one(spark, c, t=once) == once


def test_mask_order_and_truncation(spark):
    assert one(spark, X.mask_pii(F.col("t")), t="tel 13812345678 id 2130711000") == "tel [手机号] id [学号]"
    assert not any(ch.isdigit() for ch in one(spark, X.sanitize(F.col("t"), 12), t="call 13812345678 now"))


def test_locate_span(spark):
    c = X.locate_span(F.col("h"), F.col("n"))
    assert one(spark, c, h="a b  c\nd e", n="c d") == "c\nd"
    assert one(spark, c, h="abc", n="bc") == "bc"
    assert one(spark, c, h="abc", n=" ") is None
    assert one(spark, c, h="a.c", n="abc") is None


def test_json_object(spark):
    c = F.try_variant_get(X.json_object(F.col("t")), "$.a", "int")
    assert one(spark, c, t='said:\n```json\n{"a": 3}\n```') == 3
    assert one(spark, c, t="nothing") is None
    assert one(spark, c, t="[1]") is None


def test_names_and_dates(spark):
    assert one(spark, X.title_from_name(F.col("t")), t="方案（医学）.pdf_1a2b3c4d.pdf") == "方案（医学）"
    assert one(spark, X.safe_filename(F.col("t"), F.lit("f")), t=' a/b:\t "c" .PDF') == "ab c"
    assert one(spark, X.safe_filename(F.col("t"), F.lit("f")), t="???") == "f"
    assert one(spark, X.publish_date(F.col("t"), F.lit("-")), t="于2026年3月5日") == "2026-03-05"
    assert one(spark, X.strip_title_prefix(F.col("t")), t="培养 | 通知") == "通知"


def test_answer_residue(spark):
    assert one(spark, X.strip_residue(F.col("t")), t="请到图书馆前台办理。 其他问题") == "请到图书馆前台办理。"
    assert one(spark, X.strip_residue(F.col("t")), t="请到图书馆前台办理手续。返回 原图 /") == "请到图书馆前台办理手续。"
    assert one(spark, X.strip_residue(F.col("t")), t="好的 其他问题") == "好的 其他问题"
    assert one(spark, X.strip_leading_question(F.col("t")), t="在哪里提交？ 复旦大学图书馆网站提交即可") == "复旦大学图书馆网站提交即可"
    assert one(spark, X.fix_broken_tokens(F.col("t")), t="i map.exmail 5 0 MB the exam") == "imap.exmail 50 MB the exam"


def test_visible(spark):
    seen = lambda role, who: one(spark, X.visible(F.lit(who), F.lit("长期有效"), F.lit(role), F.lit("x")), a=1)
    assert seen("本科生", "本科生") and seen("访客", "全部") and not seen("访客", "教职工") and not seen("研究生", "本科生")


def test_char_ngrams(spark):
    assert sorted(one(spark, X.char_ngrams(F.col("t")), t="ababa")) == ["aba", "bab"]
    assert one(spark, X.char_ngrams(F.col("t")), t="ab") == []
