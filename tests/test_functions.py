"""Scalar functions on values that the tables don't hold."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotmark.functions import codes, money, states, text
from lotmark.sources import documents

PACKAGES = {
    None: "default", "": "default", "unknown": "default", " NULL ": "default", "包号": "default", "详见附件": "default", "见招标文件": "default",
    "合同包1": "1", "包号：01": "1", "A包": "A", "A标段": "A", "第一包": "1", "合同包十一": "11", "A-02": "A-02", "包名：二": "2", "标段名称：第一标段": "1",
    "豫政采(2)20260817-2": "2", "豫政采（2）20260817-3": "3", "采购包 编号: 3": "3", "２": "2", "分包名称：医疗设备": "医疗设备", "包名称：附件": "default", "一百零五": "105", "二十": "20", "some prose": "some prose",
}


def values(spark, cells, *make, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    rows = df.select("i", *[m(F.col("c")).alias(f"v{n}") for n, m in enumerate(make)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(make) > 1 else r[1] for r in rows]


def test_package_codes(spark):
    assert dict(zip(PACKAGES, values(spark, PACKAGES, codes.package_code), strict=True)) == PACKAGES
    assert values(spark, ["12", "A-02", "医疗设备", None], codes.is_named) == [False, False, True, False]


def test_chinese_numbers(spark):
    cases = {"十": "10", "十二": "12", "两百": "200", "三千零五": "3005", "一万二千": "12000", "007": "7", "0": "0", "B1": "B1", "": ""}
    assert values(spark, cases, codes.chinese_number) == list(cases.values())


def test_amounts(spark):
    cells = ["¥1,234.50元", "１２万元", "0.5亿元", "(30)", "12%", "约100", "", None, "-3"]
    assert values(spark, cells, money.amount) == [Decimal(x) if x else None for x in ("1234.500000", "120000.000000", "50000000.000000", "30.000000", None, None, None, None, "-3.000000")]


def test_numbers(spark):
    cells = ["1,234", "1,23", "1e3", "人民币1.5万元", "abc", " 7 ", "9007199254740993.01"]
    got = values(spark, cells, lambda c: money.number(c, True))
    assert got == [None if x is None else Decimal(x) for x in ("1234", None, "1000", "15000", None, "7", "9007199254740993.01")]
    assert values(spark, ["1万"], money.number) == [None]


def test_exact_sum_keeps_undisclosed_apart(spark):
    rows = [("a", None), ("a", ""), ("b", "n/a"), ("b", None), ("c", "0.10"), ("c", "0.10"), ("c", "9007199254740993.01"), ("c", "x")]
    out = dict(spark.createDataFrame(rows, "k string, v string").groupBy("k").agg(money.exact_sum(F.col("v"))).collect())
    assert out == {"a": None, "b": 0, "c": Decimal("9007199254740993.21")}


def test_canonical_rounding_and_tolerance(spark):
    assert values(spark, ["1.500", "2.000", "0.0", "10", "100.010"], lambda c: money.canonical(c.cast("decimal(20,3)"))) == ["1.5", "2", "0", "10", "100.01"]
    assert values(spark, ["26750", "26650"], lambda c: money.ten_thousands(c.cast("decimal(20,2)"))) == [Decimal("2.68"), Decimal("2.67")]
    pairs = spark.createDataFrame([("1.00", "1.01"), ("1.00", "1.02"), (None, None), (None, "1")], "a string, b string")
    assert [r[0] for r in pairs.select(money.equal(money.exact(F.col("a")), money.exact(F.col("b")))).collect()] == [True, False, True, False]


def test_names_and_space(spark):
    assert values(spark, ["Ａ公司　（北京）", "Straße ", " ", None], text.name_key) == ["a公司(北京)", "strasse", None, None]
    assert values(spark, ["a　 b\xa0c", "  ", "x"], text.collapse) == ["a b c", "", "x"]
    assert values(spark, ["page 2", "page 10", "page 1"], text.natural_key) == ["page 000000000002", "page 000000000010", "page 000000000001"]
    assert values(spark, ["单价(元)", "总 价：万元", "规格/型号"], text.header_key) == ["单价", "总价", "规格型号"]


@pytest.mark.parametrize(("url", "ok"), [("https://a.example.org/x", True), ("http://example.org:80", True), ("http://example.org:8080/", False), ("ftp://example.org/", False), ("http://u@example.org/", False), ("http://notexample.org/", False), (None, False), ("", False)])
def test_allowed_urls(spark, url, ok):
    assert values(spark, [url], lambda c: text.allowed(c, ["example.org"])) == [ok]


def test_visible_text_and_links(spark):
    html = "<!-- no --><p>a&nbsp;b &lt;c&gt;</p><script>x()</script><a class='k' href=\"/u#f\">l</a><A HREF=\"/u\">m</A>"
    assert values(spark, [html], text.visible) == ["a b <c> l m"]
    assert values(spark, [html], text.links) == [["/u"]]


def test_warnings_and_reviews(spark):
    said = ["源附件不可用：x", "ZIP/OOXML 内容损坏", "附件容器展开失败", "压缩成员读取失败", "暂不支持附件格式", "PDF 解析失败：x", "OCR 未启用", "本地 RapidOCR 已识别 3 页", "仅提取文本", "保留来源，不抽取", "?"]
    want = "source_unavailable source_corrupt archive_failure archive_member_failure unsupported_format parser_failure ocr_skipped ocr_review partial_fallback role_skipped other".split()
    assert values(spark, said, states.warning_category) == want
    assert values(spark, ["通过", "不通过", "符合", "不 符合", "", None], states.review_status) == ["通过", "未通过", "通过", "未通过", None, None]


def test_field_states(spark):
    rows = [("v", "present", True, "present"), ("v", "present", False, "unverified"), ("v", None, True, "unverified"), (None, "blank_in_source", True, "blank_in_source"), ("", "blank_in_source", False, "unknown"), (None, "present", True, "unverified"), (None, "odd", True, "unknown"), (None, "unknown", True, "unknown")]
    df = spark.createDataFrame(rows, "v string, s string, e boolean, want string")
    assert all(r[0] == r[1] for r in df.select(states.field_state(F.col("v"), F.col("s"), F.col("e")), "want").collect())


def test_formats(spark):
    files = [b"%PDF-1.7", b"PK\x03\x04x", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"{\\rtf1", b"Rar!\x1a\x07\x00", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"BMx", b" \n<!DOCTYPE html>", b"<TABLE>", b"text", b"", None]
    want = ["pdf", "zip", "ole", "rtf", "rar", "png", "jpg", "bmp", "html", "html", "unknown", "unknown", "unknown"]
    assert values(spark, [None if f is None else bytearray(f) for f in files], documents.detected, kind="binary") == want
