"""States of fields, sources and warnings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a saved field state may be.
STATES = ("present", "explicitly_not_published", "blank_in_source", "unverified", "unknown")


def field_state(value: Column, saved: Column, evidence: Column) -> Column:
    """The state of a field from its value, its saved state and whether it has complete evidence. Nothing is imputed:
    a value without evidence is unverified, and no value without evidence of its absence is unknown."""
    filled = value.isNotNull() & (value.cast("string") != "")
    known = F.coalesce(saved.isin(*STATES), F.lit(False))
    backed = F.coalesce(evidence, F.lit(False))
    return (
        F.when(filled, F.when(known & (saved == "present") & backed, "present").otherwise("unverified"))
        .when(~known, "unknown")
        .when(saved.isin("explicitly_not_published", "blank_in_source"), F.when(backed, saved).otherwise("unknown"))
        .when(saved.isin("present", "unverified"), "unverified")
        .otherwise("unknown")
    )


def source_status(distinct_hashes: Column) -> Column:
    """One hash of a source: available; several: ambiguous; none: not_saved."""
    return F.when(distinct_hashes == 1, "available").when(distinct_hashes > 1, "ambiguous").otherwise("not_saved")


def review_status(c: Column) -> Column:
    """通过, 未通过 or null, of a review's cell."""
    text = F.regexp_replace(c, "(?U)\\s+", "")
    return F.when(text.rlike("不通过|未通过|不合格|不符合|否决|无效"), "未通过").when(text.rlike("通过|合格|符合|有效"), "通过")


#: Categories of warnings in order, each with alternatives of words that must all be there.
WARNINGS = (
    ("source_unavailable", (("源附件不可用",),)),
    ("source_corrupt", (("gzip 内容损坏",), ("zip/ooxml 内容损坏",), ("ole 文档损坏",), ("压缩包损坏或格式无效",))),
    ("archive_failure", (("附件容器展开失败",), ("压缩包没有可读取成员",))),
    ("archive_member_failure", (("压缩成员读取失败",),)),
    ("unsupported_format", (("暂不支持附件格式",),)),
    ("parser_failure", (("解析失败：",), ("旧版 word 转换失败",), ("pdf pypdf 流解析失败", "备用解析也失败"), ("pdf pypdf 流解析失败", "备用解析失败"))),
    ("ocr_no_text", (("未识别到可信文本",),)),
    ("ocr_failure", (("ocr", "失败"), ("ocr", "超时"), ("ocr", "未安装"), ("ocr", "缺少"), ("ocr", "语言参数无效"))),
    ("ocr_skipped", (("ocr", "未启用"), ("ocr", "已启用但未找到"), ("ocr", "每份 pdf 最多 ocr"))),
    ("ocr_review", (("rapidocr 已识别",),)),
    ("partial_fallback", (("pdf 表格解析失败",), ("pdfplumber 备用解析成功",), ("pypdf 文本读取失败",), ("仅提取文本",))),
    ("format_mismatch", (("实际为",), ("扩展名", "按内容"))),
    ("role_skipped", (("参考采购材料",), ("保留来源", "不抽取"))),
)


def warning_category(c: Column) -> Column:
    """The first category whose words a warning holds, else other."""
    text = F.lower(c)
    out = None
    for name, ways in WARNINGS:
        hit = None
        for words in ways:
            every = F.lit(True)
            for word in words:
                every = every & F.contains(text, F.lit(word))
            hit = every if hit is None else hit | every
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")
