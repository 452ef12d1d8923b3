"""Metadata against a plain reading of random texts."""

from __future__ import annotations

import random
import re
import unicodedata

from lotmark.operators import metadata

LABEL = {w: f for f, ws in metadata.LABELS.items() for w in ws}


def header(text):
    text = unicodedata.normalize("NFKC", " ".join(text.split())).lower()
    return re.sub("(?:亿元|万元|元)$", "", re.sub(r"[\s（）()【】\[\]：:，,、/\\_-]", "", text).replace("人民币", ""))


def money(value, label):
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?)(亿元|万元|元)?", re.sub(r"[\s,￥¥()]|人民币", "", unicodedata.normalize("NFKC", value)))
    if not m:
        return None
    unit = m[2] or ("亿元" if "亿元" in label else "万元" if "万元" in label else "元")
    return float(m[1]) * {"元": 1, "万元": 1e4, "亿元": 1e8}[unit]


def plainly(text):
    """field -> (value, status, line number)"""
    keys = {header(w): f for w, f in LABEL.items()}
    found = []
    for n, line in enumerate(text.split("\n"), 1):
        cells = line.rstrip(" ").split("\t")
        for i in range(0, len(cells) - 1, 2):
            if header(cells[i]) in keys and header(cells[i + 1]) not in keys:
                found.append((keys[header(cells[i])], cells[i + 1], cells[i], n))
    pattern = re.compile(f"({'|'.join(sorted(map(re.escape, LABEL), key=lambda w: -len(w)))})\\s*[：:]\\s*")
    for n, line in enumerate(text.split("\n"), 1):
        hits = list(pattern.finditer(line))
        for hit, following in zip(hits, [*hits[1:], None], strict=False):
            raw = line[hit.end() : following.start() if following else len(line)]
            raw = re.split(r"[\t；;。]|\s+[一-鿿]{2,16}\s*[：:]|\s*[一二三四五六七八九十]+\s*[、）)]|\s+\d+\s*[、）)]", raw, maxsplit=1)[0]
            found.append((LABEL[hit[1]], raw, hit[1], n))
    out = {}
    for field in metadata.LABELS:
        state = (None, "unknown", None)
        for f, raw, label, n in found:
            if f != field or state[1] == "present":
                continue
            value = " ".join(raw.split()).strip(" ：:，,。")
            if not value:
                new = (None, "blank_in_source", n)
            elif re.sub(r"[\s：:，,。；;、]+", "", value) in metadata.UNPUBLISHED:
                new = (None, "explicitly_not_published", n)
            elif re.match("(?:详?见|具体见|以).*(?:附件|文件|清单|响应|为准)", value):
                new = (None, "unverified", n)
            else:
                read = money(value, label) if field in metadata.AMOUNTS else re.split(r"[）)](?=.*(?:公告|采购项目))", value, maxsplit=1)[0] if field == "project_number" else value
                new = (read, "present", n) if read is not None else (None, "unverified", n)
            if new[1] in ("present", "explicitly_not_published") or state[1] == "unknown":
                state = new
        out[field] = state
    return out


def test_random_texts(spark):
    r = random.Random(5)
    words = [*LABEL, "乙方", "备注", "中标金额（万元）", "项目 名称"]
    values = ["", "名称甲", "12.5万元", "3,000元", "未公示", " 未公开。", "详见附件", "以合同为准", "A(1)的公告", "约10元", "1、x", "某公司 地址：x", "２元"]
    docs = []
    for d in range(250):
        lines = []
        for _ in range(r.randrange(6)):
            mark = r.choice(["：", ": ", "\t", "\t", " ", " ："])
            lines.append(r.choice(["", "x ", "一、", "\t"]) + r.choice(["\t", "；", " ", ""]).join(r.choice(words) + mark + r.choice(values) for _ in range(r.randrange(1, 4))) + r.choice(["", " ", "。"]))
        docs.append((f"p{d}", "\n".join(lines)))
    docs += [("null", None), ("empty", "")]
    got = {}
    for row in metadata.facts(spark.createDataFrame(docs, "path string, text string")).collect():
        got.setdefault(row.path, {})[row.field] = row
        if row.line_no is not None:
            assert row.evidence == dict(docs)[row.path].split("\n")[row.line_no - 1]
    assert len(got) == len(docs)
    for path, text in docs:
        for field, (value, status, line) in plainly(text or "").items():
            row = got[path][field]
            assert (row.status, row.line_no) == (status, line), (text, field, row)
            assert (float(row.value) == value if isinstance(value, float) else row.value == value), (text, field, row)
