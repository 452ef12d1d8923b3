"""From table cells to item, participant and bidder-detail candidates, on the long form of cells.

Each table row is made once, with the fields that a dictionary of aliases finds in its cells. A row that names
enough fields is a header, and holds for the rows below it until the next one: a running window, so a table may
change its columns on the way. Cells are read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.functions import codes, money, states
from lotmark.functions.text import compact, half_width, header_key, let, stems

#: Headers of item tables by field, the preferred ones first.
ITEM_HEADERS = {
    "package_code": ("采购包编号", "采购包号", "包编号", "包号", "标包编号", "标段编号", "标段号"),
    "product_name": ("标的名称", "标的物名称", "采购标的", "采购标的名称", "主要投标标的名称", "标项名称", "采购内容", "产品服务名称", "产品名称", "商品名称", "货物名称", "服务名称", "货物服务名称", "名称", "品名", "标的物"),
    "category": ("品目名称", "品目", "采购品目", "品目分类", "类别"),
    "brand": ("品牌", "品牌如有", "货物品牌", "品牌名称", "制造商品牌"),
    "model": ("规格型号", "规格型号如有", "货物型号", "规格说明", "规格", "型号"),
    "quantity": ("数量", "数量单位", "货物数量", "采购数量", "采购数量单位"),
    "unit_price": ("单价", "货物单价", "单价元"),
    "total_price": ("总价", "货物总价", "合价", "总金额", "成交金额", "中标金额", "中标成交金额", "金额"),
}
#: Headers of participant tables.
PARTICIPANT_HEADERS = {
    "package_code": ("采购包编号", "采购包号", "合同包号", "包号", "标包号", "标包", "标段号", "合同包", "采购包"),
    "name": ("投标人名称", "投标单位名称", "供应商名称", "供应商信息", "响应供应商", "供应商全称", "响应人名称", "响应单位名称", "投标人", "投标单位", "供应商", "响应人", "响应单位", "候选供应商", "中标供应商", "成交供应商"),
    "result": ("是否中标", "是否成交", "中标状态", "成交状态", "中标情况", "成交情况", "中标结果", "成交结果"),
    "amount": ("中标成交金额", "中标金额", "成交金额", "中标总金额", "成交总金额"),
    "reason": ("未中标原因", "未成交原因", "落标原因"),
    "qualification": ("资格审查", "资格性审查", "资格审查结果", "资格性审查结果"),
    "compliance": ("符合性审查", "符合性审查结果"),
}
#: Headers of tables of reviews and scores.
DETAIL_HEADERS = {
    "package_code": ("采购包编号", "采购包号", "合同包号", "包号", "标包号", "标段号"),
    "name": ("投标人名称", "投标单位名称", "供应商名称", "响应供应商", "投标人", "供应商", "响应人"),
    "qualification": ("资格审查", "资格性审查", "资格审查结果", "资格性审查结果"),
    "compliance": ("符合性审查", "符合性审查结果"),
    "review": ("评审结果", "审查结果", "评审情况"),
    "bid_amount": ("投标报价", "报价", "最终报价", "投标总价"),
    "score": ("综合得分", "总得分", "得分", "最终得分", "评审得分"),
    "reason": ("未通过原因", "未中标原因", "原因", "备注"),
}
#: Words that are a row's whole label, or stand before a colon, where it is no item; what refers to another paper.
NO_ITEM = (
    "中标情况", "成交情况", "评审专家名单", "序号", "包号", "合计", "总计", "小计", "备注", "说明", "注", "合同金额", "以下空白",
    "联系人", "联系方式", "联系电话", "联系地址", "收费标准", "采购代理机构",
)
BEFORE_COLON = ("联系人", "联系方式", "联系电话", "联系地址", "收费标准", "采购代理机构", "注")
REFERS = ("详见", "见", "具体见", "以")
PAPERS = ("附件", "文件", "清单", "响应", "为准")
#: What names no participant: whole cells, and phrases of reasons and scores.
NO_NAME = (
    "合计", "总计", "小计", "无", "暂无", "无供应商", "无投标人", "名称", "序号", "见附件", "联系方式", "联系人", "联系电话", "联系地址", "企业类型", "采购单位", "采购人", "采购代理机构", "代理机构",
    "中标金额", "成交金额", "未中标原因", "备注", "说明", "投标单位名称",
)
REASONS = ("综合得分", "评审得分", "未中标", "未成交", "不通过", "未通过", "不合格", "不符合", "得分较低", "报价低于", "报价较低", "报价偏高", "响应报价", "审查结果", "未满足")
#: Results that are lost or won, words for candidates, reasons that are none, failed reviews.
LOST, WON, CANDIDATE = ("未中标", "非中标", "未成交", "未获中标", "落标"), ("中标", "成交"), "候选"
NO, YES = ("否", "未是"), ("是", "已中标", "已成交")
NO_REASON = ("无", "暂无", "不适用", "—")
FAILED = ("不通过", "未通过", "不合格", "不符合")
#: Cells that say that a value isn't published.
UNPUBLISHED = "^(?:未公布|不公布|未公示|不公示|未披露|不披露|保密)$"
PRICES = ("unit_price", "total_price", "amount", "bid_amount")
TABLE = ("path", "table_no")


def aliases(spark: SparkSession, headers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, field, priority): a few dozen rows, whatever the data."""
    rows = [(word, field, n) for field, words in headers.items() for n, word in enumerate(words)]
    return spark.createDataFrame(rows, "word string, field string, priority int").select(header_key(F.col("word")).alias("key"), "field", "priority").distinct()


def rows(cells: DataFrame, headers: dict[str, tuple[str, ...]], needs: tuple[str, ...], least: int = 3) -> DataFrame:
    """(path, table_no, row_no, cells, columns, width): the rows below a header. cells maps column numbers to texts; columns maps
    each field of the nearest header above to its column and text; width is the number of that header's cells. A header names `least` fields, one of `needs` among
    them; of several columns for a field, it takes the preferred header's, then the first."""
    known = F.broadcast(aliases(cells.sparkSession, headers))
    keyed = cells.withColumn("key", header_key(F.col("text"))).join(known, "key", "left")
    keyed = keyed.repartition(*TABLE)  # the rows, and then the windows over tables, lie as they need to
    entry = F.struct("field", F.struct("priority", "col_no", "text").alias("c"))
    made = keyed.groupBy(*TABLE, "row_no").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("col_no", "text")))).alias("cells"), F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), entry))).alias("hits")
    )
    # the hits are sorted by field, then preference: of each field, the first stays
    first = F.expr("filter(hits, (h, i) -> i = 0 or hits[i - 1].field <> h.field)")
    made = made.select(*TABLE, "row_no", "cells", F.map_from_entries(F.transform(first, lambda h: F.struct(h["field"], h["c"]))).alias("found"))
    places = F.size(F.array_distinct(F.transform(F.map_values("found"), lambda c: c["col_no"])))
    needed = F.arrays_overlap(F.map_keys("found"), F.array(*[F.lit(n) for n in needs]))
    made = made.withColumn("header", F.when((places >= least) & needed, F.col("found")))
    above = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("width", F.when(F.col("header").isNotNull(), F.size("cells")))
    held = made.withColumns({name: F.last(of, ignorenulls=True).over(above) for name, of in (("columns", "header"), ("width", "width"))})
    return held.where("header is null and columns is not null").select(*TABLE, "row_no", "cells", "columns", "width")


def named(found: DataFrame, headers: dict[str, tuple[str, ...]], kept: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a column for each field, null where blank, `<field>_header` for prices, and evidence: a map of the
    fields with a cell to their header, column and text. Columns in kept stay."""
    cell = lambda f: F.nullif(F.col("cells")[F.col("columns")[f]["col_no"]], F.lit(""))
    fields = [cell(f).alias(f) for f in headers]
    heads = [F.col("columns")[f]["text"].alias(f"{f}_header") for f in headers if f in PRICES]
    said = F.map_filter(F.transform_values("columns", lambda f, c: F.struct(c["text"].alias("header"), (c["col_no"] + 1).alias("column"), F.col("cells")[c["col_no"]].alias("text"))), lambda f, v: v["text"] != "")
    return found.select(*TABLE, "row_no", *kept, *fields, *heads, said.alias("evidence"))


def cell_status(c: Column, has_column: Column) -> Column:
    """present, explicitly_not_published, blank_in_source, or unknown where the table has no such column."""
    return F.when(~has_column, "unknown").when(compact(c).rlike(UNPUBLISHED), "explicitly_not_published").when(F.coalesce(F.trim(c), F.lit("")) == "", "blank_in_source").otherwise("present")


def carried(column: str) -> Column:
    """The last package code at or above a row of its table."""
    frame = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return codes.package_code(F.last(column, ignorenulls=True).over(frame))


def is_item(label: Column) -> Column:
    """False for labels of sums, notes, contacts and numbered headings, for what refers to another paper, and for a header's own words."""
    text = F.trim(half_width(label))
    word = F.regexp_extract(text, "^([^:]*?)\\s*(?::|$)", 1)
    heading = text.rlike("^[一二三四五六七八九十百0-9]+\\s*[、)]")
    alone = word.isin(*NO_ITEM) & (F.contains(text, F.lit(":")) | ~word.isin(*BEFORE_COLON))
    elsewhere = text.rlike(f"^(?:{'|'.join(REFERS)})") & text.rlike("|".join(PAPERS))
    own = header_key(label).isin(*sorted({*ITEM_HEADERS["product_name"], *ITEM_HEADERS["category"]}))
    return F.coalesce(~(heading | alone | elsewhere | own) & (text != ""), F.lit(False))


def names_participant(name: Column) -> Column:
    """False for blanks, marks, labels, headers and phrases of reasons or scores."""

    def of(key: Column) -> Column:
        label = key.isin(*NO_NAME, *PARTICIPANT_HEADERS["name"]) | key.rlike("^(?:—*|详见.*)$")
        return ~label & ~key.rlike("|".join(REASONS))

    return F.coalesce(let(header_key(name), of), F.lit(False))


def items(cells: DataFrame) -> DataFrame:
    """Item candidates: code, names, quantity with unit, prices in yuan, and the status of each field. Rows need a name or a
    category and one more field; what is_item() refuses is none."""
    found = rows(cells, ITEM_HEADERS, ("product_name", "category"))
    found = named(found, ITEM_HEADERS)
    label = F.coalesce("product_name", "category")
    found = found.where(is_item(label))
    found = found.where(" + ".join(f"int({f} is not null)" for f in ITEM_HEADERS if f != "package_code") + " >= 2")
    number, unit = money.quantity(F.col("quantity"))
    return found.select(
        *TABLE, "row_no", carried("package_code").alias("package_code"), "product_name", "category", "brand", "model",
        number.alias("quantity"), unit.alias("quantity_unit"), money.amount(F.col("unit_price"), F.col("unit_price_header")).alias("unit_price"), money.amount(F.col("total_price"), F.col("total_price_header")).alias("total_price"), "evidence",
    )


def field_states(cells: DataFrame) -> DataFrame:
    """(path, table_no, row_no, field, status): what each item row says of each field, see cell_status()."""
    found = rows(cells, ITEM_HEADERS, ("product_name", "category"))
    each = [F.struct(F.lit(f).alias("field"), cell_status(F.col("cells")[F.col("columns")[f]["col_no"]], F.map_contains_key("columns", f)).alias("status")) for f in ITEM_HEADERS]
    return found.select(*TABLE, "row_no", F.explode(F.array(*each)).alias("s")).select(*TABLE, "row_no", "s.*")


def outcome(result: Column, reason: Column, amount: Column, *reviews: Column) -> Column:
    """nonwinner for a stated reason of failing, else what a result cell says, else nonwinner for a failed review, else winner for a
    stated amount, else unknown. A candidate for winning hasn't won; ranks and scores decide nothing."""
    has = lambda key, words: key.rlike("|".join(words))
    blamed = let(header_key(reason), lambda key: (key != "") & ~key.isin(*NO_REASON))
    said = lambda key: F.when(has(key, LOST) | key.isin(*NO), "nonwinner").when(has(key, WON) & ~F.contains(key, F.lit(CANDIDATE)) | key.isin(*YES), "winner")
    out = F.coalesce(F.when(blamed, "nonwinner"), let(header_key(result), said), *[F.when(has(header_key(r), FAILED), "nonwinner") for r in reviews])
    return F.coalesce(out, F.when(amount.isNotNull(), "winner"), F.lit("unknown"))


def participants(cells: DataFrame) -> DataFrame:
    """Participant candidates: code, name, outcome and, for winners, amount."""
    found = named(rows(cells, PARTICIPANT_HEADERS, ("name",)), PARTICIPANT_HEADERS).where(names_participant(F.col("name")))
    price = money.amount(F.col("amount"), F.col("amount_header"))
    how = outcome(F.col("result"), F.col("reason"), price, F.col("qualification"), F.col("compliance"))
    return found.select(*TABLE, "row_no", codes.package_code(F.col("package_code")).alias("package_code"), "name", how.alias("outcome"), F.when(how == "winner", price).alias("amount"))


def winners(cells: DataFrame) -> DataFrame:
    """Winners of key/value tables, whose rows are a label and a value: (path, table_no, name, amount). The name is the first
    value beside a supplier's label, the amount the first beside an amount's."""
    known = F.broadcast(aliases(cells.sparkSession, {f: PARTICIPANT_HEADERS[f] for f in ("name", "amount")}))
    widths = Window.partitionBy(*TABLE, "row_no")
    pairs = cells.withColumn("n", F.count("*").over(widths)).where("n = 2").groupBy(*TABLE, "row_no").agg(F.min_by("text", "col_no").alias("label"), F.max_by("text", "col_no").alias("value"))
    said = pairs.withColumn("key", header_key(F.col("label"))).join(known, "key").where("value <> ''")
    one = said.groupBy(*TABLE).agg(*[F.min(F.when(F.col("field") == f, F.struct("row_no", "value", "label"))).alias(f) for f in ("name", "amount")])
    return one.where("name is not null").select(*TABLE, F.col("name.value").alias("name"), money.amount(F.col("amount.value"), F.col("amount.label")).alias("amount"))


def bidder_details(cells: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Records of review and score tables: code, name, statuses, amount in yuan, score, reason, evidence.

    contexts (path, table_no, context) are the texts around tables, which may name the package and the unit. A failed
    review makes the whole review failed and gives its cell as the reason where none is stated; passed qualification
    and compliance make it passed. An amount without a unit in cell, header or context is null."""
    found = named(rows(cells, DETAIL_HEADERS, ("name",), 2), DETAIL_HEADERS).where(names_participant(F.col("name")))
    if contexts is not None:
        found = found.join(contexts.select(*TABLE, "context"), list(TABLE), "left")
    else:
        found = found.withColumn("context", F.lit(None).cast("string"))
    near = codes.nearby(F.col("context"))
    own = carried("package_code")
    unit = F.coalesce(money.unit(F.col("bid_amount")), money.table_unit(F.col("bid_amount_header"), F.col("context")))
    amount = F.when(unit.isNotNull(), money.amount(F.col("bid_amount"), unit))
    kinds = ("qualification", "compliance", "review")
    status = {k: states.review_status(F.col(k)) for k in kinds}
    failed = F.array_compact(F.array(*[F.when(status[k] == "未通过", F.col(k)) for k in kinds]))
    blamed = F.coalesce(compact(half_width(F.col("reason"))).rlike("不通过|未通过|不合格|不符合|无效") & F.col("reason").rlike("资格|符合性|审查|评审"), F.lit(False))
    review = F.when((F.size(failed) > 0) | blamed, "未通过").when((status["qualification"] == "通过") & (status["compliance"] == "通过"), "通过").otherwise(status["review"])
    reason = F.when(F.size(failed) > 0, F.array_join(F.array_distinct(F.array_compact(F.concat(F.array("reason"), failed))), "；")).otherwise(F.col("reason"))
    return found.select(
        *TABLE, "row_no", F.when(own != codes.DEFAULT, own).otherwise(near).alias("package_code"), "name", status["qualification"].alias("qualification"), status["compliance"].alias("compliance"),
        review.alias("review"), amount.alias("bid_amount"), money.strict(F.col("score")).alias("score"), reason.alias("reason"), "evidence",
    )


def package_aliases(docs: DataFrame) -> DataFrame:
    """(path, package_code, name): names that documents (path, text) give to their packages: lines that begin with a package and,
    after a colon, a name. A package with several names, or a name of several packages, has no alias."""
    lines = docs.select("path", F.explode(F.split(half_width(F.col("text")), "\n")).alias("line"))
    said = lines.select("path", F.trim(F.regexp_extract("line", "^([^:]{1,12}?包[^:]{0,8}):", 1)).alias("label"), F.trim(F.regexp_extract("line", ":\\s*(.+)$", 1)).alias("name")).where("label <> '' and name <> ''")
    label = F.trim(F.regexp_replace("label", f"(?:{'|'.join(codes.NAMES)})$", ""))
    named = said.select("path", codes.package_code(label).alias("package_code"), "name").where(F.col("package_code") != codes.DEFAULT).distinct()
    once = lambda df, key: df.withColumn("_n", F.count("*").over(Window.partitionBy("path", key))).where("_n = 1").drop("_n")
    return once(once(named, "package_code"), "name")


def attach(notices: DataFrame, attachments: DataFrame) -> DataFrame:
    """(path, notice): one row per row of attachments, with the only notice that shares a stem of its path with it; null
    where none or several notices do. Stems that all notices have count for nothing; a single notice gets everything.

    Each stem is one row before the join, so a stem of many notices and many attachments makes no pairs."""
    named = notices.groupBy(F.col("path").alias("notice")).agg(F.count("*").alias("copies"))
    total = named.agg(F.sum("copies").alias("total"), F.min("notice").alias("only"))
    keyed = named.select("notice", "copies", F.explode(stems(F.col("notice"))).alias("stem"))
    per = keyed.groupBy("stem").agg(F.sum("copies").alias("n"), F.min("notice").alias("notice"))
    per = per.where(F.col("n") < total.select("total").scalar())
    exploded = attachments.select("path").distinct().select("path", F.explode(stems(F.col("path"))).alias("stem"))
    met = exploded.join(per, "stem").groupBy("path").agg(F.max("n").alias("n"), F.min("notice").alias("a"), F.max("notice").alias("b"))
    met = met.where("n = 1 and a = b").select("path", F.col("a").alias("match"))
    out = attachments.select("path").join(met, "path", "left")
    single = total.select(F.when(F.col("total") == 1, F.col("only"))).scalar()
    return out.select("path", F.coalesce(single, "match").alias("notice"))


def metadata(docs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(path, field, value, line_no): the first line of each document (path, text) that holds `label: value` for a field.
    labels: field to alternatives, joined by |."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract("line", f"^\\s*(?:{words})\\s*[:：]\\s*(.+)$", 1)).alias("value")) for f, words in labels.items()]))
    found = lines.select("path", F.col("line_no").cast("long").alias("line_no"), each.alias("m")).where("m.value <> ''")
    first = found.groupBy("path", "m.field").agg(F.min(F.struct("line_no", "m.value")).alias("f"))
    return first.select("path", "field", F.col("f.value").alias("value"), F.col("f.line_no").alias("line_no"))
