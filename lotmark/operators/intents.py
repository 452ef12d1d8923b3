"""Questions as data: intents are checked by plain rules and lead to the scenes' DataFrames, never to query text."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.operators import clues, scenes
from lotmark.sources.tables import Model

SCENES = ("buyer_awardees", "buyer_bidders", "supplier_co_bidders", "common_buyers", "common_projects")
#: Other names of kinds of clues. The last two are short forms of this library.
KIND_NAMES = {"all": "all", "common": "common_bidding", "co-bidding": "common_bidding", "repeat": "repeat_cooperation", "distribution": "supplier_distribution", "network": "buyer_network", "pairs": "common_bidding", "cooperation": "repeat_cooperation"}
#: What a question may not hold. Words of query languages with what follows them, names of such languages, and words that ask to write.
STATEMENTS = {"select": "\\s+.+\\s+from", "match": "\\s*\\(", "create": "\\s+", "delete": "\\s+", "drop": "\\s+", "update": "\\s+", "merge": "\\s+", "insert": "\\s+", "cypher": "", "sql": "\\b"}
ORDERS = ("删除", "修改", "执行命令")
BEGUN = "写入"
FORBIDDEN_FIELDS = ("sql", "cypher", "query", "statement", "raw_query")
MOST_SUPPLIERS = 50


def suspicious(question: Column) -> Column:
    """True for a question that holds a statement of a query language or its name, or asks to write. `select` and `match` alone are
    words like others; 写入 counts where a word begins."""
    parts = [*(f"{word}{rest}" for word, rest in STATEMENTS.items()), *ORDERS, f"\\b{BEGUN}"]
    return F.coalesce(question.rlike(f"(?isU){'|'.join(parts)}"), F.lit(False))


def has_forbidden_fields(intent_json: Column) -> Column:
    """True for the JSON text of an intent that isn't an object or has a field for query text."""
    keys = F.json_object_keys(intent_json)
    return F.coalesce(keys.isNull() | F.arrays_overlap(keys, F.array(*[F.lit(f) for f in FORBIDDEN_FIELDS])), F.lit(True))


def kind(name: str | None) -> str:
    """A kind of clue by any of its names; without a name, all."""
    key = (name or "all").strip().casefold()
    known = {k: k for k in clues.KINDS} | {k.replace("_", "-"): k for k in clues.KINDS} | KIND_NAMES
    if key not in known:
        raise ValueError(f"unknown kind {name}; there are all, {', '.join(clues.KINDS)}")
    return known[key]


@dataclass(frozen=True)
class Intent:
    """A scene with what it needs. Dates and amounts are checked, but no scene filters by them."""

    scene: str
    buyer_id: int | None = None
    supplier_id: int | None = None
    supplier_ids: tuple[int, ...] = ()
    start_date: date | None = None
    end_date: date | None = None
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    include_winners: bool = True
    top: int = 5

    def __post_init__(self) -> None:
        if self.scene not in SCENES:
            raise ValueError(f"unknown scene {self.scene}")
        if not 1 <= self.top <= scenes.TOP:
            raise ValueError(f"top must be from 1 to {scenes.TOP}")
        if any(i < 1 for i in (*self.supplier_ids, *(x for x in (self.buyer_id, self.supplier_id) if x is not None))):
            raise ValueError("ids are positive")
        if len(set(self.supplier_ids)) != len(self.supplier_ids):
            raise ValueError("supplier_ids must be distinct")
        if self.supplier_ids and not 2 <= len(self.supplier_ids) <= MOST_SUPPLIERS:
            raise ValueError(f"supplier_ids must be 2 to {MOST_SUPPLIERS}")
        for low, high in ((self.start_date, self.end_date), (self.min_amount, self.max_amount)):
            if low is not None and high is not None and low > high:
                raise ValueError("a range must not end before it begins")
        needed = {"buyer_awardees": self.buyer_id, "buyer_bidders": self.buyer_id, "supplier_co_bidders": self.supplier_id}.get(self.scene, self.supplier_ids)
        if not needed:
            raise ValueError(f"{self.scene} lacks its ids")

    def unsupported(self) -> list[str]:
        return [n for n in ("start_date", "end_date", "min_amount", "max_amount") if getattr(self, n) is not None]


def execute(model: Model, intent: Intent) -> DataFrame:
    """The scene's rows for the intent. Filters that no scene has are refused rather than ignored."""
    if intent.unsupported():
        raise ValueError(f"no scene filters by {', '.join(intent.unsupported())}")
    if intent.scene == "buyer_awardees":
        return scenes.buyer_awardees(model.bids, model.items, model.organizations).where(F.col("buyer_id") == intent.buyer_id)
    if intent.scene == "buyer_bidders":
        return scenes.buyer_bidders(model.bids, model.organizations, intent.top, intent.include_winners).where(F.col("buyer_id") == intent.buyer_id)
    if intent.scene == "supplier_co_bidders":
        return scenes.co_bidders(model.bids, intent.include_winners).where(F.col("supplier_id") == intent.supplier_id)
    ids = list(intent.supplier_ids)
    return scenes.common_buyers(model.bids, ids) if intent.scene == "common_buyers" else scenes.common_packages(model.bids, ids)


def sources(model: Model, intent: Intent, limit: int = 100) -> DataFrame:
    """(project_id): the newest projects that take part in the scene."""
    won, all_ = scenes.awards(model.bids), scenes.selected(model.bids, intent.include_winners)
    if intent.scene in ("buyer_awardees", "buyer_bidders"):
        rows = (won if intent.scene == "buyer_awardees" else all_).where(F.col("buyer_id") == intent.buyer_id)
    elif intent.scene == "supplier_co_bidders":
        rows = won.where(F.col("organization_id") == intent.supplier_id)
    else:
        by, base = ("buyer_id", won) if intent.scene == "common_buyers" else ("package_id", model.bids)
        picked = base.where(F.col("organization_id").isin(list(intent.supplier_ids)))
        common = picked.groupBy(by).agg(F.count_distinct("organization_id").alias("n")).where(F.col("n") == len(intent.supplier_ids))
        rows = picked.join(common.select(by), by, "left_semi")
    return rows.select("project_id").distinct().orderBy(F.desc("project_id")).limit(limit)
