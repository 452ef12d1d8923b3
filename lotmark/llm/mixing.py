"""Mixing sources to target weights by Efraimidis-Spirakis sampling to word budgets.

A document's key is -ln(u) / quality with u a hash of its id and the seed, so the documents of a source in
order of key are a weighted sample without replacement, whatever its length. Quality is the probability that a
logistic regression gives, fitted on labelled documents, or a plain measure without labels. A source's budget is filled by
complete epochs over all its documents first, then along the keys, by prefix sums of sizes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotmark.llm import common
from lotmark.operators.linking import ranked

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST_EPOCHS = 3
#: Characters that prose has few of.
SYMBOLS = "#$%&*<>{}[]|\\^~"
#: Labelled documents that the quality model is fitted on, at most, its penalty, and the least quality that it gives.
SAMPLE, RIDGE, LEAST_QUALITY = 6_000, 1.0, 0.05


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Between 0.1 and 1: the less of the text is symbols, the higher; 1 for null and empty texts."""
    clean = F.length(F.translate(text, SYMBOLS, "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, F.greatest(F.lit(0.1), F.lit(1.0) - (F.lit(1.0) - clean) * 4)), F.lit(1.0))


def quality_features(text: Column) -> list[Column]:
    """Shares of marks and digits, of capitals, of spaces and of repeated lines, and the length; 0 without text. Each is a pass
    or two over the text, as they are made for every document."""
    n, lines = F.length(text), F.split(text, "\n")
    share = lambda chars: 1 - F.length(F.translate(text, chars, "")) / n
    found = [share(f"{SYMBOLS}!?0123456789"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1 - F.length(F.replace(text, F.lit(" "), F.lit(""))) / n, 1 - F.size(F.array_distinct(lines)) / F.size(lines), F.log(n + 1.0) / 10]
    return [F.coalesce(F.when(n > 0, c.cast("double")), F.lit(0.0)) for c in found]


def fitted_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Column:
    """A score for plan(): the probability that a document is a good one, from LEAST_QUALITY to 1, by a logistic regression on
    up to `sample` labelled documents (doc_id, quality 0 or 1), those with the smallest hashes of their id; without labels of
    both kinds, quality(). The fit sees its few numbers in order of id, so it comes out the same every time."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
    chosen = common.sampled(marks, sample, "doc_id")  # bounded, so it can be broadcast
    rows = docs.select("doc_id", *[c.alias(f"f{i}") for i, c in enumerate(quality_features(F.col("text")))]).join(F.broadcast(chosen), "doc_id").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    y = rows["good"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return quality(F.col("text"))
    x = np.hstack([np.ones((len(y), 1)), rows.filter(regex="^f[0-9]+$").to_numpy(dtype=float)])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[0] = 0.0
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
    z = F.lit(float(w[0]))
    for weight, c in zip(w[1:], quality_features(F.col("text")), strict=True):
        z = z + F.lit(float(weight)) * c
    return F.greatest(F.lit(LEAST_QUALITY), 1 / (1 + F.exp(-z)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size): one row per source.

    All sizes are shared by weight; a source stops at `most` times its size, and the excess goes to the others
    by weight until none is above. That is target = min(cap, level * weight): with the sources in order of
    cap / weight, the level is fixed by the first source that stays below its cap. Sources are as many as the data
    has, so they are numbered and summed up over ranges; caps are whole numbers, so their sums are exact.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    per = ranked(per, ["_null", "source"], "source_no").withColumn("source_no", F.col("source_no") - 1).drop("_null")
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", choose).withColumn("cap", (F.lit(int(most)) * F.col("source_size")).cast("long"))
    per = per.withColumn("_all", F.lit(0)).withColumn("_ratio", F.col("cap") / F.col("weight"))
    per = common.running(per, ["_all"], ["_ratio", "source_no"], ("cap", "weight"))
    per = common.checkpoint(per)
    total, weight = (per.agg(F.sum(c)).scalar() for c in ("source_size", "weight"))
    per = per.withColumn("_level", (total - F.col("cap_before")) / (weight - F.col("weight_before")))
    level = per.where("_level * weight <= cap").agg(F.min_by("_level", "rank")).scalar()
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", F.col("source_no").cast("int").alias("source_no"), "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, score: Column | None = None, whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, source, size, source_size, target, taken.

    `taken` is the words that the mix takes of the document, repeats counted: size for every complete epoch,
    and of the rest of the source's budget what is left when the documents before it, by key, are taken. So a
    source's taken words are its target rounded to whole words; the document at the end of the budget gives
    its first words. With `whole`, that document is taken whole or left, whichever brings the source nearer to its
    target, so no text is cut. `score` is the documents' weight in the sampling, above 0 (by default quality()).

    Null texts have size 0; a null source is a source, the last one. Documents with equal keys go by id and
    text; equal rows are interchangeable. An empty table gives an empty result. Extra columns are ignored.
    """
    weight = F.greatest(F.coalesce(quality(F.col("text")) if score is None else score, F.lit(1.0)), F.lit(1e-6))
    unit = (F.expr("xxhash64(doc_id, {})".format(int(seed))).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", words(F.col("text")).alias("size"), (-F.log(unit) / weight).alias("key"))
    narrow = common.checkpoint(narrow)
    per = common.checkpoint(targets(narrow, weights, most))
    keyed = narrow.join(per, narrow["source"].eqNullSafe(per["source"])).drop(per["source"])
    placed = common.running(keyed, ["source_no"], ["key", "doc_id", "text_hash"], ("size",))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    left = rest - F.col("size_before")
    part = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least("size", left)
    part = F.greatest(F.lit(0).cast("long"), part)
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    # cut where a word ends, so each part is white space and one word
    parts = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", (n + 1).cast("int"))
    return F.concat_ws("", F.slice(parts, F.lit(1), n.cast("int")))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, score: Column | None = None, whole: bool = False) -> DataFrame:
    """The mixed documents, with the columns of docs: each as often as its words are taken, and the document at
    the end of a source's budget shortened to its taken words, unless `whole`. n_chars, where docs has it, is made
    anew for it.

    Documents without words are in no budget: they come once if the source has a complete epoch, else not.
    """
    planned = plan(docs, seed, weights, most, score, whole)
    planned = planned.withColumn("full", F.expr("if(size > 0, taken div size, if(target >= source_size, 1, 0))"))
    planned = planned.withColumn("part", F.expr("if(size > 0, taken % size, 0)")).where("full > 0 or part > 0")
    # equal rows share an entry; each of them then takes its own place in it
    entry = ["doc_id", "text_hash", "source"]
    planned = planned.groupBy(*entry).agg(F.sort_array(F.collect_list(F.struct("full", "part")), asc=False).alias("uses"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("hash"))
    twins = Window.partitionBy("row.doc_id", "hash", "row.source").orderBy(F.lit(0))
    rows = rows.withColumn("twin", F.row_number().over(twins))
    used = rows.join(planned, F.expr("row.doc_id <=> doc_id and hash = text_hash and row.source <=> source"))
    used = used.select("row", F.expr("get(uses, twin - 1)").alias("use")).where("use is not null")
    lengths = F.expr("concat(array_repeat(-1L, int(use.full)), if(use.part > 0, array(use.part), array()))")
    used = used.select("row", F.explode(lengths).alias("n"))
    whole, text = F.col("n") < 0, F.col("row.text")
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.when(whole, text).otherwise(first_words(text, F.col("n")))}
    if "n_chars" in columns:
        made = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(made)
    return used.select(*[columns[c].alias(c) for c in docs.columns])
