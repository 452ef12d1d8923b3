"""Toxicity as ordered grades: cumulative-link regression on sparse word features.

P(grade > k) = sigmoid(w . x - t_k): one weight vector for all thresholds t_1 < t_2 < t_3, so the score is a
single severity and the grades share what is learnt. The expected severity is the sum of these probabilities.

Features are the words of a text and the first letters of its words, which catch inflected and compound
forms. No feature has a negative weight: nothing that a text adds makes it less severe.

It is fitted on a bounded sample of labelled documents, those with the smallest hashes of their id; every feature
that LEAST_DOCS of them have is used. Labels say toxic or not; a toxic document's grade, 1 to 3, is the third
of the toxic sample that its amount of telling features falls in, where telling features are those that toxic
documents have far more often. So the grades above 1 come from the texts, as no label has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotmark.llm import common

#: Labelled documents that the fit uses, at most.
SAMPLE = 6_000
#: Documents of the sample that have a feature, at least; with fewer, its odds say nothing.
LEAST_DOCS = 5
#: How much more often toxic documents have a feature, as a logarithm, at least; and what makes it telling.
LEAST_ODDS, TELLING_ODDS = 1.0, 2.0
GRADES = 4
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7)
#: Words that a task remembers, and bytes of text whose words it counts at a time.
CACHE, CHUNK_BYTES = 100_000, 1_000_000
#: Penalties of the two passes of the fit, times the root of the sample's size and times its size, as chance
#: agreement with the labels shrinks with it; and the share of the largest weight that makes a feature stay.
SPARSITY, RIDGE, SUPPORT = 0.03, 0.06, 0.02
#: Expected severity from which a document is rejected.
REJECT = 0.3
#: What stands between words: all but letters and their marks.
BETWEEN = r"[^\p{L}\p{M}]+"


@dataclass
class Model:
    """thresholds ascending; features with weight 0 are left out."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (50.0, 51.0, 52.0)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


class Known(dict):
    """The numbers of each word's features. `names` holds the features by number: those that are given, or, without
    any, all that come up."""

    def __init__(self, names: list[str] | None = None):
        super().__init__()
        self.fixed, self.names = names is not None, list(names or [])
        self.number = {f: i for i, f in enumerate(self.names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        found = features(word)
        if not self.fixed:
            for f in found:
                if f not in self.number:
                    self.number[f] = len(self.names)
                    self.names.append(f)
        self[word] = out = tuple(self.number[f] for f in found if f in self.number)
        return out


def counts(texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, n): how often each text has each known feature, in lower case. Each distinct word of the texts is
    looked at once."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), BETWEEN)
    coded = parts.flatten().dictionary_encode()
    row, code = np.asarray(pc.list_parent_indices(parts)).astype(np.int64), np.asarray(coded.indices).astype(np.int64)
    found = [known[w] if w else () for w in coded.dictionary.to_pylist()]
    many = np.array([len(f) for f in found], dtype=np.int64)
    flat = np.array([i for f in found for i in f], dtype=np.int64)
    if not len(flat):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start = np.cumsum(many) - many
    row, code = row[many[code] > 0], code[many[code] > 0]
    each = many[code]
    at = np.repeat(start[code] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    width = int(flat.max()) + 1
    cell, n = np.unique(np.repeat(row, each) * width + flat[at], return_counts=True)
    return cell // width, cell % width, n


def value(n):
    return 1.0 + np.log(n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _descend(rows, cols, x, grade, width, sparsity=0.0, ridge=0.0, steps=1500):
    """Weights and thresholds by accelerated proximal gradient, on the mean loss over documents and thresholds."""
    n = len(grade)
    above = (grade[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    w, t = np.zeros(width), -np.log(share / (1 - share))
    vw, vt, momentum = w, t, 1.0
    # the step is the inverse of the loss's largest curvature, found by power iteration
    v, size = np.ones(width + 1), 1.0
    for _ in range(30):
        z = np.bincount(rows, weights=v[:-1][cols] * x, minlength=n) + v[-1]
        v = np.append(np.bincount(cols, weights=z[rows] * x, minlength=width), z.sum()) / n
        size = np.linalg.norm(v)
        v = v / size
    rate = 1 / (0.3 * size + ridge)
    for _ in range(steps):
        score = np.bincount(rows, weights=vw[cols] * x, minlength=n)
        error = _sigmoid(score[:, None] - vt[None, :]) - above
        gw = np.bincount(cols, weights=error.mean(axis=1)[rows] * x, minlength=width) / n + ridge * vw
        new_w = vw - rate * gw
        new_w = np.maximum(new_w - rate * sparsity, 0)
        new_t = np.sort(vt + rate * error.mean(axis=0))
        new_momentum = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw = new_w + (momentum - 1) / new_momentum * (new_w - w)
        vt = new_t + (momentum - 1) / new_momentum * (new_t - t)
        w, t, momentum = new_w, new_t, new_momentum
    return w, np.sort(t)


def fit_grades(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. A first pass with a penalty on the weights' absolute values chooses the words, a
    second fits these alone, almost without penalty, as the first pulls weights towards 0."""
    w, _ = _descend(rows, cols, x, grade, width, sparsity=SPARSITY / np.sqrt(len(grade)))
    chosen = np.flatnonzero(np.abs(w) >= max(SUPPORT * np.abs(w).max(initial=0), 1e-9))
    place = np.full(width, -1)
    place[chosen] = np.arange(len(chosen))
    here = place[cols] >= 0
    small, t = _descend(rows[here], place[cols[here]], x[here], grade, len(chosen), ridge=RIDGE / len(grade), steps=6000)
    out = np.zeros(width)
    out[chosen] = small
    return out, t


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on up to `sample` labelled documents. Without labels of both kinds, the model rejects nothing.

    Labels with a null id or a null toxic are left out; an id with several labels is toxic if one says so; an id
    with several documents has the words of all.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = common.sampled(marks, sample, "doc_id")  # bounded, so it can be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in common.chunks(batch, size=CHUNK_BYTES):
                row, feature, n = counts(part.column("text"), known)
                ids, toxic = (part.column(c).take(pa.array(row)) for c in ("doc_id", "toxic"))
                each, at = np.unique(feature, return_inverse=True)
                words = pa.array([known.names[f] for f in each], pa.string()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, toxic, words, pa.array(n)], names=["doc_id", "toxic", "word", "n"])

    seen = common.checkpoint(texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, word string, n long"))
    totals = seen.select("doc_id", "toxic").distinct().toPandas()
    n1 = int(totals["toxic"].sum())
    n0 = len(totals) - n1
    if not n0 or not n1:
        return Model()
    per_word = seen.groupBy("word").agg(F.sum("toxic").alias("d1"), F.count("*").alias("d"))
    odds = F.log((F.col("d1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("d") - F.col("d1") + 0.5) / F.lit(n0 + 1.0))
    per_word = per_word.where(F.col("d") >= LEAST_DOCS).select("word", "d", odds.alias("odds"))
    # bounded by the sample's words
    known = per_word.where(F.col("odds") >= LEAST_ODDS).toPandas().sort_values("word", ignore_index=True).reset_index(names="col")
    use = spark.createDataFrame(known[["word", "col"]].astype({"col": int}), "word string, col int") if len(known) else None
    if use is None:
        return Model()
    cells = seen.join(F.broadcast(use), "word").groupBy("doc_id", "col").agg(F.sum("n").alias("n")).toPandas()
    place = {d: i for i, d in enumerate(sorted(totals["doc_id"]))}
    toxic = np.zeros(len(place), dtype=int)
    toxic[totals["doc_id"].map(place)] = totals["toxic"]
    cells = cells.sort_values(["doc_id", "col"])
    rows, cols, n = cells["doc_id"].map(place).to_numpy(), cells["col"].to_numpy(), cells["n"].to_numpy()
    # of features that occur in the same documents, one stays: the longest
    mark = np.random.default_rng(1).integers(1, 1 << 62, size=len(place))
    docs_of = np.zeros(len(known), dtype=np.int64)
    np.bitwise_xor.at(docs_of, cols, mark[rows])
    by_length = np.argsort(-known["word"].str.len().to_numpy(), kind="stable")
    _, first = np.unique(docs_of[by_length], return_index=True)
    stays = np.zeros(len(known), dtype=bool)
    stays[by_length[first]] = True
    rows, cols, n = rows[stays[cols]], cols[stays[cols]], n[stays[cols]]
    telling = known["odds"].to_numpy() > TELLING_ODDS
    told = np.bincount(rows, weights=value(n) * telling[cols], minlength=len(place))
    cuts = np.quantile(told[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, told), 0)
    w, t = fit_grades(rows, cols, value(n), grade, len(known))
    return Model({word: float(v) for word, v in zip(known["word"], w, strict=True) if v}, tuple(map(float, t)))


def score(docs: DataFrame, model: Model, name: str = "severity") -> DataFrame:
    """docs with `severity`, the expected grade from 0 to 3, of each whole text; a column of that name is replaced.

    Null and wordless texts have the severity of a text without known words. Rows neither move nor merge.
    """
    docs = docs.drop(name)
    weights, thresholds = model.weights, np.array(model.thresholds)
    texts = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = Known(sorted(weights)), np.array([weights[f] for f in sorted(weights)])
        for batch in batches:
            for part in common.chunks(batch, size=CHUNK_BYTES):
                row, feature, n = counts(part.column(texts), known)
                z = np.bincount(row, weights=w[feature] * value(n), minlength=part.num_rows) if len(row) else np.zeros(part.num_rows)
                severity = _sigmoid(z[:, None] - thresholds[None, :]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(severity)], names=[*part.schema.names, name])

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def grade(docs: DataFrame, labels: DataFrame, reject: float = REJECT, sample: int = SAMPLE) -> DataFrame:
    """docs with severity and rejected (severity at least `reject`), by a model fitted on their labels.

    An empty table gives an empty result. Extra columns pass through; severity and rejected are replaced.
    """
    scored = score(docs.drop("rejected"), fit(docs, labels, sample))
    return scored.withColumn("rejected", F.col("severity") >= reject)
