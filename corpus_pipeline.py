"""The corpus pipeline: five operators one after the other, each on all that the one before it kept.

Every stage takes documents with any further columns, which pass through, and gives an empty table for an empty
one. Null and empty texts are kept by all filtering stages: they are not toxic, have no lines to lose and link with
nothing; the mix takes them once if their source has a complete epoch, and they have no tokens. Rows with a null
doc_id are kept likewise. Equal rows count as one document where near duplicates go, and as several elsewhere.
Ties are settled by doc_id, then by the text's hash, so that reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotmark.llm import bpe, linededup, minhash, mixing, queries, toxicity
from lotmark.llm.common import free, shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject. Without labels of both kinds it rejects none."""
    return toxicity.grade(docs, table(spark, sf_dir, "labels")).where("not rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat a passage of three lines. Those that had words and lose all go."""
    out = linededup.dedup_lines(docs.drop("n_removed"))
    left = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    return out.where((F.col("n_removed") == 0) | left).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, and one row, of each group of near duplicates: that of the smallest doc_id."""
    return minhash.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, all of them whole, good ones first."""
    return mixing.mix(docs, score=mixing.fitted_quality(docs, table(spark, sf_dir, "labels")), whole=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, in place of its text, and the digest of what they decode to. Columns
    named ids, n_tokens or decoded_sha256 are replaced."""
    rest = docs.drop(*[c for c in docs.columns if c.lower() in ("n_tokens", "decoded_sha256")])
    text = free("_decoded", rest.columns)
    out = bpe.encode(rest, queries.vocabulary_path(), decoded=text)
    return out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("decoded_sha256", F.sha2(text, 256)).drop(text)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can't express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
