"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotmark.llm import common


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide, from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the least -ln(draw) / weight. A shard of double weight gets double the records; when one
    is added, records move only into it, and when one goes, only its own move. Equal scores, which 52 bits
    make rare, go to the lower shard; shards of weight 0 get nothing."""
    scores = [F.struct((-F.log(draw(key, s)) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", added: float = 1.0) -> DataFrame:
    """One row per row of docs: the key, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text in UTF-8 plus 1 (a null text: 1); text_crc32 of the same bytes (a null text: of
    none). slot numbers a shard's rows from 0 without gaps, in order of key, checksum and size. grown_shard is
    the shard when one more, of weight `added`, stands last.

    A null key is a key like any other. Rows with equal keys go to the same shard, each with a slot of its
    own. An empty table gives an empty result; extra columns are ignored.
    """
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), [*weights, added]).alias("grown_shard"),
    )
    placed = common.running(narrow, ["shard"], [key, "text_crc32", "size"])
    return placed.select(key, "size", "text_crc32", "law", "shard", F.col("rank").cast("long").alias("slot"), "grown_shard")
