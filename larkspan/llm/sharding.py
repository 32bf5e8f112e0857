"""Weighted rendezvous hashing of record keys over shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered

#: Buckets a shard is cut into when its rows are numbered; a bucket is sorted in one task.
SLOT_BUCKETS = 4096


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard that a key falls to: the one whose weighted score for that key is highest.

    A shard's score depends on the key, the shard's number and its weight alone: -weight / ln(u), with u in (0, 1) from a
    64-bit hash. So a shard gets keys in proportion to its weight, a new shard takes keys only into itself, and a shard
    that goes leaves the other keys where they are. A weight of 0 takes nothing. A null key hashes as a value of its own;
    ties, which need equal 53-bit hashes, go to the higher number.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a weight above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None, text: str = "text") -> DataFrame:
    """Deal `df` over shards by `key` and number each shard's rows gaplessly from 0.

    Adds size (UTF-8 bytes plus 1; null text: 1), text_crc32 (null text: 0), shard, grown_shard (where the key goes under
    `grown_weights`; null without) and slot. The text itself is not shuffled. Repeated rows are kept, each with a slot of its
    own; a null key is a key of its own; an empty table gives an empty result. Other columns of `df`, of any names, are not
    carried, and a text of any length is one size and one checksum.
    """
    source = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = source.withColumns(
        {
            "shard": rendezvous([F.col("doc_id")], weights),
            "grown_shard": rendezvous([F.col("doc_id")], grown_weights) if grown_weights else F.lit(None).cast("int"),
        }
    )
    bucket = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id")), F.lit(SLOT_BUCKETS))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], bucket, "slot")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal weight, and where each goes when a ninth is added."""
    out = shard_records(documents(spark, sf_dir), "doc_id", [1.0] * 8, [1.0] * 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
