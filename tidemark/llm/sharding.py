"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, table

SHARDS = 40
BUCKETS = 256
HASH_BITS = 53


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for the key is largest: -weight / ln(u), u in (0, 1) from a hash of key and shard.

    A shard that is added wins only keys that score highest on it, in proportion to its weight, and no other key moves. Equal scores go to
    the smaller shard. Equal weights compare u itself, which gives the same shard without logarithms.
    """
    equal = len(set(weights)) == 1

    def score(j: Column, w: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(key, j), 64 - HASH_BITS)
        return u if equal else -w / F.log((u.cast("double") + 0.5) / float(1 << HASH_BITS))

    each = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: F.struct(score(j, F.lit(1.0) if equal else F.element_at(F.array(*[F.lit(float(w)) for w in weights]), j + 1)).alias("score"), (-j).alias("j")))
    return -F.array_max(each)["j"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0) -> DataFrame:
    """docs with shard, slot and grown_shard by the law `key`: doc_id and the shards decide. Columns of these names are replaced.

    A null doc_id is a key like any other. Repeated rows share a shard and take a slot each. Slots run from 0 without gaps in every shard,
    in the order of a hash of the whole row, so that no task gets a whole shard, nor all rows of one id or without one. An empty table gives an
    empty one; texts are only hashed, however long.
    """
    docs = docs.drop("shard", "slot", "grown_shard")
    key, place = fresh(docs, "__key", "__place")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = docs.withColumn(key, F.xxhash64(name)).withColumn(place, F.xxhash64(*plain))
    out = out.withColumn("shard", shard_of(name, weights)).withColumn("grown_shard", shard_of(name, [*weights, grown]))
    out = numbered(out, ["shard"], [F.col(key), F.col("doc_id"), F.col(place)], F.pmod(F.col(place), F.lit(BUCKETS)), "slot")
    return out.drop(key, place)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 40, its place there and its shard of 41; sizes and checksums instead of texts."""
    text = F.col("text")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard(narrow).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
