"""Weighted rendezvous hashing of stable keys, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmol.llm.common import copied, counted, gapless

#: Hex digits of the MD5 of key:shard that make the uniform draw; 13 digits are 52 bits, exact in a double.
DIGITS = 13


def _cost(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight of the shard's draw: the smallest wins, with chances as the weights."""
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS), 16, 10).cast("double")
    u = (draw + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return -F.log(u) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard of a key: its draws depend on the key and the shard's own number and weight alone, so a
    further shard only takes keys to itself. Ties go to the lower shard."""
    costs = [F.struct(_cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights)]
    return F.array_min(F.array(*costs))["s"]


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The key is doc_id as text (null: empty), so copies of a row share a shard. size is the text's UTF-8
    bytes (null: none) plus 8; a null text has the checksum of no bytes. Slots are gapless from 0 in each shard in
    doc_id order within hash buckets; equal rows, which are counted first, have slots in a run. weights: one per shard, equal if None; the grown set's new shard has the mean weight.
    An empty table gives an empty table; other columns are left out.
    """
    weights = weights or [1.0] * n_shards
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    costs = lambda ws: [F.struct(_cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(ws)]
    grown = [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.array(*costs(grown)).alias("_costs"),
    ).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        F.array_min(F.slice("_costs", 1, len(weights)))["s"].cast("int").alias("shard"),
        F.array_min("_costs")["s"].cast("int").alias("grown_shard"),
    )
    begun = gapless(counted(placed), ["shard"], ["doc_id", "text_crc32", "size"], "_first", F.col("copies"), docs.count())
    out = copied(begun, "copies", "_copy").withColumn("slot", F.col("_first") + F.col("_copy"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
