"""Sharding by rendezvous hashing: every shard bids for every record, the best bid wins.

A record's bid from shard i of weight w is -ln(u) / w, where u in (0, 1) comes from the MD5
of its key and i; the smallest bid wins. A record's shard depends on its key and the shards
alone, each shard gets its weight's share, and one more shard only takes records to itself.
Built-in functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import stage

#: Rows that are numbered together; a shard has as many blocks of them as it needs.
BLOCK = 2000


def bid(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    return -F.ln((F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def winner(key: Column, weights: list[float]) -> Column:
    """Struct (bid, shard) of the shard that key goes to; equal bids go to the lower shard."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(bid(key, s["shard"], s["weight"]).alias("bid"), s["shard"].alias("shard"))))


def assign(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard (the shard if there were one more of
    the last weight) for each row.

    size is the text's UTF-8 bytes (null: none) plus 16; a null key counts as the empty
    string; rows with equal keys share a shard. Slots count from 0 in each shard without gaps:
    a shard's rows are numbered block by block (a hash of key and text), so neither a shard nor
    a key is a single task however many rows it has. Other columns are not read."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    won = stage(
        docs.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            k.alias("k"),
        )
        .withColumn("won", winner(F.col("k"), weights))
        .withColumn("new", bid(F.col("k"), F.lit(len(weights)), F.lit(float(weights[-1]))))
        .select(
            "key", "size", "text_crc32", F.col("won.shard").alias("shard"),
            F.when(F.col("new") < F.col("won.bid"), len(weights)).otherwise(F.col("won.shard")).alias("grown_shard"),
            F.conv(F.substring(F.md5(F.concat("k", F.lit(":"), F.col("text_crc32"))), 1, 8), 16, 10).cast("long").alias("mark"),
        ),
        "shards",
    )
    blocks = max(1, -(-won.count() // (BLOCK * len(weights))))
    rows = won.withColumn("block", F.col("mark") % blocks)
    counts = rows.groupBy("shard", "block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "block", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "size", "text_crc32")) - 1
    return rows.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), "grown_shard"
    )
