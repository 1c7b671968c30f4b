"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards, without a ring table.

When a shard is appended, a key either stays or moves to the new shard, and 1 / (n + 1) of them move.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.scratch import Scratch

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach 2014) of unsigned 64-bit keys; all keys advance at once until each has passed the end."""
    key = keys.astype(np.uint64)
    bucket, to = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while (live := to < shards).any():
            bucket = np.where(live, to, bucket)
            key = np.where(live, key * _STEP + np.uint64(1), key)
            jump = (bucket + 1).astype(float) * (float(1 << 31) / ((key >> np.uint64(33)).astype(float) + 1.0))
            to = np.where(live, np.minimum(jump, 2.0**62).astype(np.int64), to)
    return bucket


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """A row per row of ``docs``: (doc_id, size, text_crc32, shard, grown_shard, slot).

    size is the text's UTF-8 bytes plus 8; a null text counts as empty. grown_shard is the shard if there were one
    more. slot numbers a shard's rows from 0 without gaps, by bucket, id, crc and size; equal rows take either slot.
    Equal ids share a shard; a null id is one key. An empty table gives an empty result; other columns are ignored.
    No task holds a shard: rows are numbered in ``spark.sql.shuffle.partitions`` buckets of each and moved by
    the buckets' sizes before.
    """
    spark = docs.sparkSession

    @F.pandas_udf("struct<shard int, grown_shard int>")
    def jump(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(keys, shards).astype(np.int32), "grown_shard": jump_hash(keys, shards + 1).astype(np.int32)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("key"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = flat.select("*", jump("key").alias("to")).select("doc_id", "size", "text_crc32", "to.shard", "to.grown_shard", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"))
    placed = Scratch(spark, "shards").put(placed, "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(own).cast("long"))
    return ranked.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", shards: int = 24) -> None:
    """Write the rows of ``docs`` as Parquet, one folder per shard; several tasks write into each. A column named shard is replaced by the shard."""

    @F.pandas_udf("int")
    def jump(key: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(key.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    docs.withColumn("shard", jump(key)).write.mode("overwrite").partitionBy("shard").parquet(path)
