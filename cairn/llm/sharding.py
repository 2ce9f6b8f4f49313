"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The key of a row is the leading 60 bits of the MD5 digest of its id as text. The jump walk turns a key
and a shard count into a shard without any ring table; going from n to n + 1 shards moves about one row
in n + 1, and only into the new shard.

Defined cases: a null id has the key of the text ``null``; a null text has size 16 and the CRC-32 of no
bytes (0); repeated rows each get a slot of their own; an empty table gives an empty result; further
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import digits_for, hex_bucket, text_or_empty

RUN = 1000
_STEP = np.uint64(2862933555777941757)  # the multiplier of the published walk


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            state[live] = state[live] * _STEP + np.uint64(1)
            ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def jump_udf(shards: int):
    @F.pandas_udf("int")
    def of(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return of


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Law ``key``: doc_id, size, text_crc32, law, shard, slot (from 0 in each shard, without gaps), grown_shard.

    Slots are prefix sums over hashed buckets of each shard, so no task holds a whole shard. Equal rows are
    counted before the shuffle and spread again afterwards.
    """
    text = text_or_empty(text_col)
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    rows = (
        df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("digest"))
        .groupBy("doc_id", "size", "text_crc32", "digest")
        .agg(F.count("*").alias("copies"))
    )
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    spread = F.md5(F.concat_ws("|", "digest", "size", "text_crc32").cast("binary"))
    rows = rows.withColumn("key", key).select("*", jump_udf(shards)("key").alias("shard"), jump_udf(shards + 1)("key").alias("grown_shard"), spread.alias("spread"))
    rows = rows.withColumn("bucket", hex_bucket(F.col("spread"), digits_for(df.count())))
    held = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("spread", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["shard", "bucket"]).withColumn("first", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    # Slots of equal rows in runs of RUN, so that no array holds a hot row's copies.
    last = F.col("first") + F.col("copies") - 1
    runs = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", last.alias("last"), F.explode(F.sequence("first", last, F.lit(RUN).cast("long"))).alias("from"))
    slot = F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + RUN - 1))).alias("slot")
    return runs.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
