"""Append-only facts in month partitions: appends, idempotent appends by pruned months, retention."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.common import cut, exists, insert_new, scratch

def append(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append rows under the month of their time."""
    df.withColumn("month", S.month(ts)).write.mode("append").partitionBy("month").parquet(path)


def _mark(key: Sequence[str]) -> Column:
    return F.xxhash64(*key, F.lit("id")).alias("_mark")


def months_that_may_hold(df: DataFrame, path: str, key: Sequence[str]) -> list[datetime.date] | None:
    """The months of a store in which some key of df may be; None where the store has no marks.

    Beside the facts lies a mark of 64 bits for each key with its month, so a key meets the months that have its
    mark and not every month's filter. The list grows with the number of months only.
    """
    spark = df.sparkSession
    if not exists(spark, f"{path}-keys"):
        return None
    held = spark.read.parquet(f"{path}-keys").where("month IS NOT NULL")
    return sorted(r.month for r in held.join(df.select(_mark(key)), "_mark", "left_semi").select("month").distinct().collect())


def stored(df: DataFrame, path: str, key: Sequence[str], ts: str = "created_at") -> DataFrame:
    """What a store has of the months in which keys of df may be; the scan skips the others."""
    schema = df.withColumn("month", S.month(ts)).schema
    if not exists(df.sparkSession, path):
        return df.withColumn("month", S.month(ts)).limit(0)
    facts, months = df.sparkSession.read.schema(schema).parquet(path), months_that_may_hold(df, path, key)
    return facts if months is None else facts.where(F.col("month").isin(*months) if months else F.lit(False))


def append_new(df: DataFrame, path: str, key: Sequence[str], ts: str = "created_at") -> None:
    """Append the rows whose key is not stored: a repeated batch adds nothing.

    Marks are written before the rows they stand for, so a crash between leaves marks too many and never too few.
    """
    spark = df.sparkSession
    with scratch(spark):
        fresh = cut(insert_new(stored(df, path, key, ts), df, key), "fresh")
        fresh.select(S.month(ts).alias("month"), _mark(key)).write.mode("append").parquet(f"{path}-keys")
        append(fresh, path, ts)


def retained(facts: DataFrame, now: Column, days: int = 30, partition: str = "week") -> DataFrame:
    """Rows of partitions that are not wholly older than the retention: a filter on the partition column, so the scan skips the rest."""
    return facts.where(F.col(partition) >= F.date_trunc("week", now - F.make_interval(days=F.lit(days))).cast("date"))


def partition_lag(facts: DataFrame, now: Column, partition: str = "week") -> DataFrame:
    """Whole days since the start of the newest partition."""
    return facts.agg(F.datediff(now.cast("date"), F.max(partition)).alias("lag_days"))
