"""Vectors and the log of their publication: two tables that agree although no transaction spans them.

A batch has a number. It first logs its rows as queued, then writes its vectors, then logs how each ended:
published, or failed with a reason, and superseded for what an older version had published. Each step is a folder of
the batch's number that is overwritten, so running a batch again repairs whatever a crash left. Readers follow
the log: a vector without a published event, or with a later superseded one, is not there for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.common import exists, latest

EVENT = "publish_id string, item_id long, version long, kind string, reason string"
QUEUED, ENDED = 0, 1


def _log(rows: DataFrame, store: str, batch: int, step: int) -> None:
    rows.write.mode("overwrite").parquet(f"{store}/log/batch={batch}/step={step}")


def log_of(spark: SparkSession, store: str) -> DataFrame:
    """publish_id, item_id, version, kind, reason, batch, step."""
    schema = f"{EVENT}, batch int, step int"
    return spark.read.schema(schema).parquet(f"{store}/log") if exists(spark, f"{store}/log") else spark.createDataFrame([], schema)


def queue(rows: DataFrame, store: str, batch: int) -> DataFrame:
    """Step one: rows (item_id, version, embedding) with their publish_id, logged as queued."""
    named = rows.withColumn("publish_id", F.sha2(F.concat_ws(":", "item_id", "version", F.lit(batch)), 256))
    _log(named.select("publish_id", "item_id", "version", F.lit("queued").alias("kind"), F.lit(None).cast("string").alias("reason")), store, batch, QUEUED)
    return named


def write_vectors(named: DataFrame, store: str, batch: int, size: int) -> None:
    """Step two: the sound vectors of the batch."""
    named.where(fault(size).isNull()).select("publish_id", "item_id", "version", "embedding").write.mode("overwrite").parquet(f"{store}/vectors/batch={batch}")


def fault(size: int):
    """Why a vector cannot be stored; null for a sound one."""
    return F.when(F.col("embedding").isNull(), "no_vector").when(F.size("embedding") != size, "wrong_size").when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")


def finish(named: DataFrame, store: str, batch: int, size: int) -> None:
    """Step three: how each row ended, and what it takes the place of. Other batches' log is read, never the own: a repeated batch says the same."""
    ended = named.select("publish_id", "item_id", "version", F.when(fault(size).isNull(), "published").otherwise("failed").alias("kind"), fault(size).alias("reason"))
    newer = ended.where("kind = 'published'").groupBy("item_id").agg(F.max("version").alias("newest"))
    before = log_of(named.sparkSession, store).where((F.col("batch") < batch) & F.col("kind").isin("published", "superseded"))
    open_before = latest(before, ["publish_id"], ["batch", "step", (F.col("kind") == "superseded").cast("int")]).where("kind = 'published'")
    older = open_before.unionByName(ended.where("kind = 'published'").withColumn("batch", F.lit(batch)).withColumn("step", F.lit(ENDED))).join(newer, "item_id").where("version < newest")
    superseded = older.select("publish_id", "item_id", "version", F.lit("superseded").alias("kind"), F.lit("newer_version").alias("reason"))
    _log(ended.unionByName(superseded), store, batch, ENDED)


def publish(rows: DataFrame, store: str, batch: int, size: int = 64) -> None:
    """All steps of a batch of rows (item_id, version, embedding), one row an item and version; safe to repeat."""
    named = queue(rows, store, batch)
    write_vectors(named, store, batch, size)
    finish(named, store, batch, size)


def state(spark: SparkSession, store: str) -> DataFrame:
    """publish_id, item_id, version, kind (the newest event of each publication), reason, batch, step."""
    return latest(log_of(spark, store), ["publish_id"], ["batch", "step", (F.col("kind") == "superseded").cast("int")])


def live(spark: SparkSession, store: str) -> DataFrame:
    """item_id, version, embedding of what is published now."""
    vectors = spark.read.parquet(f"{store}/vectors").select("publish_id", "item_id", "version", "embedding")
    return vectors.join(state(spark, store).where("kind = 'published'").select("publish_id"), "publish_id", "left_semi").drop("publish_id")


def unfinished(spark: SparkSession, store: str) -> DataFrame:
    """Batches that are queued and have no end: to be run again."""
    log = log_of(spark, store)
    return log.where(F.col("step") == QUEUED).select("batch").distinct().join(log.where(F.col("step") == ENDED).select("batch").distinct(), "batch", "left_anti")
