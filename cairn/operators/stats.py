"""Statistics: robust z, slopes, rate caps, ranking metrics, hysteresis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.common import cut
from cairn.operators.ordered import join_keys, order_statistics

MAD_TO_SIGMA = 1.4826


def robust_z(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with <column>_z: distance from the median in MADs; without spread in MADs, in population sigmas; else 0.

    Null values are no part of a distribution and have z 0. Values of all columns are counted once; medians of
    the values and of their distances are ranks among those counts, so the rows are read twice: to be counted,
    and to get their z. The centres are one row a key; without keys, one row that is broadcast.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x")
    counted = df.select(*keys, each).select(*keys, "_x._c", "_x._v").where("_v IS NOT NULL").groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_n"))
    counted = cut(counted, "z-counts")
    by = [*keys, "_c"]
    middle = order_statistics(counted, by, med=0.5).select(*by, "mean", "med")
    apart = cut(join_keys(counted, middle, by), "z-apart")
    mad = order_statistics(apart.select(*by, F.abs(F.col("_v") - F.col("med")).alias("_v"), "_n"), by, mad=0.5).select(*by, "mad")
    sd = apart.groupBy(*by).agg(F.first("med").alias("med"), F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("_n") * (F.col("_v") - F.col("mean")) ** 2) / F.sum("_n")).alias("sd"))
    at = lambda name, i: F.max(F.when(F.col("_c") == i, F.col(name))).alias(f"_{name}_{i}")
    centres = join_keys(sd, mad, by).groupBy(*keys).agg(*[at(name, i) for i in range(len(columns)) for name in ("med", "mad", "mean", "sd")])
    out = join_keys(df, cut(centres, "z-centres"), keys, "left")
    z = lambda i, c: F.when(F.col(c).isNull(), 0.0).when(F.col(f"_mad_{i}") > 0, (F.col(c) - F.col(f"_med_{i}")) / (MAD_TO_SIGMA * F.col(f"_mad_{i}"))).when(F.col(f"_sd_{i}") > 0, (F.col(c) - F.col(f"_mean_{i}")) / F.col(f"_sd_{i}")).otherwise(0.0)
    return out.select(*df.columns, *[z(i, c).alias(f"{c}_z") for i, c in enumerate(columns)])


def slope(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares slope; no spread in x gives 0, fewer than two points are degraded (null)."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.count(y).alias("n"))
    return fit.select(*keys, "n", F.when(F.col("n") >= 2, F.coalesce("_s", F.lit(0.0))).alias("slope"), (F.col("n") < 2).alias("degraded"))


def trailing_cap(df: DataFrame, actor: str, ts: str, tie: str, now: Column, hours: int = 1, most: int = 50) -> DataFrame:
    """Rows outside the trailing window, and of those in it the first ``most`` of each actor; rows without an actor stay."""
    inside = F.col(ts).between(now - F.make_interval(hours=F.lit(hours)), now) & F.col(actor).isNotNull()
    number = F.row_number().over(Window.partitionBy(actor).orderBy(ts, tie))
    capped = df.where(inside).withColumn("_no", number).where(F.col("_no") <= most).drop("_no")
    return df.where(~F.coalesce(inside, F.lit(False))).unionByName(capped)


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, relevant: Column, tie: str, k: int = 20) -> DataFrame:
    """NDCG, reciprocal rank, recall and mean rank of the relevant rows among the first k, by key."""
    ranked = df.withColumn("_rel", relevant).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    total = F.sum(F.col("_rel").cast("int"))
    hit = F.col("_rel") & (F.col("_rank") <= k)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("positives"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = ranked.groupBy(*keys).agg(
        total.alias("positives"),
        F.sum(F.when(hit, 1 / F.log2(F.col("_rank") + 1)).otherwise(0.0)).alias("_dcg"),
        F.min(F.when(hit, F.col("_rank"))).alias("_first"),
        F.sum(hit.cast("int")).alias("_hits"),
        F.avg(F.when(hit, F.col("_rank"))).alias("_mean"),
    )
    return out.select(
        *keys,
        "positives",
        F.when(F.col("positives") > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("positives") > 0, F.col("_hits") / F.col("positives")).otherwise(0.0).alias("recall"),
        F.coalesce("_mean", F.lit(0.0)).alias("mean_rank"),
    )


def hysteresis(df: DataFrame, key: str, ts: str, depth: str, high: int = 100, hold_seconds: int = 30) -> DataFrame:
    """Rows with degraded: the state of the key after depth has stayed at or above ``high`` (or below it) for the hold time."""
    order = Window.partitionBy(key).orderBy(ts)
    over = F.col(depth) >= high
    rows = df.withColumn("_over", over).withColumn("_turn", F.coalesce((F.lag("_over").over(order) != F.col("_over")).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_turn").over(order))
    since = F.first(ts).over(Window.partitionBy(key, "_run").orderBy(ts))
    held = (F.col(ts).cast("timestamp").cast("double") - since.cast("timestamp").cast("double")) >= hold_seconds
    rows = rows.withColumn("_settled", F.when(held, F.col("_over")))
    return rows.withColumn("degraded", F.coalesce(F.last("_settled", ignorenulls=True).over(order), F.lit(False))).select(*df.columns, "degraded")
