"""Metric samples: active rows, roll-ups, freshness, coverage and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.common import cut, latest, value_counts, without
from cairn.operators.ordered import order_statistics, percentiles

FIVE = ("repo_id", "sha", "scope_id", "metric_kind", "metric_version")
REPO = ("repo_id", "metric_kind", "scope_kind")
SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def current(samples: DataFrame) -> DataFrame:
    """The newest sample of each (repository, commit, scope, metric, version)."""
    return latest(samples, FIVE, ["seq"])


def active(samples: DataFrame, retractions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Current samples with a value that are not retracted, with their scope's signature."""
    rows = without(current(samples), retractions, "sample_id").where(F.col("value").isNotNull())
    return rows.join(scopes.select("scope_id", "canonical_signature", "package"), "scope_id")


def repo_snapshot(rows: DataFrame) -> DataFrame:
    """Count, mean and percentiles by repository, metric and scope kind."""
    return percentiles(rows, REPO, "value", **SHARES)


def cross_repo(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Percentiles over the pooled values of all repositories, and the repositories' own (one row each, their history)."""
    counted = cut(value_counts(rows, REPO, "value"), "value-counts")
    return order_statistics(counted, ["metric_kind", "scope_kind"], **SHARES), order_statistics(counted, REPO, **SHARES)


def portfolio(rows: DataFrame) -> DataFrame:
    """Totals, weighted and plain means of the repositories' means, pooled percentiles, by metric and scope kind."""
    counted = cut(value_counts(rows, REPO, "value"), "value-counts")
    own = counted.groupBy(*REPO).agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"))  # no order: only the pooled values have percentiles
    pooled = order_statistics(counted, ["metric_kind", "scope_kind"], **SHARES)
    means = own.groupBy("metric_kind", "scope_kind").agg(
        F.sum("n").alias("total_observations"),
        F.count("*").alias("repo_count"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("weighted_mean"),
        F.avg("mean").alias("unweighted_mean"),
    )
    return means.join(pooled.drop("n", "mean"), ["metric_kind", "scope_kind"])


def fresh(rows: DataFrame, now: Column, built_at: str = "built_at", limit_seconds: int = 3600) -> DataFrame:
    """Rows with degraded and degraded_reason: stale when built more than the limit ago, or never."""
    age = now.cast("timestamp").cast("double") - F.col(built_at).cast("timestamp").cast("double")
    stale = F.col(built_at).isNull() | (age > limit_seconds)
    return rows.withColumn("degraded", stale).withColumn("degraded_reason", F.when(stale, "percentile_stale"))


def worst_reason(rows: DataFrame, keys: list[str], reason: str = "reason") -> DataFrame:
    """The reason of degraded service to show for each key: highest rank, then the alphabet."""
    ranked = rows.where(F.col(reason).isNotNull())
    return ranked.groupBy(*keys).agg(F.min_by(reason, F.struct(-S.reason_rank(reason), F.col(reason))).alias("degraded_reason"))


def modification_count(churn: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Distinct commits of each scope in the trailing window (both ends included), with the latest commit."""
    inside = F.col("modified_at").between(now - F.make_interval(days=F.lit(days)), now)
    return churn.where(inside).groupBy("scope_id").agg(F.countDistinct("sha").alias("modification_count"), F.max_by("sha", F.struct("modified_at", "sha")).alias("latest_sha"))


def bus_factor(churn: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the share of the author with most changes."""
    own = churn.groupBy(*keys, "author").agg(F.count("*").alias("n"))
    return own.groupBy(*keys).agg((1 - F.max("n") / F.sum("n")).alias("bus_factor"))


def knowledge_index(churn: DataFrame) -> DataFrame:
    """Mean bus factor of the files of each package."""
    return bus_factor(churn, ["package", "file_path"]).groupBy("package").agg(F.avg("bus_factor").alias("knowledge_index"), F.count("*").alias("files"))


def coverage_rollup(files: DataFrame) -> DataFrame:
    """Covered over valid lines by directory; directories without valid lines are left out."""
    by = files.groupBy(S.dirname("file_path").alias("package")).agg(F.sum("lines_covered").alias("covered"), F.sum("lines_valid").alias("valid"))
    return by.where("valid > 0").select("package", "covered", "valid", (F.col("covered") / F.col("valid")).alias("ratio"))


def coverage_ratios(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Line and branch ratios of bound files; files without a scope are left out (count them with an anti join)."""
    ratio = lambda part: F.when(F.col(f"{part}_valid") > 0, F.col(f"{part}_covered") / F.col(f"{part}_valid"))
    return files.join(scopes, "file_path").select("scope_id", "file_path", ratio("lines").alias("coverage_line_ratio"), ratio("branches").alias("coverage_branch_ratio"))


def pass_ratio(rows: DataFrame) -> DataFrame:
    """pass_first_try_ratio of rows with attempts."""
    return rows.where("attempt_count > 0").withColumn("pass_first_try_ratio", S.clamp(F.col("pass_count") / F.col("attempt_count")))


def churn_read(churn: DataFrame, repo: str, since: Column) -> DataFrame:
    return churn.where((F.col("repo_id") == repo) & (F.col("modified_at") >= since)).orderBy(F.desc("modified_at"), F.desc("created_at"), "row_id")


def upsert_pointer(pointers: DataFrame, rows: DataFrame) -> DataFrame:
    """The pointer table after an upsert: newest row of each five-part key."""
    return latest(pointers.unionByName(rows), FIVE, ["seq"])


def faults(samples: DataFrame, kinds: list[str]) -> DataFrame:
    """samples with fault: an unknown kind, or a value that does not go with degraded; null for sound rows."""
    fault = F.when(~F.col("metric_kind").isin(*kinds), "unknown_kind").when(F.col("degraded") & F.col("value").isNotNull(), "degraded_with_value").when(~F.col("degraded") & F.col("value").isNull(), "no_value")
    return samples.withColumn("fault", fault)
