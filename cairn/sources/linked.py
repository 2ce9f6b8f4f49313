"""Edges between repositories that another service has exported as pages of JSON: read in parallel, a page a split; degraded where there are none.

A page: {"repo_id", "sha", "cursor", "edges": [{"from", "to", "kind"}, ...]}, one line a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.common import exists

PAGE = "repo_id string, sha string, cursor long, edges array<struct<from: string, to: string, kind: string>>"
ABSENT = "xrepo_edges_unavailable"


def export(edges: DataFrame, path: str, per_page: int = 1000) -> None:
    """Write edges (repo_id, sha, src, dst, kind) as pages of about per_page edges; no page has more than twice as many.

    Pages are dealt by a hash of the edge, as many for a repository and commit as its number of edges asks for.
    """
    key = ["repo_id", "sha"]
    pages = edges.groupBy(*key).agg(F.ceil(F.count("*") / per_page).alias("_pages"))
    dealt = edges.join(pages, key).withColumn("cursor", F.pmod(F.xxhash64("src", "dst", "kind"), F.col("_pages")))
    made = dealt.groupBy(*key, "cursor").agg(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind")).alias("edges"))
    made.write.mode("append").json(path)


def read(spark: SparkSession, path: str, kinds: Sequence[str] = ()) -> DataFrame:
    """repo_id, sha, src, dst, kind of whole edges (of the kinds, if any are named), each once though pages repeat."""
    each = spark.read.schema(PAGE).json(path).select("repo_id", "sha", F.explode("edges").alias("e"))
    rows = each.select("repo_id", "sha", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.kind").alias("kind")).where("src IS NOT NULL AND dst IS NOT NULL AND kind IS NOT NULL")
    return (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).distinct()


def with_linked(own: DataFrame, path: str, kinds: Sequence[str] = ()) -> tuple[DataFrame, str | None]:
    """own edges (src, dst) with the exported ones, and why the answer is degraded (null if it is not)."""
    if not exists(own.sparkSession, path):
        return own.select("src", "dst"), ABSENT
    return own.select("src", "dst").unionByName(read(own.sparkSession, path, kinds).select("src", "dst")), None
