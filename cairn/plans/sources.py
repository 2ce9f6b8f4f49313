"""Queries that write a report, payload or fact in its outer format and read it back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import samples as M
from cairn.operators.common import latest, shared_dir
from cairn.plans.catalog import query
from cairn.plans.relational import ACTIVE, SAMPLES, rounded
from cairn.sources import publisher, reports, sinks

SHA = "0123456789abcdef0123456789abcdef01234567"


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _as_text(lines: DataFrame, name: str) -> str:
    """The folder to which the single column was written, a row a line."""
    folder = _folder(lines, name)
    lines.write.text(folder)
    return folder


COVERAGE_SQL = "WITH l AS (SELECT file_path, row_id % 50 + 1 AS line, max(row_id % 4) AS hits, max(CASE WHEN row_id % 5 = 0 THEN row_id % 3 END) AS c, max(CASE WHEN row_id % 5 = 0 THEN 3 END) AS v FROM churn_event GROUP BY ALL)"


def _coverage(churn: DataFrame) -> DataFrame:
    branch = F.col("row_id") % 5 == 0
    share = F.concat(F.lit("x% ("), F.col("row_id") % 3, F.lit("/3)"))
    line = F.struct((F.col("row_id") % 50 + 1).alias("_number"), (F.col("row_id") % 4).alias("_hits"), F.when(branch, "true").otherwise("false").alias("_branch"), F.when(branch, share).otherwise("").alias("_condition-coverage"))
    classes = churn.groupBy(F.col("file_path").alias("_filename"), F.col("author").alias("_name")).agg(F.struct(F.collect_list(line).alias("line")).alias("lines"))
    folder = _folder(churn, "coverage")
    classes.write.format("xml").option("rootTag", "classes").option("rowTag", "class").save(folder)
    return reports.coverage(churn.sparkSession, folder)


@query("src_03_coverage_report", "churn_event", f"{COVERAGE_SQL} SELECT file_path, count(*) FILTER (WHERE hits > 0) AS lines_covered, count(*) AS lines_valid, CAST(coalesce(sum(c), 0) AS BIGINT) AS branches_covered, CAST(coalesce(sum(v), 0) AS BIGINT) AS branches_valid FROM l GROUP BY 1")
def coverage_report(churn):
    return _coverage(churn)


@query("met_11_coverage_ratios", "churn_event", f"{COVERAGE_SQL} SELECT 'sc:' || file_path AS scope_id, file_path, round(count(*) FILTER (WHERE hits > 0) / count(*), 6) AS coverage_line_ratio, round(sum(c) / sum(v), 6) AS coverage_branch_ratio FROM l WHERE length(file_path) % 2 = 0 GROUP BY file_path")
def coverage_ratios(churn):
    scopes = churn.select("file_path").distinct().where("length(file_path) % 2 = 0").withColumn("scope_id", F.concat(F.lit("sc:"), "file_path"))
    return rounded(M.coverage_ratios(_coverage(churn), scopes), "coverage_line_ratio", "coverage_branch_ratio")


def _payload(rows: DataFrame, repo: str, row, name: str) -> str:
    made = rows.groupBy(F.col(repo).alias("repo_id")).agg(F.collect_list(row).alias("rows"))
    return _as_text(made.select(F.to_json(F.struct("repo_id", "rows"))), name)


@query("src_04_churn_payload", "churn_event", "SELECT scope_id AS repo_id, CASE WHEN row_id % 7 = 0 THEN 'invalid_sha' WHEN row_id % 11 = 0 THEN 'empty_file_path' END AS fault, count(*) AS n FROM churn_event GROUP BY ALL")
def churn_payload(churn):
    row = F.struct(F.when(F.col("row_id") % 7 == 0, F.lit("xyz")).otherwise(F.col("sha")).alias("sha"), F.when(F.col("row_id") % 11 == 0, F.lit(" ")).otherwise(F.col("file_path")).alias("file_path"), F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), "author")
    return reports.churn(churn.sparkSession, _payload(churn, "scope_id", row, "churn")).groupBy("repo_id", "fault").agg(F.count("*").alias("n"))


@query("src_05_defect_payload", "churn_event", "SELECT author AS repo_id, CASE WHEN row_id % 13 = 0 THEN 'empty_defect_id' END AS fault, count(*) AS n FROM churn_event GROUP BY ALL")
def defect_payload(churn):
    row = F.struct("sha", "file_path", F.when(F.col("row_id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), "row_id")).alias("defect_id"), F.lit("high").alias("severity"))
    return reports.defects(churn.sparkSession, _payload(churn, "author", row, "defects")).groupBy("repo_id", "fault").agg(F.count("*").alias("n"))


@query("src_06_test_balance", "churn_event", "SELECT 's' || CAST(row_id AS STRING) AS scope_id, round(least(1, greatest(0, (row_id % 5) / (row_id % 4))), 6) AS pass_first_try_ratio FROM churn_event WHERE row_id % 4 > 0")
def test_balance(churn):
    row = F.struct(F.concat(F.lit("s"), "row_id").alias("scope_id"), (F.col("row_id") % 4).alias("attempt_count"), (F.col("row_id") % 5).alias("pass_count"))
    rows = reports.test_balance(churn.sparkSession, _payload(churn, "author", row, "tests")).where("fault IS NULL")
    return rounded(M.pass_ratio(rows).select("scope_id", "pass_first_try_ratio"), "pass_first_try_ratio")


@query("src_07_trace_export", "events", "SELECT lower(printf('%016x', event_id)) AS span_id, lower(printf('%032x', user_id)) AS trace_id, CASE WHEN event_id % 2 = 0 THEN lower(printf('%016x', event_id + 1)) END AS parent_span_id, date_trunc('second', ts) AS started_at, 2.5::DOUBLE AS duration_ms, event_type AS kind, CAST(user_id AS STRING) AS service FROM events")
def trace_export(events):
    text = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    span = F.struct(F.upper(F.lpad(F.lower(F.hex("user_id")), 32, "0")).alias("traceId"), F.upper(F.lpad(F.hex("event_id"), 16, "0")).alias("spanId"), F.when(F.col("event_id") % 2 == 0, F.lpad(F.hex(F.col("event_id") + 1), 16, "0")).otherwise("").alias("parentSpanId"), F.concat(start, F.lit("000000000")).alias("startTimeUnixNano"), F.concat(start, F.lit("002500000")).alias("endTimeUnixNano"), F.array(text("kind", F.col("event_type"))).alias("attributes"))
    by_user = events.groupBy("user_id").agg(F.collect_list(span).alias("spans"))
    export = by_user.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.array(text("service", F.col("user_id").cast("string"))).alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))))
    back = reports.spans(events.sparkSession.read.schema(reports.EXPORT).json(_as_text(export, "traces")))
    return back.select("span_id", "trace_id", "parent_span_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "duration_ms", F.col("attributes")["kind"].alias("kind"), F.col("attributes")["service"].alias("service"))


DIFF_SQL = """WITH b AS (SELECT 'd' || doc_id AS path, md5(coalesce(text, '') || doc_id) AS digest FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT CASE WHEN doc_id % 10 = 5 THEN 'moved/' ELSE '' END || 'd' || doc_id AS path, md5(coalesce(text, '') || doc_id || CASE WHEN doc_id % 10 = 4 THEN 'x' ELSE '' END) AS digest FROM documents WHERE doc_id % 10 <> 6)"""


@query(
    "src_08_tree_diff",
    "documents",
    f"{DIFF_SQL} SELECT 'd' || doc_id AS path, CASE doc_id % 10 WHEN 3 THEN 'added' WHEN 4 THEN 'modified' ELSE 'deleted' END AS change, NULL::VARCHAR AS old_path FROM documents WHERE doc_id % 10 IN (3, 4, 6) UNION ALL SELECT a.path, 'renamed', b.path FROM a JOIN b ON a.digest = b.digest AND a.path <> b.path",
)
def tree_diff(documents):
    body = F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string"))
    before = documents.where("doc_id % 10 <> 3").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.md5(body.cast("binary")).alias("digest"))
    after = documents.where("doc_id % 10 <> 6").select(F.concat(F.when(F.expr("doc_id % 10 = 5"), "moved/").otherwise(""), F.lit("d"), "doc_id").alias("path"), F.md5(F.concat(body, F.when(F.expr("doc_id % 10 = 4"), "x").otherwise("")).cast("binary")).alias("digest"))
    return reports.tree_diff(before, after)


@query("src_10_churn_read", "churn_event", "SELECT row_id, sha FROM churn_event WHERE author = 'click' AND modified_at >= TIMESTAMP '2024-01-10 00:00:00'")
def churn_read(churn):
    rows = churn.select("row_id", "sha", F.col("author").alias("repo_id"), "modified_at", F.col("modified_at").alias("created_at"))
    return M.churn_read(rows, "click", F.expr("CAST(TIMESTAMP '2024-01-10 00:00:00' AS TIMESTAMP_NTZ)")).select("row_id", "sha")


@query("snk_01_append_partitioned", "finding", "SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, count(*) AS n FROM finding WHERE created_at >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1")
def append_partitioned(findings):
    path = _folder(findings, "findings")
    for half in (0, 1):
        sinks.append(findings.where(F.col("seq") % 2 == half), path)
    return findings.sparkSession.read.parquet(path).where("month >= DATE '1997-01-01'").groupBy("month").agg(F.count("*").alias("n"))


@query("snk_03_append_twice", "finding", "SELECT rule_id, count(DISTINCT finding_id) AS n FROM finding WHERE severity = 'block' GROUP BY 1")
def append_twice(findings):
    path = _folder(findings, "blocks")
    for _ in range(2):
        sinks.append_new(findings.where("severity = 'block'"), path, ["finding_id"])
    return findings.sparkSession.read.parquet(path).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "snk_05_publish",
    "embeddings",
    """SELECT vec_id AS item_id, CASE WHEN label % 2 = 0 AND vec_id % 7 > 0 THEN 2 ELSE 1 END AS version, CASE WHEN label % 2 = 0 AND vec_id % 7 > 0 THEN 'superseded' END AS first_version, CASE WHEN label % 2 = 0 AND vec_id % 7 = 0 THEN 'failed' WHEN label % 2 = 0 THEN 'published' END AS second_version
    FROM embeddings""",
)
def publish(embeddings):
    """Two batches of which the second crashes between its tables and is run again; every seventh vector of it is cut short and fails."""
    spark, store = embeddings.sparkSession, _folder(embeddings, "publisher")
    size = 64
    first = embeddings.select(F.col("vec_id").alias("item_id"), F.lit(1).cast("long").alias("version"), "embedding")
    second = embeddings.where("label % 2 = 0").select(F.col("vec_id").alias("item_id"), F.lit(2).cast("long").alias("version"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    publisher.publish(first, store, 1, size)
    publisher.write_vectors(publisher.queue(second, store, 2), store, 2, size)
    for row in publisher.unfinished(spark, store).collect():  # a number a batch
        publisher.publish(second, store, row.batch, size)
    ended = publisher.state(spark, store).groupBy("item_id").pivot("version", [1, 2]).agg(F.first("kind"))
    rows = publisher.live(spark, store).select("item_id", F.col("version").cast("int").alias("version")).join(ended, "item_id")
    return rows.select("item_id", "version", F.when(F.col("1") != "published", F.col("1")).alias("first_version"), F.col("2").alias("second_version"))


@query("ins_02_latest_portfolio", SAMPLES, f"WITH {ACTIVE}, r AS (SELECT sha, metric_kind, scope_kind, count(*) AS total_observations FROM act GROUP BY ALL) SELECT metric_kind, scope_kind, sha, total_observations FROM r QUALIFY row_number() OVER (PARTITION BY metric_kind, scope_kind ORDER BY sha DESC) = 1")
def latest_portfolio(samples, retractions, scopes):
    built = M.active(samples, retractions, scopes).groupBy("sha", "metric_kind", "scope_kind").agg(F.count("*").alias("total_observations"))
    return latest(built, ["metric_kind", "scope_kind"], ["sha"]).select("metric_kind", "scope_kind", "sha", "total_observations")


@query("sys_08_inputs", SAMPLES, f"WITH {ACTIVE} SELECT repo_id, sha, count(*) AS samples, count(DISTINCT scope_id) AS scopes FROM act WHERE NOT degraded AND pack IN ('base', 'solid', 'ingested') GROUP BY ALL")
def system_inputs(samples, retractions, scopes):
    rows = M.active(samples, retractions, scopes).where(~F.col("degraded") & F.col("pack").isin("base", "solid", "ingested"))
    return rows.groupBy("repo_id", "sha", "scope_id").agg(F.count("*").alias("n")).groupBy("repo_id", "sha").agg(F.sum("n").alias("samples"), F.count("*").alias("scopes"))


@query("sys_09_validation", "metric_sample", "SELECT sample_id, CASE WHEN metric_kind NOT IN ('cyclo', 'fan_out') THEN 'unknown_kind' WHEN degraded AND value IS NOT NULL THEN 'degraded_with_value' WHEN NOT degraded AND value IS NULL THEN 'no_value' END AS fault FROM metric_sample WHERE metric_kind NOT IN ('cyclo', 'fan_out') OR (value IS NULL) <> degraded")
def validation(samples):
    return M.faults(samples, ["cyclo", "fan_out"]).where("fault IS NOT NULL").select("sample_id", "fault")
