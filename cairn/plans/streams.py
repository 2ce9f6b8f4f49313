"""Queries that run as streams over what is stored, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.catalog import query, stream_query
from cairn.plans.statistics import ROLLING_SQL
from cairn.streaming import spans as T
from cairn.streaming import stateful as K

WITHIN = "2 days"
END = "2024-01-26 00:00:00"


def _spans(events):
    """The span fixture without its window function, which a stream cannot have: the parent is the event 150 before."""
    return events.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - F.col("event_id") % 7).alias("parent_span_id"), F.col("ts").cast("timestamp").alias("started_at"), F.concat(F.lit("k"), F.col("user_id") % 10, F.lit(":"), "event_type").alias("method"), F.col("value").alias("duration_ms"))


CALLS_SQL = f"""WITH s AS (SELECT user_id AS trace_id, event_id AS span_id, event_id - event_id % 7 AS parent_span_id, ts AS started_at, 'k' || CAST(user_id % 10 AS STRING) || ':' || event_type AS method FROM events)
SELECT c.span_id, c.method, CASE WHEN p.method <> c.method THEN p.method END AS caller, p.method IS NULL OR p.method = c.method AS solo FROM s c LEFT JOIN s p ON p.span_id = c.parent_span_id AND p.started_at BETWEEN c.started_at - INTERVAL 2 DAY AND c.started_at + INTERVAL 2 DAY AND p.trace_id = c.trace_id WHERE c.started_at < TIMESTAMP '{END}'"""


@stream_query("str_02_late_parents", "events", CALLS_SQL)
def late_parents(stream):
    calls = T.observed_calls(_spans(stream), WITHIN)
    out = T.drain(calls, "calls")
    return out.where(F.col("started_at") < F.lit(END).cast("timestamp")).select("span_id", "method", "caller", "solo")


@query("str_02_late_parents_batch", "events", CALLS_SQL)
def late_parents_batch(events):
    return T.observed_calls(_spans(events), WITHIN).where(F.col("started_at") < F.lit(END).cast("timestamp")).select("span_id", "method", "caller", "solo")


@stream_query("str_03_rolling_stream", "events", f"{ROLLING_SQL.replace('FROM span', 'FROM (SELECT event_id AS span_id, ts AS started_at, value AS duration_ms, chr(107) || CAST(user_id % 10 AS STRING) || chr(58) || event_type AS method FROM events)')}")
def rolling_stream(stream):
    return T.drain(K.rolling(_spans(stream), "method"), "rolling").select("method", "span_id", F.col("n").alias("window_n"), "p50", "p95")


TTL = 2 * 86400


def _traces(events):
    """Traces of seven spans; the first is the parent of the others, which come in any order of time."""
    first = F.expr("event_id - event_id % 7")
    shaken = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=(F.col("event_id") * 37) % 90)
    return events.select(F.expr("event_id div 7").alias("trace_id"), F.col("event_id").alias("span_id"), F.when(F.col("event_id") != first, first).alias("parent_span_id"), shaken.alias("started_at"), F.concat(F.lit("k"), F.col("user_id") % 10, F.lit(":"), "event_type").alias("method"), F.col("value").alias("duration_ms"))


PENDING_SQL = f"""WITH s AS (SELECT event_id // 7 AS trace, event_id AS span_id, CASE WHEN event_id % 7 > 0 THEN event_id - event_id % 7 END AS parent, epoch_us(ts) + (event_id * 37) % 90 * 3600000000 AS us, 'k' || CAST(user_id % 10 AS STRING) || ':' || event_type AS method FROM events),
c AS (SELECT c.*, p.us AS p_us, p.method AS p_method FROM s c LEFT JOIN s p ON p.span_id = c.parent AND p.trace = c.trace),
n AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY parent, us < p_us ORDER BY us, span_id), p_us) - us > {TTL}000000 AS apart FROM c),
g AS (SELECT *, bool_or(apart) OVER (PARTITION BY parent, us < p_us ORDER BY us DESC, span_id DESC) AS gap FROM n)
SELECT span_id, method, CASE WHEN fits AND p_method <> method THEN p_method END AS caller, NOT fits OR p_method = method AS solo
FROM (SELECT *, parent IS NOT NULL AND p_us IS NOT NULL AND CASE WHEN us < p_us THEN NOT gap ELSE us - p_us <= {TTL}000000 END AS fits FROM g WHERE us < epoch_us(TIMESTAMP '{END}'))"""


@stream_query("str_02_pending_children", "events", PENDING_SQL)
def pending_children(stream):
    """Late parents by state and timers: a sibling renews the time that its elders wait. Up to a time that all timers have passed."""
    out = T.drain(K.late_parents(_traces(stream), TTL), "pending")
    return out.where(F.col("started_at") < F.lit(END).cast("timestamp")).select("span_id", "method", "caller", "solo")


@query("str_02_pending_children_batch", "events", PENDING_SQL)
def pending_children_batch(events):
    return K.late_parents_batch(_traces(events), TTL).where(F.col("started_at") < F.lit(END).cast("timestamp")).select("span_id", "method", "caller", "solo")


FOLD_SQL = "SELECT 'k' || CAST(user_id % 10 AS STRING) || ':' || event_type AS method, count(*) AS observation_count, arg_max(event_id, (ts, event_id)) AS latest_span, max(ts) AS last_at FROM events GROUP BY 1"


@stream_query("str_04_05_fold_stream", "events", FOLD_SQL)
def fold_stream(stream):
    log = T.drain(T.fold(_spans(stream), "method"), "fold", "update")
    return T.upserts(log, "method").select("method", "observation_count", "latest_span", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@stream_query("str_08_change_store", "events", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL")
def change_store(stream):
    """Idempotent storage: the same stream delivered twice adds nothing."""
    import uuid

    from cairn.operators.common import shared_dir

    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    for name in ("first", "again"):  # each with a checkpoint of its own: the second stream delivers everything once more
        T.store_changes(stream.select("event_id", "user_id", "event_type", "ts"), path, ["event_id"], "ts", name)
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("str_10_stale_runs", "commit", "SELECT sha, CASE WHEN rn % 4 = 0 AND committed_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 MINUTE THEN 'failed' WHEN rn % 4 = 0 THEN 'running' ELSE 'succeeded' END AS status FROM commit")
def stale(commits):
    runs = commits.select("sha", F.col("committed_at").alias("started_at"), F.when(F.col("rn") % 4 == 0, "running").otherwise("succeeded").alias("status"))
    return T.stale_runs(runs, F.expr("CAST(TIMESTAMP '2024-01-20 00:00:00' AS TIMESTAMP_NTZ)")).select("sha", "status")


@query("str_11_retention", "events", "SELECT week, count(*) AS n FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week FROM events) WHERE week >= CAST(date_trunc('week', TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY) AS DATE) GROUP BY 1")
def retention(events):
    from cairn.sources import sinks

    facts = events.select(F.date_trunc("week", "ts").cast("date").alias("week"))
    return sinks.retained(facts, F.lit("2024-01-31 00:00:00").cast("timestamp"), 14).groupBy("week").agg(F.count("*").alias("n"))


@query("str_11_partition_lag", "events", "SELECT CAST(DATE '2024-02-10' - CAST(date_trunc('week', max(ts)) AS DATE) AS INTEGER) AS lag_days FROM events")
def partition_lag(events):
    from cairn.sources import sinks

    return sinks.partition_lag(events.select(F.date_trunc("week", "ts").cast("date").alias("week")), F.lit("2024-02-10"))


@query(
    "str_01_resolution",
    "events method_decl node",
    None,
)
def resolution(events, methods, nodes):
    """Spans resolved by name and signature, then by line, then to blocks (cases checked one by one in the tests)."""
    lines = nodes.select(F.col("node_id").alias("node"), "repo_id", "start_line", "end_line")
    declared = methods.join(lines, "node").select("repo_id", F.col("node").alias("node_id"), F.substring_index("name", ".", 1).alias("namespace"), F.substring_index("name", ".", -1).alias("function"), F.lit("").alias("params"), F.concat("file", F.lit(".py")).alias("file"), "start_line", "end_line")
    blocks = declared.select("node_id", F.concat("node_id", F.lit("#0")).alias("block_id"), "start_line", F.expr("(start_line + end_line) div 2").alias("end_line"))
    spans = events.select(F.col("event_id").alias("span_id"), F.expr("'Brand#' || (1 + user_id % 5) || (1 + event_id % 5)").alias("repo_id"), F.expr("'C' || user_id % 5").alias("namespace"), F.expr("'m' || event_id % 20").alias("function"), F.lit("").alias("signature"), F.expr("'f' || user_id % 50 || '.py'").alias("filepath"), F.expr("CAST(event_id % 55 AS STRING)").alias("lineno"))
    return T.resolve(spans, declared, blocks)


