"""Queries of statistics, windows and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import ordered as O
from cairn.operators import samples as M
from cairn.operators import stats as A
from cairn.operators.ordered import percentiles
from cairn.plans.catalog import query
from cairn.plans.relational import rounded

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/scopes")
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.expr(f"CAST({NOW_SQL} AS TIMESTAMP_NTZ)")



@query("agg_01_percentile_ends", "lineitem", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS p0, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999, max(l_extendedprice) AS p100 FROM lineitem GROUP BY 1")
def percentile_ends(lineitem):
    mean = lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))
    out = percentiles(lineitem, ["l_returnflag"], "l_extendedprice", p0=0.0, p25=0.25, p999=0.999, p100=1.0)
    return rounded(out.drop("mean").join(mean, "l_returnflag"), "p25", "p999")


@query("agg_02_summary", "events", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def summary(events):
    return rounded(percentiles(events, ["event_type"], "value", **M.SHARES), "mean", "p50", "p90", "p99")


@query("agg_08_distinct_by_polarity", "episode observation", "SELECT o.node_id, count(DISTINCT CASE WHEN e.kind = 'synthetic_positive' OR e.outcome = 'success' THEN e.episode_id END) AS positive, count(DISTINCT CASE WHEN NOT (e.kind = 'synthetic_positive' OR e.outcome = 'success') THEN e.episode_id END) AS negative FROM observation o JOIN episode e USING (episode_id) WHERE o.node_id IS NOT NULL GROUP BY 1")
def distinct_by_polarity(episodes, observations):
    sided = observations.where("node_id IS NOT NULL").join(episodes.select("episode_id", S.polarity("kind", "outcome").alias("side")), "episode_id")
    once = sided.select("node_id", "episode_id", "side").distinct()
    return once.groupBy("node_id").agg(F.count(F.when(F.col("side") == "positive", 1)).alias("positive"), F.count(F.when(F.col("side") == "negative", 1)).alias("negative"))


@query("agg_09_nearest_rank", "span", "SELECT method, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM span GROUP BY 1")
def nearest_rank(spans):
    return O.nearest_rank(spans, ["method"], "duration_ms", p50=0.5, p95=0.95)


@query("agg_11_slope", "events", "SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(coalesce(regr_slope(value, rn), 0), 6) END AS slope, count(*) < 2 AS degraded FROM (SELECT user_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS rn FROM events) GROUP BY 1")
def velocity(events):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rounded(A.slope(events.withColumn("rn", place.cast("double")), ["user_id"], "value", "rn"), "slope")


@query("agg_12_bus_factor", "churn_event", "SELECT file_path, round(1 - max(n) / sum(n), 6) AS bus_factor FROM (SELECT file_path, author, count(*) AS n FROM churn_event GROUP BY ALL) GROUP BY 1")
def bus_factor(churn):
    return rounded(M.bus_factor(churn, ["file_path"]), "bus_factor")


@query("sys_07_knowledge_index", "churn_event", "WITH f AS (SELECT package, file_path, 1 - max(n) / sum(n) AS b FROM (SELECT scope_id AS package, file_path, author, count(*) AS n FROM churn_event GROUP BY ALL) GROUP BY ALL) SELECT package, round(avg(b), 6) AS knowledge_index, count(*) AS files FROM f GROUP BY 1")
def knowledge(churn):
    return rounded(M.knowledge_index(churn.withColumnRenamed("scope_id", "package")), "knowledge_index")


@query("agg_13_coverage_rollup", "churn_event", "SELECT regexp_replace(file_path, '/[^/]*$', '') AS package, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(valid) AS BIGINT) AS valid, round(sum(covered) / sum(valid), 6) AS ratio FROM (SELECT file_path, count(*) FILTER (WHERE row_id % 3 = 0) AS covered, count(*) FILTER (WHERE row_id % 5 <> 0) AS valid FROM churn_event GROUP BY 1) GROUP BY 1 HAVING sum(valid) > 0")
def coverage_rollup(churn):
    files = churn.groupBy("file_path").agg(F.count(F.when(F.expr("row_id % 3 = 0"), 1)).alias("lines_covered"), F.count(F.when(F.expr("row_id % 5 <> 0"), 1)).alias("lines_valid"))
    return rounded(M.coverage_rollup(files), "ratio")


@query("agg_14_pass_ratio", "part", "SELECT p_partkey AS scope_id, round(least(1, greatest(0, (p_size - 3) / (p_size % 7))), 6) AS pass_first_try_ratio FROM part WHERE p_size % 7 > 0")
def pass_ratio(part):
    rows = part.select(F.col("p_partkey").alias("scope_id"), (F.col("p_size") % 7).alias("attempt_count"), (F.col("p_size") - 3).alias("pass_count"))
    return rounded(M.pass_ratio(rows).select("scope_id", "pass_first_try_ratio"), "pass_first_try_ratio")


@query("agg_16_lag", "episode", "SELECT greatest(0, epoch(max(created_at)) - epoch(TIMESTAMP '2024-01-15 12:00:00')) AS lag_seconds FROM episode")
def lag(episodes):
    from cairn.operators import memory

    return memory.lag_seconds(episodes, F.lit("2024-01-15 12:00:00"))


@query(
    "agg_17_ranking_metrics",
    "labels documents",
    """WITH s AS (SELECT d.lang, d.doc_id, l.quality = 1 AS rel, (d.n_chars * 7 + d.doc_id) % 1000 AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s),
    a AS (SELECT lang, count(*) FILTER (WHERE rel) AS positives, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 20), 0) AS dcg, min(rank) FILTER (WHERE rel AND rank <= 20) AS f, count(*) FILTER (WHERE rel AND rank <= 20) AS hits, avg(rank) FILTER (WHERE rel AND rank <= 20) AS m FROM r GROUP BY 1)
    SELECT lang, positives, round(CASE WHEN positives > 0 THEN dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= positives) ELSE 0 END, 6) AS ndcg, round(coalesce(1 / f, 0), 6) AS mrr, round(CASE WHEN positives > 0 THEN hits / positives ELSE 0 END, 6) AS recall, round(coalesce(m, 0), 6) AS mean_rank FROM a""",
)
def ranking_metrics(labels, documents):
    rows = documents.join(labels.where("quality IS NOT NULL"), "doc_id").withColumn("score", (F.col("n_chars") * 7 + F.col("doc_id")) % 1000)
    return rounded(A.ranking_metrics(rows, ["lang"], "score", F.col("quality") == 1, "doc_id"), "ndcg", "mrr", "recall", "mean_rank")


@query("agg_19_upsert_fold", "span", "SELECT method, count(*) AS observation_count, arg_max(span_id, (started_at, span_id)) AS latest_span, max(started_at) AS last_at FROM span GROUP BY 1")
def upsert_fold(spans):
    from cairn.streaming import spans as T

    parts = [T.fold(spans.where(f"span_id % 3 = {k}"), "method") for k in range(3)]
    return T.merge_fold(T.merge_fold(parts[0], parts[1], "method"), parts[2], "method")


@query("win_02_modification_count", "churn_event", f"SELECT scope_id, count(DISTINCT sha) AS modification_count, arg_max(sha, (modified_at, sha)) AS latest_sha FROM churn_event WHERE modified_at BETWEEN {NOW_SQL} - INTERVAL 20 DAY AND {NOW_SQL} GROUP BY 1")
def modification_count(churn):
    return M.modification_count(churn, now(), 20)


ROLLING_SQL = "SELECT method, span_id, CAST(len(w) AS BIGINT) AS window_n, w[greatest(1, CAST(ceil(0.5 * len(w)) AS BIGINT))] AS p50, w[greatest(1, CAST(ceil(0.95 * len(w)) AS BIGINT))] AS p95 FROM (SELECT method, span_id, list_sort(list(duration_ms) OVER (PARTITION BY method ORDER BY started_at, span_id ROWS 255 PRECEDING)) AS w FROM span)"


@query("win_03_rolling_quantiles", "span", ROLLING_SQL)
def rolling_quantiles(spans):
    return O.rolling_quantiles(spans.select("method", "span_id", "started_at", "duration_ms"), "method", ["started_at", "span_id"], "duration_ms", p50=0.5, p95=0.95).select("method", "span_id", "window_n", "p50", "p95")


@query(
    "win_04_actor_cap",
    "episode",
    f"""SELECT episode_id FROM (SELECT *, created_at BETWEEN {NOW_SQL} - INTERVAL 240 HOUR AND {NOW_SQL} AND actor IS NOT NULL AS inside FROM episode) QUALIFY NOT inside OR row_number() OVER (PARTITION BY actor, inside ORDER BY created_at, episode_id) <= 50""",
)
def actor_cap(episodes):
    return A.trailing_cap(episodes, "actor", "created_at", "episode_id", now(), 240, 50).select("episode_id")


@query(
    "str_06_hysteresis",
    "events",
    """WITH o AS (SELECT user_id, event_id, ts, value, value >= 50 AS over_ FROM events), t AS (SELECT *, coalesce(CAST(lag(over_) OVER w <> over_ AS INTEGER), 1) AS turn FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM t), h AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id, run ORDER BY ts)) >= 3600000000 THEN over_ END AS settled FROM r)
    SELECT user_id, event_id, ts, value, coalesce(last_value(settled IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), false) AS degraded FROM h""",
)
def hysteresis(events):
    """Degraded intervals of a queue whose depth is the value of each user's events."""
    return A.hysteresis(events.select("user_id", "event_id", "ts", "value"), "user_id", "ts", "value", 50, 3600)


@query("fn_01_node_fingerprint", "node", "SELECT node_id, sha256(unhex('00112233445566778899aabbccddeeff') || encode(kind) || '\\x00'::BLOB || encode(canonical_signature) || '\\x00'::BLOB || encode(from_sha)) AS fingerprint FROM node")
def node_fingerprint(nodes):
    return nodes.select("node_id", S.node_fingerprint(F.lit("00112233-4455-6677-8899-aabbccddeeff"), "kind", "canonical_signature", "from_sha").alias("fingerprint"))


@query(
    "fn_02_edge_fingerprint",
    "edge",
    "SELECT edge_id, sha256(unhex('00112233445566778899aabbccddeeff') || encode(kind) || '\\x00'::BLOB || unhex(sha256(src_node_id)) || unhex(sha256(dst_node_id)) || encode(from_sha)) AS fingerprint FROM edge",
)
def edge_fingerprint(edges):
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return edges.select("edge_id", S.edge_fingerprint(F.lit("00112233-4455-6677-8899-aabbccddeeff"), "kind", sha("src_node_id"), sha("dst_node_id"), "from_sha").alias("fingerprint"))


@query("fn_04_scope_id", "node", None)
def scope_ids(nodes):
    """Version 5 UUIDs (checked against Python's uuid in the tests)."""
    return nodes.select("node_id", S.scope_id(NAMESPACE, F.lit("00112233-4455-6677-8899-aabbccddeeff"), "kind", "canonical_signature", "from_sha").alias("scope_id"))


@query("fn_05_normalise_signature", "part", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name || ' ( ' || p_type || ' , /* x */ int  n ) // end', '/\*[\s\S]*?\*/|//[^\n]*', ' ', 'g'), '\s+', ' ', 'g'), ' ?([,()\[\]{}<>:;]) ?', '\1', 'g')) AS signature FROM part")
def normalise_signature(part):
    raw = F.concat("p_name", F.lit(" ( "), "p_type", F.lit(" , /* x */ int  n ) // end"))
    return part.select("p_partkey", S.normalise_signature(raw).alias("signature"))


@query("fn_06_signatures", "part", "SELECT p_partkey, 'git@x::pkg::' || p_brand AS package, 'git@x::file::' || p_name AS file, 'git@x::method::' || p_name || '#' || p_type || '(a,b)' AS method, 'git@x::method::' || p_name || '#' || p_type || '(a,b)#block_0_entry' AS block FROM part")
def signatures(part):
    repo = F.lit("git@x")
    method = S.signature("method", repo, "p_name", "p_type", F.array(F.lit("a "), F.lit(" b")))
    return part.select("p_partkey", S.signature("package", repo, "p_brand").alias("package"), S.signature("file", repo, "p_name").alias("file"), method.alias("method"), S.block_signature(method, F.lit(0), F.lit("entry")).alias("block"))


@query("fn_08_paths", "churn_event", "SELECT row_id, replace(file_path, 'src/', 'lib/src/') AS path, regexp_replace(replace(file_path, 'src/', 'lib/src/'), '/[^/]*$', '') AS dir FROM churn_event")
def paths(churn):
    path = S.normalise_path(F.concat(F.lit(r".\lib\\x/../"), "file_path"))
    return churn.select("row_id", path.alias("path"), S.dirname(path).alias("dir"))


@query("fn_09_positive_int", "events", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN user_id > 0 THEN CAST(user_id AS INTEGER) END AS line FROM events")
def positive_int(events):
    raw = F.when(F.expr("event_id % 3 = 0"), F.concat(F.col("user_id").cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return events.select("event_id", S.positive_int(raw).alias("line"))


@query("fn_11_tokens", "documents", r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^ \t\r\n]')) AS INTEGER) AS tokens FROM documents")
def token_counts(documents):
    return documents.select("doc_id", F.size(S.tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


@query("fn_12_token_windows", "documents", None)
def token_windows(documents):
    """FNV-1a of all runs of fifty tokens of each text: how many, how many different, and the smallest (checked against an independent FNV in the tests)."""
    hashes = documents.select("doc_id", S.fnv64a_windows(S.tokens(F.coalesce("text", F.lit(""))), 50).alias("h"))
    return hashes.select("doc_id", F.size("h").cast("long").alias("windows"), F.size(F.array_distinct("h")).cast("long").alias("different"), F.array_min("h").alias("smallest"))


@query("fn_13_hold_out", "episode", None)
def hold_outs(episodes):
    """FNV-1a hold-out of a tenth of the episodes (checked against an independent FNV in the tests)."""
    return episodes.select("episode_id", S.hold_out("episode_id", 0.1).alias("held_out"))


@query("fn_14_activations", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + exp(-(l_quantity - 25))), 6) AS sigmoid, round(ln(1 + exp(l_quantity - 25)), 6) AS softplus, round(least(1, greatest(0, l_quantity / 40)), 6) AS clamped FROM lineitem")
def activations(lineitem):
    z = F.col("l_quantity") - 25
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.sigmoid(z), 6).alias("sigmoid"), F.round(S.softplus(z), 6).alias("softplus"), F.round(S.clamp(F.col("l_quantity") / 40), 6).alias("clamped"))


@query("fn_17_month", "orders", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1")
def months(orders):
    return orders.groupBy(S.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("fn_18_age_days", "events", f"SELECT event_id, CAST(floor((epoch({NOW_SQL}) - epoch(ts)) / 86400) AS BIGINT) AS age FROM events")
def ages(events):
    return events.select("event_id", S.age_days("ts", F.lit("2024-01-31 00:00:00")).alias("age"))


@query("fn_19_json", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS doubled, event_type || ':' || CAST(json_extract(props, '$.k') AS STRING) AS tag FROM events")
def json_round_trip(events):
    made = F.to_json(F.struct(F.struct(F.from_json("props", "k BIGINT")["k"].alias("k"), F.col("event_type").alias("t")).alias("in")))
    back = events.select("event_id", F.from_json(made, "in STRUCT<k: BIGINT, t: STRING>").alias("x"))
    return back.select("event_id", (F.col("x.in.k") * 2).alias("doubled"), F.concat_ws(":", "x.in.t", "x.in.k").alias("tag"))


@query("fn_22_blended_effort", "finding", None)
def blended(findings):
    """Hours by the hash of model and task (checked against an independent FNV in the tests)."""
    ids = F.md5(F.col("scope_id").cast("binary"))
    kinds = findings.select("finding_id", ids.alias("u"), "rule_id", S.task_kind("rule_id").alias("kind"))
    return kinds.select("finding_id", F.round(S.blended_effort("kind", F.lit(1.5), "u", "rule_id", "v1", 7), 4).alias("hours"))


@query("fn_23_hop_discount", "edge", "SELECT edge_id, length(edge_id) * pow(0.5, length(kind) % 4) AS score FROM edge")
def hop_discounts(edges):
    return edges.select("edge_id", S.hop_discount(F.length("edge_id"), F.length("kind") % 4).alias("score"))


@query("fn_24_decision_table", "region", "SELECT 'if' AS decision, 1 AS cyclo, 1 AS cognitive, true AS bonus, true AS pushes UNION ALL SELECT 'else_if', 1, 1, false, false UNION ALL SELECT 'else', 0, 1, false, false UNION ALL SELECT 'for', 1, 1, true, true UNION ALL SELECT 'while', 1, 1, true, true UNION ALL SELECT 'do_while', 1, 1, true, true UNION ALL SELECT 'case', 1, 1, true, true UNION ALL SELECT 'catch', 1, 1, true, true UNION ALL SELECT 'ternary', 1, 1, true, false UNION ALL SELECT 'logical_and', 1, 1, false, false UNION ALL SELECT 'logical_or', 1, 1, false, false UNION ALL SELECT 'break_label', 0, 1, false, false UNION ALL SELECT 'continue_label', 0, 1, false, false UNION ALL SELECT 'goto', 0, 1, false, false UNION ALL SELECT 'recursion', 0, 1, false, false")
def decision_table(region):
    from cairn.operators import code_metrics

    return code_metrics.decisions(region)
