"""Queries over samples, findings and overrides: scans, filters, joins, sets, newest rows, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import common as C
from cairn.operators import ordered as O
from cairn.operators import samples as M
from cairn.plans.catalog import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ACTIVE = """act AS (SELECT m.*, b.canonical_signature, b.package FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sha, scope_id, metric_kind, metric_version ORDER BY seq DESC) AS rn FROM metric_sample) WHERE rn = 1) m
JOIN scope_binding b ON b.scope_id = m.scope_id WHERE m.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM metric_retraction r WHERE r.sample_id = m.sample_id))"""
SAMPLES = "metric_sample metric_retraction scope_binding"
QUANTS = "round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query("src_01_read_active", SAMPLES, f"WITH {ACTIVE} SELECT sample_id, repo_id, sha, scope_id, metric_kind, metric_version, value, canonical_signature FROM act")
def read_active(samples, retractions, scopes):
    return M.active(samples, retractions, scopes).select("sample_id", "repo_id", "sha", "scope_id", "metric_kind", "metric_version", "value", "canonical_signature")


@query("agg_03_repo_metric_snapshot", SAMPLES, f"WITH {ACTIVE} SELECT repo_id, metric_kind, scope_kind, count(*) AS n, round(avg(value), 6) AS mean, {QUANTS} FROM act GROUP BY ALL")
def repo_metric_snapshot(samples, retractions, scopes):
    return rounded(M.repo_snapshot(M.active(samples, retractions, scopes)), "mean", "p50", "p90", "p99")


@query(
    "agg_04_cross_repo_percentile",
    SAMPLES,
    f"""WITH {ACTIVE}, p AS (SELECT metric_kind, scope_kind, count(*) AS n, round(avg(value), 6) AS mean, {QUANTS} FROM act GROUP BY ALL),
    r AS (SELECT metric_kind, scope_kind, repo_id, count(*) AS n FROM act GROUP BY ALL)
    SELECT p.*, (SELECT string_agg(r.repo_id || ':' || r.n, ',' ORDER BY r.repo_id) FROM r WHERE r.metric_kind = p.metric_kind AND r.scope_kind = p.scope_kind) AS repos FROM p""",
)
def cross_repo_percentile(samples, retractions, scopes):
    pooled, own = M.cross_repo(M.active(samples, retractions, scopes))
    repos = own.groupBy("metric_kind", "scope_kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo_id", "n"))), lambda x: F.concat_ws(":", x["repo_id"], x["n"])), ",").alias("repos"))
    return rounded(pooled, "mean", "p50", "p90", "p99").join(repos, ["metric_kind", "scope_kind"])


@query(
    "agg_05_portfolio_snapshot",
    SAMPLES,
    f"""WITH {ACTIVE}, r AS (SELECT metric_kind, scope_kind, repo_id, count(*) AS n, avg(value) AS mean FROM act GROUP BY ALL),
    a AS (SELECT metric_kind, scope_kind, CAST(sum(n) AS BIGINT) AS total_observations, count(*) AS repo_count, round(sum(mean * n) / sum(n), 6) AS weighted_mean, round(avg(mean), 6) AS unweighted_mean FROM r GROUP BY ALL),
    p AS (SELECT metric_kind, scope_kind, {QUANTS} FROM act GROUP BY ALL) SELECT a.*, p50, p90, p99 FROM a JOIN p USING (metric_kind, scope_kind)""",
)
def portfolio_snapshot(samples, retractions, scopes):
    return rounded(M.portfolio(M.active(samples, retractions, scopes)), "weighted_mean", "unweighted_mean", "p50", "p90", "p99")


@query("flt_01_optional_filters", "metric_sample", "SELECT sample_id, value FROM metric_sample WHERE metric_kind = 'cyclo' AND pack = 'solid' AND source = 'computed'")
def optional_filters(samples):
    given = {"metric_kind": "cyclo", "scope_kind": None, "pack": "solid", "source": "computed"}
    for column, value in given.items():
        if value is not None:
            samples = samples.where(F.col(column) == value)
    return samples.select("sample_id", "value")


@query("flt_02_membership", "finding", "SELECT finding_id FROM finding WHERE delta IN ('new', 'newly_failing') AND rule_id IN ('solid.srp.size', 'decoupling.cycles')")
def membership(findings):
    return findings.where(C.any_of_or_all("delta", ["new", "newly_failing"]) & C.any_of_or_all("rule_id", ["solid.srp.size", "decoupling.cycles"])).select("finding_id")


@query("flt_03_empty_means_all", "finding", "SELECT severity, count(*) AS n FROM finding GROUP BY severity")
def empty_means_all(findings):
    return findings.where(C.any_of_or_all("delta", [])).groupBy("severity").agg(F.count("*").alias("n"))


@query("flt_04_signature_search", "node", r"SELECT node_id, canonical_signature FROM node WHERE canonical_signature LIKE 'STANDARD%.1\_%' ESCAPE '\' OR canonical_signature LIKE '%.1_' ESCAPE '\'")
def signature_search(nodes):
    literal = F.concat(F.lit("STANDARD%"), S.like_escape(F.lit(".1_")), F.lit("%"))
    return nodes.where(F.like("canonical_signature", literal) | F.like("canonical_signature", F.lit("%.1_"))).select("node_id", "canonical_signature")


@query("flt_05_json_attribute", "events", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, coalesce(try_cast(json_extract_string(props, '$.start_line') AS INTEGER), 0) AS start_line FROM events")
def json_attribute(events):
    return events.select("event_id", *[F.coalesce(F.get_json_object("props", f"$.{k}").try_cast("int"), F.lit(0)).alias(k) for k in ("k", "start_line")])


@query("flt_06_null_safe_equality", "commit", "SELECT a.repo_id, a.parent_sha, count(*) AS n FROM commit a JOIN commit b ON a.repo_id = b.repo_id AND a.parent_sha IS NOT DISTINCT FROM b.parent_sha GROUP BY ALL")
def null_safe(commits):
    left, right = commits.select("repo_id", "parent_sha"), commits.groupBy("repo_id", "parent_sha").agg(F.count("*").alias("n"))
    own = left.groupBy("repo_id", "parent_sha").agg(F.count("*").alias("own")).alias("a")
    joined = own.join(right.alias("b"), (F.col("a.repo_id") == F.col("b.repo_id")) & F.col("a.parent_sha").eqNullSafe(F.col("b.parent_sha")))
    return joined.select("a.repo_id", "a.parent_sha", (F.col("own") * F.col("n")).alias("n"))


@query("flt_07_keyset_page", "commit", "SELECT committed_at, repo_id, sha FROM commit WHERE scan_status = 'scanned' AND (committed_at, repo_id, sha) > (TIMESTAMP '2024-01-10 00:00:00', 'u5', 'c1') ORDER BY committed_at, repo_id, sha LIMIT 50")
def keyset_page(commits):
    keys = ["committed_at", "repo_id", "sha"]
    after = C.keyset_after(keys, [F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "u5", "c1"])
    return commits.where((F.col("scan_status") == "scanned") & after).orderBy(*keys).limit(50).select(*keys)


@query("flt_08_since", "events", f"SELECT event_id, ts FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY")
def since(events):
    return events.where(F.col("ts") >= F.expr(f"CAST({NOW} AS TIMESTAMP_NTZ) - INTERVAL 7 DAYS")).select("event_id", "ts")


GLOB_SQL = r"""WITH p AS (SELECT override_id, rule_id, repo_id, mute, created_rank, '^' || replace(replace(regexp_replace(scope_glob, '([.\[\]{}()^$+|*?\\])', '\\\1', 'g'), '\*', '.*'), '\?', '.') || '$' AS re FROM override),
f AS (SELECT DISTINCT rule_id, repo_id, scope_id FROM finding),
m AS (SELECT f.rule_id, f.repo_id, f.scope_id, p.override_id, p.mute, row_number() OVER (PARTITION BY f.rule_id, f.repo_id, f.scope_id ORDER BY p.created_rank DESC, p.override_id DESC) AS rn FROM f JOIN p ON f.rule_id = p.rule_id AND f.repo_id = p.repo_id AND regexp_matches(f.scope_id, p.re))"""


@query("jn_12_newest_matching_override", "finding override", f"{GLOB_SQL} SELECT rule_id, repo_id, scope_id, override_id, mute FROM m WHERE rn = 1")
def newest_override(findings, overrides):
    from cairn.operators import policy

    scopes = findings.select("rule_id", "repo_id", "scope_id").distinct()
    return policy.deciding_override(scopes, overrides).select("rule_id", "repo_id", "scope_id", "override_id", "mute")


@query("flt_09_glob", "override", r"SELECT override_id, '^' || replace(replace(regexp_replace(scope_glob, '([.\[\]{}()^$+|*?\\])', '\\\1', 'g'), '\*', '.*'), '\?', '.') || '$' AS pattern, regexp_matches('p17', '^' || replace(replace(scope_glob, '*', '.*'), '?', '.') || '$') AS hit FROM override")
def glob(overrides):
    shown = F.regexp_replace(S.glob_regex("scope_glob"), r"^\(\?s\)", "")
    return overrides.select("override_id", shown.alias("pattern"), F.rlike(F.lit("p17"), S.glob_regex("scope_glob")).alias("hit"))


@query("flt_10_not_retracted", "metric_sample metric_retraction", "SELECT m.metric_kind, m.pack, count(*) AS n FROM metric_sample m LEFT JOIN metric_retraction r ON r.sample_id = m.sample_id WHERE r.sample_id IS NULL GROUP BY ALL")
def not_retracted(samples, retractions):
    return C.without(samples, retractions, "sample_id").groupBy("metric_kind", "pack").agg(F.count("*").alias("n"))


@query(
    "flt_11_freshness",
    "metric_sample",
    "SELECT repo_id, metric_kind, max(created_at) AS built_at, max(created_at) IS NULL OR epoch(TIMESTAMP '2001-12-31 00:00:00') - epoch(max(created_at)) > 864000 AS degraded, CASE WHEN max(created_at) IS NULL OR epoch(TIMESTAMP '2001-12-31 00:00:00') - epoch(max(created_at)) > 864000 THEN 'percentile_stale' END AS degraded_reason FROM metric_sample GROUP BY ALL",
)
def freshness(samples):
    built = samples.groupBy("repo_id", "metric_kind").agg(F.max("created_at").alias("built_at"))
    return M.fresh(built, F.lit("2001-12-31 00:00:00"), limit_seconds=864_000)


REASONS = "CASE event_type WHEN 'error' THEN 'graph_store_unavailable' WHEN 'view' THEN 'reranker_model_stale' WHEN 'click' THEN 'consolidator_backpressure' WHEN 'signup' THEN 'other' END"


@query(
    "flt_12_worst_reason",
    "events",
    f"""SELECT user_id, hour, reason AS degraded_reason FROM (SELECT user_id, date_trunc('hour', ts) AS hour, {REASONS} AS reason, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts)
    ORDER BY CASE {REASONS} WHEN 'graph_store_unavailable' THEN 90 WHEN 'reranker_model_stale' THEN 50 WHEN 'consolidator_backpressure' THEN 20 ELSE 0 END DESC, {REASONS}) AS rn FROM events WHERE {REASONS} IS NOT NULL) WHERE rn = 1""",
)
def worst_reason(events):
    return M.worst_reason(events.select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.expr(REASONS).alias("reason")), ["user_id", "hour"])


@query("jn_01_star_join", "lineitem orders customer nation region", "SELECT r_name, o_orderpriority, count(*) AS n, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,2))), 2) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(lineitem, orders, customer, nation, region):
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("jn_02_left_with_default", "edge trace_observation", "SELECT e.edge_id, e.kind, coalesce(t.observation_count, 0) AS observation_count FROM edge e LEFT JOIN trace_observation t USING (edge_id)")
def left_default(edges, observations):
    return edges.join(observations, "edge_id", "left").select("edge_id", "kind", F.coalesce("observation_count", F.lit(0).cast("long")).alias("observation_count"))


@query("jn_03_anti_join", "node node_retirement", "SELECT node_id, kind FROM node n WHERE NOT EXISTS (SELECT 1 FROM node_retirement r WHERE r.node_id = n.node_id)")
def anti_join(nodes, retired):
    return C.without(nodes, retired, "node_id").select("node_id", "kind")


@query("jn_04_semi_join", "edge sha_lineage", "SELECT edge_id FROM edge e WHERE EXISTS (SELECT 1 FROM sha_lineage s WHERE s.sha = e.from_sha AND s.sha <= 's1997')")
def semi_join(edges, lineage):
    return edges.join(lineage.where("sha <= 's1997'").withColumnRenamed("sha", "from_sha"), "from_sha", "left_semi").select("edge_id")


@query("jn_05_as_of_latest", "episode episode_update", "SELECT e.episode_id, coalesce((SELECT outcome FROM episode_update u WHERE u.episode_id = e.episode_id AND u.created_at >= e.created_at ORDER BY u.created_at DESC, u.update_id DESC LIMIT 1), e.outcome) AS outcome FROM episode e")
def as_of_latest(episodes, updates):
    from cairn.operators import memory

    return memory.effective_outcome(episodes, updates).select("episode_id", F.col("effective_outcome").alias("outcome"))


@query(
    "jn_06_narrowest_interval",
    "events node",
    """WITH s AS (SELECT event_id, 'Brand#' || CAST(1 + user_id % 5 AS STRING) || CAST(1 + event_id % 5 AS STRING) AS repo_id, event_id % 55 AS line FROM events)
    SELECT event_id, node_id FROM (SELECT s.event_id, n.node_id, row_number() OVER (PARTITION BY s.event_id ORDER BY n.end_line - n.start_line, n.node_id) AS rn FROM s JOIN node n ON s.repo_id = n.repo_id AND s.line BETWEEN n.start_line AND n.end_line) WHERE rn = 1""",
)
def narrowest_interval(events, nodes):

    spans = events.selectExpr("event_id", "'Brand#' || CAST(1 + user_id % 5 AS STRING) || CAST(1 + event_id % 5 AS STRING) AS repo_id", "event_id % 55 AS line")
    return O.narrowest(spans, "event_id", nodes.select("repo_id", "node_id", "start_line", "end_line"), ["repo_id"]).select("event_id", "node_id")


@query("jn_07_parent_span", "span", "SELECT c.trace_id, c.span_id, c.method AS callee, p.method AS caller FROM span c JOIN span p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id")
def parent_span(spans):
    callers = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("method").alias("caller"))
    return spans.join(callers, ["trace_id", "parent_span_id"]).select("trace_id", "span_id", F.col("method").alias("callee"), "caller")


@query("jn_09_role_targets", "observation node concept_version", "SELECT o.role, CASE WHEN o.node_id IS NOT NULL THEN 'node' ELSE 'concept' END AS target, count(*) AS n, count(nn.node_id) AS nodes, count(c.concept_id) AS concepts FROM observation o LEFT JOIN node nn ON nn.node_id = o.node_id LEFT JOIN (SELECT DISTINCT concept_id FROM concept_version) c ON c.concept_id = o.concept_id GROUP BY ALL")
def role_targets(observations, nodes, concepts):
    named = observations.join(nodes.select("node_id", F.lit(1).alias("is_node")), "node_id", "left").join(concepts.select("concept_id").distinct().withColumn("is_concept", F.lit(1)), "concept_id", "left")
    return named.groupBy("role", F.when(F.col("node_id").isNotNull(), "node").otherwise("concept").alias("target")).agg(F.count("*").alias("n"), F.count("is_node").alias("nodes"), F.count("is_concept").alias("concepts"))


@query("jn_10_array_keys", "episode", "SELECT repo_id, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT repo_id, unnest(['ep' || CAST(k AS STRING), 'ep' || CAST(k * 2 AS STRING)]) AS id FROM episode) x WHERE id IN (SELECT episode_id FROM episode) GROUP BY repo_id")
def array_keys(episodes):
    lists = episodes.select("repo_id", F.array(F.concat(F.lit("ep"), "k"), F.concat(F.lit("ep"), F.col("k") * 2)).alias("ids"))
    return lists.select("repo_id", F.explode("ids").alias("episode_id")).join(episodes.select("episode_id"), "episode_id", "left_semi").groupBy("repo_id").agg(F.count("*").alias("n"), F.countDistinct("episode_id").alias("ids"))


@query("jn_11_key_list", "metric_sample", "SELECT sample_id, repo_id, sha FROM metric_sample JOIN (VALUES ('r1', 's1995'), ('r2', 's1996'), ('r3', 's1999')) v(r, s) ON repo_id = v.r AND sha = v.s")
def key_list(samples):
    wanted = samples.sparkSession.createDataFrame([("r1", "s1995"), ("r2", "s1996"), ("r3", "s1999")], "repo_id string, sha string")
    return samples.join(F.broadcast(wanted), ["repo_id", "sha"]).select("sample_id", "repo_id", "sha")


@query(
    "jn_14_cascade_failures",
    "commit",
    "SELECT c.repo_id, c.sha, CASE WHEN c.scan_status = 'scanned' AND p.scan_status = 'failed' THEN 'failed' ELSE c.scan_status END AS scan_status FROM commit c LEFT JOIN commit p ON p.repo_id = c.repo_id AND p.sha = c.parent_sha",
)
def cascade(commits):
    failed = commits.where("scan_status = 'failed'").select("repo_id", F.col("sha").alias("parent_sha"), F.lit(True).alias("_failed"))
    return commits.join(failed, ["repo_id", "parent_sha"], "left").select("repo_id", "sha", F.when(F.col("_failed"), "failed").otherwise(F.col("scan_status")).alias("scan_status"))


@query("agg_06_finding_counts", "finding", "SELECT repo_id, scope_id, count(*) AS n FROM finding WHERE delta IN ('new', 'newly_failing') GROUP BY ALL")
def finding_counts(findings):
    return findings.where(F.col("delta").isin("new", "newly_failing")).groupBy("repo_id", "scope_id").agg(F.count("*").alias("n"))


@query("win_01_latest_per_key", "finding", "SELECT scope_id, rule_id, finding_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, rule_id ORDER BY created_at DESC, seq DESC) AS rn FROM finding) WHERE rn = 1")
def latest_finding(findings):
    return C.latest(findings, ["scope_id", "rule_id"], ["created_at", "seq"]).select("scope_id", "rule_id", "finding_id", "severity")


@query("src_11_ordered_hydration", "context_log node", "SELECT context_id, position, id AS node_id, n.kind FROM (SELECT context_id, unnest(['n' || k, 'n' || (k * 3), 'x' || k]) AS id, unnest([0, 1, 2]) AS position FROM context_log) x LEFT JOIN node n ON n.node_id = x.id")
def ordered_hydration(contexts, nodes):
    served = contexts.select("context_id", F.array(F.concat(F.lit("n"), "k"), F.concat(F.lit("n"), F.col("k") * 3), F.concat(F.lit("x"), "k")).alias("ids"))
    return C.hydrate(served, "context_id", "ids", nodes.select("node_id", "kind"), "node_id").select("context_id", "position", "node_id", "kind")


@query("top_05_page", "finding", "SELECT finding_id, created_at FROM finding ORDER BY created_at DESC, finding_id LIMIT 200 OFFSET 100")
def page(findings):
    return findings.orderBy(F.desc("created_at"), "finding_id").offset(100).limit(200).select("finding_id", "created_at")


@query("ded_01_null_key_dedup", "observation", "SELECT DISTINCT episode_id, coalesce(node_id, '<<NULL>>') AS node_key FROM observation")
def null_dedup(observations):
    return observations.select("episode_id", F.coalesce("node_id", F.lit("<<NULL>>")).alias("node_key")).distinct()


@query("ded_02_distinct_pairs", "finding", "SELECT DISTINCT scope_id, rule_id FROM finding WHERE severity = 'block'")
def distinct_pairs(findings):
    return findings.where("severity = 'block'").select("scope_id", "rule_id").distinct()


@query("set_03_candidate_count", "episode", f"SELECT count(*) AS n FROM (SELECT episode_id FROM episode WHERE kind = 'synthetic_positive' UNION SELECT episode_id FROM episode WHERE kind = 'agent' AND outcome = 'success' AND created_at >= {NOW} - INTERVAL 90 DAY)")
def candidate_count(episodes):
    recent = F.col("created_at") >= F.expr(f"CAST({NOW} AS TIMESTAMP_NTZ) - INTERVAL 90 DAYS")
    good = episodes.where("kind = 'agent' AND outcome = 'success'").where(recent).select("episode_id")
    return episodes.where("kind = 'synthetic_positive'").select("episode_id").union(good).distinct().agg(F.count("*").alias("n"))


@query("set_05_snapshot_difference", "node", "SELECT node_id, 'appeared' AS change FROM node WHERE from_sha = 's1999' AND node_id NOT IN (SELECT node_id FROM node WHERE end_line > 30) UNION ALL SELECT node_id, 'disappeared' FROM node WHERE end_line > 30 AND node_id NOT IN (SELECT node_id FROM node WHERE from_sha = 's1999')")
def snapshot_difference(nodes):
    before, after = nodes.where("end_line > 30").select("node_id"), nodes.where("from_sha = 's1999'").select("node_id")
    return after.join(before, "node_id", "left_anti").withColumn("change", F.lit("appeared")).union(before.join(after, "node_id", "left_anti").withColumn("change", F.lit("disappeared")))


@query("snk_02_upsert_pointer", "metric_sample", "SELECT repo_id, sha, scope_id, metric_kind, metric_version, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sha, scope_id, metric_kind, metric_version ORDER BY seq DESC) AS rn FROM metric_sample) WHERE rn = 1")
def upsert_pointer(samples):
    columns = [*M.FIVE, "sample_id", "seq"]
    return M.upsert_pointer(samples.where("seq % 2 = 0").select(*columns), samples.where("seq % 2 = 1").select(*columns)).drop("seq")


@query("snk_03_idempotent_insert", "metric_sample", "SELECT DISTINCT repo_id, metric_kind, scope_kind FROM metric_sample WHERE value > 40 AND (repo_id, metric_kind, scope_kind) NOT IN (SELECT repo_id, metric_kind, scope_kind FROM metric_sample WHERE value > 49.5)")
def idempotent_insert(samples):
    key = ["repo_id", "metric_kind", "scope_kind"]
    return C.insert_new(samples.where("value > 49.5").select(*key), samples.where("value > 40").select(*key), key)


@query(
    "snk_04_system_rows_missing",
    SAMPLES,
    f"WITH {ACTIVE} SELECT DISTINCT m.repo_id, m.sha, m.scope_id, m.metric_kind, m.metric_version FROM metric_sample m WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.repo_id = m.repo_id AND a.sha = m.sha AND a.scope_id = m.scope_id AND a.metric_kind = m.metric_kind AND a.metric_version = m.metric_version)",
)
def system_rows_missing(samples, retractions, scopes):
    return C.insert_new(M.active(samples, retractions, scopes), samples.select(*M.FIVE), list(M.FIVE))


@query("ins_01_regressions", "finding", "SELECT repo_id, rule_id, count(*) AS n, max(created_at) AS latest FROM finding WHERE delta = 'newly_failing' GROUP BY ALL")
def regressions(findings):
    return findings.where("delta = 'newly_failing'").groupBy("repo_id", "rule_id").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))


@query("ins_01_metric_samples", SAMPLES, f"WITH {ACTIVE} SELECT sample_id, repo_id, sha, scope_id, metric_kind, metric_version, value, canonical_signature FROM act WHERE repo_id = 'r7' AND sha = 's1997' AND metric_kind = 'cyclo'")
def metric_samples(samples, retractions, scopes):
    """Active samples of a repository and commit, with an optional filter; the filters reach the scan, since they are part of the key."""
    rows = samples.where("repo_id = 'r7' AND sha = 's1997'").where(C.any_of_or_all("metric_kind", ["cyclo"]))
    return M.active(rows, retractions, scopes).select("sample_id", "repo_id", "sha", "scope_id", "metric_kind", "metric_version", "value", "canonical_signature")


@query("ins_01_findings", "finding", "SELECT finding_id, scope_id, rule_id, severity, delta, created_at FROM finding WHERE repo_id = 'r3' AND sha = 's1996' ORDER BY created_at DESC, finding_id")
def findings_of_commit(findings):
    return findings.where("repo_id = 'r3' AND sha = 's1996'").orderBy(F.desc("created_at"), "finding_id").select("finding_id", "scope_id", "rule_id", "severity", "delta", "created_at")


PLANS_SQL = "plans AS (SELECT repo_id || '/' || sha || '/' || rule_id AS plan_id, repo_id, sha, max(created_at) AS created_at FROM finding GROUP BY repo_id, sha, rule_id), tasks AS (SELECT repo_id || '/' || sha || '/' || rule_id AS plan_id, scope_id, min(finding_id) AS task_id, max(created_at) AS created_at FROM finding WHERE delta IN ('new', 'newly_failing') GROUP BY ALL)"


@query("ins_01_refactor_plan", "finding", f"WITH {PLANS_SQL}, p AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY repo_id, sha ORDER BY created_at DESC, plan_id DESC) = 1) SELECT p.repo_id, p.sha, p.plan_id, t.task_id, t.scope_id FROM p LEFT JOIN tasks t USING (plan_id)")
def refactor_plan(findings):
    """The newest plan of each repository and commit with its tasks; a plan without tasks is a row too."""
    rows = findings.withColumn("plan_id", F.concat_ws("/", "repo_id", "sha", "rule_id"))
    plans = rows.groupBy("plan_id", "repo_id", "sha").agg(F.max("created_at").alias("created_at"))
    tasks = rows.where("delta IN ('new', 'newly_failing')").groupBy("plan_id", "scope_id").agg(F.min("finding_id").alias("task_id"))
    return C.latest(plans, ["repo_id", "sha"], ["created_at", "plan_id"]).join(tasks, "plan_id", "left").select("repo_id", "sha", "plan_id", "task_id", "scope_id")


@query(
    "ins_02_latest_percentile",
    SAMPLES,
    f"""WITH {ACTIVE}, built AS (SELECT metric_kind, scope_kind, sha, count(*) AS n, {QUANTS}, make_timestamp(CAST(substr(sha, 2) AS BIGINT), 12, 31, 0, 0, 0) AS built_at FROM act GROUP BY ALL)
    SELECT metric_kind, scope_kind, sha, n, p50, p90, p99, epoch(TIMESTAMP '1998-12-31 00:30:00') - epoch(built_at) > 3600 AS degraded, CASE WHEN epoch(TIMESTAMP '1998-12-31 00:30:00') - epoch(built_at) > 3600 THEN 'percentile_stale' END AS degraded_reason
    FROM built WHERE sha <= 's1998' QUALIFY row_number() OVER (PARTITION BY metric_kind, scope_kind ORDER BY built_at DESC) = 1""",
)
def latest_percentile(samples, retractions, scopes):
    """The newest percentiles of each metric and scope kind, and whether they are too old to be shown without a remark."""
    rows = M.active(samples.where("sha <= 's1998'"), retractions, scopes)
    built = O.percentiles(rows, ["metric_kind", "scope_kind", "sha"], "value", **M.SHARES).withColumn("built_at", F.make_timestamp_ntz(F.substring("sha", 2, 4).cast("int"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)))
    newest = M.fresh(C.latest(built, ["metric_kind", "scope_kind"], ["built_at"]), F.lit("1998-12-31 00:30:00"))
    return rounded(newest.select("metric_kind", "scope_kind", "sha", "n", "p50", "p90", "p99", "degraded", "degraded_reason"), "p50", "p90", "p99")


@query("ins_03_aged_mutes", "override", "SELECT rule_id, repo_id, scope_glob, override_id, age_days FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, repo_id, scope_glob ORDER BY created_rank DESC, override_id DESC) AS rn FROM override) WHERE rn = 1 AND mute AND age_days > 90")
def aged_mutes(overrides):
    newest = C.latest(overrides, ["rule_id", "repo_id", "scope_glob"], ["created_rank", "override_id"])
    return newest.where(F.col("mute") & (F.col("age_days") > 90)).orderBy(F.desc("age_days"), "override_id").select("rule_id", "repo_id", "scope_glob", "override_id", "age_days")

