"""Relations of the analytic domain, derived from the input tables.

The input tables hold no code metrics, graphs or spans. These views give them such a reading; they are
test relations and no part of any operator. Each is SQL that Spark and DuckDB both run, so that a query
and its counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _add(name: str, needs: str, sql: str) -> None:
    FIXTURES[name] = (sql, tuple(needs.split()))


# A metric sample for each order line: repository = supplier, commit = ship year, scope = part.
_add(
    "metric_sample",
    "lineitem",
    """SELECT 'm' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS sample_id, 'r' || CAST(l_suppkey AS STRING) AS repo_id,
    's' || CAST(year(l_shipdate) AS STRING) AS sha, 'p' || CAST(l_partkey AS STRING) AS scope_id,
    CASE l_returnflag WHEN 'A' THEN 'cyclo' WHEN 'N' THEN 'fan_out' ELSE 'modification_count_in_window' END AS metric_kind,
    CASE l_linestatus WHEN 'O' THEN 'method' ELSE 'file' END AS scope_kind, CAST(l_linenumber AS BIGINT) AS metric_version,
    CASE WHEN l_tax < 0.075 THEN l_quantity END AS value, l_tax >= 0.075 AS degraded,
    CASE WHEN l_tax < 0.03 THEN 'base' WHEN l_tax < 0.06 THEN 'solid' ELSE 'ingested' END AS pack, CASE WHEN l_linenumber % 2 = 0 THEN 'computed' ELSE 'ingested' END AS source,
    l_shipdate AS created_at, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM lineitem""",
)
_add("metric_retraction", "lineitem", "SELECT 'm' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS sample_id, l_shipdate AS created_at FROM lineitem WHERE l_discount >= 0.095")
_add("scope_binding", "part", "SELECT 'p' || CAST(p_partkey AS STRING) AS scope_id, p_type || '/' || p_brand || '/' || p_name AS canonical_signature, p_brand AS package FROM part")
# Commits: the events of a user make a tree, the parent of the n-th is the (n / 2)-th.
_add(
    "commit",
    "events",
    """SELECT a.repo_id, a.sha, b.sha AS parent_sha, a.committed_at, a.scan_status, a.rn FROM
    (SELECT 'u' || CAST(user_id AS STRING) AS repo_id, 'c' || CAST(event_id AS STRING) AS sha, ts AS committed_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'scanned' END AS scan_status,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events) a
    LEFT JOIN (SELECT 'u' || CAST(user_id AS STRING) AS repo_id, 'c' || CAST(event_id AS STRING) AS sha, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn FROM events) b
    ON a.repo_id = b.repo_id AND b.rn = CAST(floor(a.rn / 2) AS BIGINT) AND a.rn > 1""",
)
_add(
    "churn_event",
    "events",
    """SELECT 'f' || CAST(user_id AS STRING) AS scope_id, md5(CAST(event_id % 97 AS STRING)) || '00000000' AS sha, ts AS modified_at, event_type AS author, event_id AS row_id,
    'src/' || event_type || '/f' || CAST(user_id % 25 AS STRING) || '.py' AS file_path FROM events""",
)
_add(
    "span",
    "events",
    """SELECT user_id AS trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_span_id, ts AS started_at, value AS duration_ms,
    'k' || CAST(user_id % 10 AS STRING) || ':' || event_type AS method FROM events""",
)
_add(
    "node",
    "part",
    """SELECT 'n' || CAST(p_partkey AS STRING) AS node_id, CASE WHEN p_partkey % 100 = 0 THEN 'package' WHEN p_partkey % 10 = 0 THEN 'file' WHEN p_partkey % 10 = 1 THEN 'class' ELSE 'method' END AS kind,
    p_type || '.' || p_name || '.' || CAST(p_partkey % 50 AS STRING) AS canonical_signature,
    CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 'n' || CAST(p_partkey - p_partkey % 100 AS STRING) WHEN p_partkey % 10 = 1 THEN 'n' || CAST(p_partkey - 1 AS STRING) ELSE 'n' || CAST(p_partkey - p_partkey % 10 + 1 AS STRING) END AS parent_node_id,
    's' || CAST(1995 + p_size % 5 AS STRING) AS from_sha, p_brand AS repo_id, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + p_partkey % 7 AS BIGINT) AS end_line FROM part""",
)
_add("node_retirement", "part", "SELECT 'n' || CAST(p_partkey AS STRING) AS node_id, 's1999' AS retired_at_sha FROM part WHERE p_partkey % 17 = 0")
_add(
    "edge",
    "lineitem",
    """SELECT 'e' || CAST(src AS STRING) || '-' || CAST(dst AS STRING) || '-' || kind AS edge_id, 'n' || CAST(src AS STRING) AS src_node_id, 'n' || CAST(dst AS STRING) AS dst_node_id, kind, min(from_sha) AS from_sha
    FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst,
      CASE l_linenumber % 3 WHEN 0 THEN 'static_calls' WHEN 1 THEN 'observed_calls' ELSE 'imports' END AS kind, 's' || CAST(year(l_shipdate) AS STRING) AS from_sha FROM lineitem) x
    WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst, kind""",
)
_add("edge_retirement", "edge", "SELECT edge_id, 's' || CAST(1996 + length(edge_id) % 5 AS STRING) AS retired_at_sha FROM edge WHERE length(edge_id) % 4 = 0 AND from_sha < 's1999'")
_add("sha_lineage", "", "SELECT 's' || CAST(y AS STRING) AS sha, CASE WHEN y > 1992 THEN 's' || CAST(y - 1 AS STRING) END AS parent_sha FROM (VALUES (1992), (1993), (1994), (1995), (1996), (1997), (1998), (1999), (2000), (2001), (2002)) t(y)")
_add("trace_observation", "edge", "SELECT edge_id, CAST(length(edge_id) * 7 % 13 AS BIGINT) AS observation_count FROM edge WHERE kind = 'observed_calls'")
_add(
    "episode",
    "events",
    """SELECT 'ep' || CAST(event_id AS STRING) AS episode_id, event_id AS seq, 'u' || CAST(user_id AS STRING) AS repo_id, 'a' || CAST(user_id % 7 AS STRING) AS actor,
    CASE event_type WHEN 'signup' THEN 'feedback' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'synthetic_positive' ELSE 'agent' END ELSE 'agent' END AS kind,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' WHEN 'click' THEN 'success' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'degraded' ELSE 'refused' END ELSE 'human_corrected' END AS outcome,
    CASE WHEN event_id % 5 = 0 AND event_id > 0 THEN 'ep' || CAST(event_id - 1 AS STRING) END AS parent_episode_id, ts AS created_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value FROM events""",
)
_add("episode_update", "events", "SELECT event_id AS update_id, 'ep' || CAST(event_id - event_id % 11 AS STRING) AS episode_id, CASE WHEN event_id % 3 = 0 THEN 'human_corrected' ELSE 'success' END AS outcome, ts AS created_at FROM events WHERE event_id % 4 = 1")
_add(
    "observation",
    "episode",
    """SELECT episode_id, CASE WHEN k % 3 = 0 THEN 'touched' WHEN k % 3 = 1 THEN 'cited' ELSE 'used' END AS role, CASE WHEN k % 11 = 0 THEN NULL ELSE 'n' || CAST(k % 40 AS STRING) END AS node_id,
    CASE WHEN k % 11 = 0 THEN 'cx' || CAST(k % 5 AS STRING) END AS concept_id, CAST(k AS DOUBLE) / 50 - 0.5 AS weight FROM episode
    UNION ALL SELECT episode_id, 'used' AS role, 'n' || CAST(k % 7 AS STRING) AS node_id, NULL AS concept_id, 0.25 AS weight FROM episode WHERE k % 2 = 0""",
)
_add("context_log", "episode", "SELECT 'ctx' || CAST(seq AS STRING) AS context_id, repo_id, episode_id, k % 9 = 0 AS served_under_degraded, k, created_at, seq, CASE WHEN k % 2 = 0 THEN 'recall' ELSE 'expand' END AS verb FROM episode WHERE kind = 'agent'")
_add(
    "concept_version",
    "customer",
    """SELECT 'cx' || CAST(c_custkey % 100 AS STRING) AS concept_id, CAST(floor(c_custkey / 100) AS BIGINT) AS version_index, CAST(abs(c_acctbal) AS DOUBLE) / 10000 AS confidence, CAST(c_nationkey AS BIGINT) AS support FROM customer""",
)
_add("publish_event", "customer", "SELECT 'cx' || CAST(c_custkey % 50 AS STRING) AS concept_id, c_custkey AS event_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'published' WHEN 'MACHINERY' THEN 'failed' WHEN 'HOUSEHOLD' THEN 'superseded' ELSE 'pending' END AS status FROM customer")
_add(
    "finding",
    "lineitem",
    """SELECT 'fd' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS finding_id, 'r' || CAST(l_suppkey % 20 AS STRING) AS repo_id, 's' || CAST(year(l_shipdate) AS STRING) AS sha,
    'p' || CAST(l_partkey % 200 AS STRING) AS scope_id, CASE l_linenumber % 4 WHEN 0 THEN 'solid.srp.size' WHEN 1 THEN 'solid.isp.width' WHEN 2 THEN 'decoupling.cycles' ELSE 'decoupling.duplication' END AS rule_id,
    CASE WHEN l_quantity > 35 THEN 'block' WHEN l_quantity > 15 THEN 'warn' ELSE 'info' END AS severity, CASE WHEN l_returnflag = 'R' THEN 'resolved' WHEN l_returnflag = 'A' THEN 'new' WHEN l_quantity > 40 THEN 'newly_failing' ELSE 'unchanged' END AS delta,
    l_shipdate AS created_at, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM lineitem""",
)
_add(
    "override",
    "customer",
    """SELECT c_custkey AS override_id, CASE c_custkey % 4 WHEN 0 THEN 'solid.srp.size' WHEN 1 THEN 'solid.isp.width' WHEN 2 THEN 'decoupling.cycles' ELSE 'decoupling.duplication' END AS rule_id,
    'r' || CAST(c_nationkey % 20 AS STRING) AS repo_id, CASE WHEN c_acctbal > 5000 THEN 'p1*' WHEN c_acctbal > 2000 THEN 'p?' ELSE 'p*' || CAST(c_custkey % 10 AS STRING) END AS scope_glob, c_acctbal > 1000 AS mute,
    CAST(c_custkey % 365 AS BIGINT) AS age_days, CAST(c_custkey % 37 AS BIGINT) AS created_rank FROM customer""",
)
_add(
    "scope_inputs",
    "lineitem",
    """SELECT scope_id, max(CASE WHEN f <> 'N' THEN q END) AS cyclo, max(CASE WHEN f = 'A' THEN c END) AS cognitive_complexity, max(CASE WHEN f <> 'A' THEN n END) AS modification_count, max(CASE WHEN f = 'N' THEN s END) AS coupling, max(CASE WHEN f = 'R' THEN s END) AS fan_out
    FROM (SELECT 'p' || CAST(l_partkey AS STRING) AS scope_id, l_returnflag AS f, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(max(l_linenumber) AS DOUBLE) AS c, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS s FROM lineitem GROUP BY l_partkey, l_returnflag) x GROUP BY scope_id""",
)

# A syntax tree: each run of 20 parts is a file with a class, two methods and nested blocks.
_add(
    "ast_scope",
    "part",
    """SELECT 'p' || CAST(p_partkey - p_partkey % 20 AS STRING) AS file, 'p' || CAST(p_partkey AS STRING) AS scope_id,
    CASE p_partkey % 20 WHEN 0 THEN NULL WHEN 1 THEN 'p' || CAST(p_partkey - 1 AS STRING) WHEN 2 THEN 'p' || CAST(p_partkey - 1 AS STRING) WHEN 9 THEN 'p' || CAST(p_partkey - 8 AS STRING)
      ELSE CASE WHEN p_partkey % 20 < 16 THEN 'p' || CAST(p_partkey - 1 AS STRING) ELSE 'p' || CAST(p_partkey - 6 AS STRING) END END AS parent_scope_id,
    CASE p_partkey % 20 WHEN 0 THEN 'file' WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 9 THEN 'method' ELSE 'block' END AS kind,
    CASE WHEN p_partkey % 20 IN (0, 1, 2, 9) THEN NULL ELSE CASE p_size % 8 WHEN 0 THEN 'if' WHEN 1 THEN 'else_if' WHEN 2 THEN 'else' WHEN 3 THEN 'for' WHEN 4 THEN 'ternary' WHEN 5 THEN 'logical_and' WHEN 6 THEN 'goto' ELSE 'case' END END AS decision,
    CAST(p_size % 3 AS BIGINT) AS start_line, CAST(p_size AS BIGINT) AS end_line, CASE WHEN p_partkey % 140 < 20 THEN 'parse_failed' END AS degraded_reason FROM part""",
)
_add("ast_call", "lineitem", "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS edge_id, CASE WHEN l_tax < 0.01 THEN NULL ELSE 'p' || CAST(l_partkey AS STRING) END AS from_scope, CASE WHEN l_tax > 0.07 THEN NULL ELSE 'p' || CAST(l_partkey + l_linenumber * 3 AS STRING) END AS to_scope FROM lineitem")
_add("class_member", "part", "SELECT 'c' || CAST(p_size AS STRING) AS class, 'm' || CAST(p_partkey AS STRING) AS method, p_partkey AS k FROM part")
_add("field_use", "part", "SELECT 'c' || CAST(p_size AS STRING) AS class, 'm' || CAST(p_partkey AS STRING) AS method, 'x' || CAST(p_partkey % 13 AS STRING) AS field FROM part")
_add("member_call", "part", "SELECT 'c' || CAST(p_size AS STRING) AS class, 'm' || CAST(p_partkey AS STRING) AS caller, 'm' || CAST(p_partkey + p_size AS STRING) AS callee FROM part")
# Packages of fifteen parts, so that their number grows with the input. Imports lead to about half the number or less, now and then to the double: chains and cycles.
_add("package_file", "part", "SELECT 'r' || CAST(p_partkey % 3 AS STRING) AS repo, 'f' || CAST(p_partkey AS STRING) AS file, 'k' || CAST(CAST(floor(p_partkey / 15) AS BIGINT) AS STRING) AS package, 'src/k' || CAST(CAST(floor(p_partkey / 15) AS BIGINT) AS STRING) AS dir FROM part")
_add(
    "package_import",
    "lineitem",
    """SELECT 'r' || CAST(l_partkey % 3 AS STRING) AS repo, 'f' || CAST(l_partkey AS STRING) AS file, CASE l_linenumber % 3 WHEN 0 THEN 'src/k' WHEN 1 THEN 'k' ELSE 'example.org/mod/src/k' END
    || CAST(CASE WHEN l_partkey % 50 = 0 THEN 2 * CAST(floor(l_partkey / 15) AS BIGINT) ELSE CAST(floor(floor(l_partkey / 15) / (2 + l_suppkey % 3)) AS BIGINT) END AS STRING) AS target FROM lineitem""",
)
_add("module_path", "", "SELECT r AS repo, m AS module FROM (VALUES ('r0', 'example.org'), ('r0', 'example.org/mod'), ('r1', 'example.org/mod')) t(r, m)")
_add("method_decl", "part", "SELECT 'f' || CAST(p_partkey % 50 AS STRING) AS file, 'C' || CAST(p_partkey % 5 AS STRING) || '.m' || CAST(p_size % 20 AS STRING) AS name, 'n' || CAST(p_partkey AS STRING) AS node FROM part")
_add("call_site", "lineitem", "SELECT DISTINCT 'f' || CAST(l_partkey % 50 AS STRING) AS file, 'n' || CAST(l_partkey AS STRING) AS caller, 'm' || CAST(l_suppkey % 20 AS STRING) AS callee, CASE WHEN l_linenumber % 2 = 0 THEN 'C' || CAST(l_partkey % 5 AS STRING) END AS enclosing FROM lineitem")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation or an input table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, needs = FIXTURES[name]
    frames = {n: fixture(spark, sf_dir, n) for n in needs}
    for n in needs:  # the SQL names relations plainly; Spark takes DataFrames in braces
        sql = sql.replace(f"FROM {n})", f"FROM {{{n}}})").replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"FROM {n}\n", f"FROM {{{n}}}\n")
        if sql.endswith(f"FROM {n}"):
            sql = f"{sql.removesuffix(n)}{{{n}}}"
    return spark.sql(sql, **frames)


def with_fixtures(names: str, body: str) -> str:
    """DuckDB SQL: body after the fixtures that it names."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in FIXTURES and name not in done:
            for n in FIXTURES[name][1]:
                need(n)
            done.append(name)

    for name in names.split():
        need(name)
    parts = [f'"{n}" AS ({FIXTURES[n][0]})' for n in done]
    lead = body.lstrip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*parts, lead[15:]])}"
    if lead.upper().startswith("WITH "):
        return f"WITH {', '.join([*parts, lead[5:]])}"
    return f"WITH {', '.join(parts)} {lead}" if parts else lead
