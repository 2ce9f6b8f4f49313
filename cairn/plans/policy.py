"""Queries of the policy side: predicates, findings, gates, hot spots, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import common as C
from cairn.operators import policy as P
from cairn.operators import predicate_text as T
from cairn.operators import stats as A
from cairn.plans.catalog import query
from cairn.plans.relational import GLOB_SQL, rounded

HIGH, WIDE = "5d1c3b52-0d5e-4c8e-9a51-3f6f6e0b1a01", "5d1c3b52-0d5e-4c8e-9a51-3f6f6e0b1a02"
THRESHOLDS = ((HIGH, "cyclo", "method", "gt", 45.0), (WIDE, "fan_out", "method", "ge", 48.0))
POLICY = (
    ("solid.srp.size", "value > 49", "block"),
    ("solid.isp.width", "metric_kind == 'fan_out' AND value > 30 AND NOT degraded == true", "warn"),
    ("decoupling.cycles", f"threshold('{HIGH}') AND threshold('{WIDE}')", "block"),
    ("decoupling.duplication", "pack == 'ingested' OR NOT value < 40", "info"),
)
RULES = tuple(P.Rule(rule_id, T.predicate(text, {key: tuple(row) for key, *row in THRESHOLDS}), severity) for rule_id, text, severity in POLICY)
# The same rules over a scope's samples, written out by hand.
RULES_SQL = """g AS (SELECT repo_id, sha, scope_id, bool_or(coalesce(value > 49, false)) AS r1,
  bool_or(metric_kind = 'fan_out' AND coalesce(value > 30, false) AND NOT degraded) AS r2,
  bool_or(metric_kind = 'cyclo' AND scope_kind = 'method' AND coalesce(value > 45, false)) AND bool_or(metric_kind = 'fan_out' AND scope_kind = 'method' AND coalesce(value >= 48, false)) AS r3,
  bool_or(pack = 'ingested') OR NOT bool_or(coalesce(value < 40, false)) AS r4, bool_or(pack = 'ingested') AS r4a FROM metric_sample GROUP BY ALL),
fired AS (SELECT repo_id, sha, scope_id, 'solid.srp.size' AS rule_id, 'block' AS severity FROM g WHERE r1 UNION ALL SELECT repo_id, sha, scope_id, 'solid.isp.width', 'warn' FROM g WHERE r2
  UNION ALL SELECT repo_id, sha, scope_id, 'decoupling.cycles', 'block' FROM g WHERE r3 UNION ALL SELECT repo_id, sha, scope_id, 'decoupling.duplication', 'info' FROM g WHERE r4)"""
FIRST = "(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY created_at DESC, seq DESC) AS rn FROM finding WHERE {1})"


@query(
    "dsl_01_texts",
    "metric_sample",
    """SELECT sample_id, coalesce(value > 5, false) OR pack = 'base' AND NOT degraded AS by_rank, (coalesce(value > 5, false) OR pack = 'base') AND NOT degraded AS by_parentheses,
    NOT coalesce(value >= 10 AND value < 20.5, false) AS outside, coalesce(pack = source, false) AS fields, coalesce(value > -3, false) AS mirrored, true AS constant FROM metric_sample""",
)
def texts(samples):
    """Texts as columns: rank of operators, parentheses, comments, two fields, a literal on the left, constants."""
    said = {
        "by_rank": "value > 5 OR pack == 'base' AND NOT degraded == true",
        "by_parentheses": "(value > 5 or pack == 'base') and degraded == false # in any case",
        "outside": "NOT (value >= 10 AND value < 20.5)",
        "fields": "pack == source",
        "mirrored": "-3 < value",
        "constant": "false OR 1 != 2",
    }
    return samples.select("sample_id", *[P.on_row(T.predicate(text)).alias(name) for name, text in said.items()])


#: Texts that are refused, with the kind and the place of the error.
REFUSED = (
    ("value = 5", "lex", 1, 7),
    ("value > 5 value", "parse", 1, 11),
    ("loc > 5", "semantic", 1, 1),
    ("true AND\n metric_kind == 'cyclomatic'", "semantic", 2, 17),
    ("pack < 'base'", "type", 1, 6),
    ("value == 'base'", "type", 1, 7),
    ("threshold('none')", "bind", 1, 11),
    (f"threshold('{HIGH}')", "bind", 1, 11),
)


@query("dsl_02_refused", "region", f"SELECT * FROM (VALUES {', '.join(f"({n}, '{kind}', {line}, {column})" for n, (_, kind, line, column) in enumerate(REFUSED))}) t(n, kind, line, col)")
def refused(region):
    """What reading says of texts that are wrong: one row a text."""
    rows = []
    for n, (text, *_) in enumerate(REFUSED):
        try:
            T.predicate(text)
        except T.PredicateError as e:
            rows.append((n, e.kind, e.line, e.column))
    return region.sparkSession.createDataFrame(rows, "n int, kind string, line int, col int")


@query(
    "dsl_02_faults_of_texts",
    "part",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lex' WHEN 1 THEN 'parse' WHEN 2 THEN 'semantic' WHEN 3 THEN 'type' END AS kind, CASE WHEN p_partkey % 5 < 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END END AS line,
    p_size + CASE p_partkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 11 WHEN 2 THEN 1 WHEN 3 THEN 6 END AS col FROM part""",
)
def faults_of_texts(part):
    """Rule texts of a table, four of five wrong, at places that follow from the row."""
    said = F.array(*map(F.lit, ("value = 5", "value > 5 value", "loc > 5", "pack < 'base'", "value > 5")))
    lead = F.concat(F.when(F.col("p_partkey") % 2 == 0, "\n").otherwise(""), F.repeat(F.lit(" "), F.col("p_size")))
    rules = part.select("p_partkey", F.concat(lead, F.element_at(said, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("text"))
    return T.faults(rules).select("p_partkey", "fault.kind", "fault.line", "fault.col")


@query("dsl_03_bound_rules", "metric_sample", f"WITH {RULES_SQL} SELECT repo_id, sha, scope_id, rule_id, severity FROM fired")
def bound_rules(samples):
    """Rules and thresholds of a policy from tables."""
    make = samples.sparkSession.createDataFrame
    rules = make(list(POLICY), "rule_id string, predicate string, severity string")
    thresholds = make(list(THRESHOLDS), "threshold_id string, metric_kind string, scope_kind string, op string, value double")
    return P.evaluate(samples, T.read_rules(rules, thresholds))[0]


@query("dsl_04_row_predicate", "metric_sample", "SELECT sample_id, NOT (coalesce(value > 5, false)) AS not_large, coalesce(value > 5, false) AND pack = 'base' OR source <> 'computed' AS mixed FROM metric_sample")
def row_predicate(samples):
    large = P.Compare("value", ">", 5.0)
    mixed = P.Some((P.Every((large, P.Compare("pack", "==", "base"))), P.Compare("source", "!=", "computed")))
    return samples.select("sample_id", P.on_row(P.Negate(large)).alias("not_large"), P.on_row(mixed).alias("mixed"))


@query("dsl_05_scope_predicate", "metric_sample", f"WITH {RULES_SQL} SELECT repo_id, sha, scope_id, rule_id, severity FROM fired")
def scope_predicate(samples):
    return P.evaluate(samples, RULES)[0]


@query(
    "dsl_05_witnesses",
    "metric_sample",
    f"""WITH {RULES_SQL}, s AS (SELECT m.*, r3, r4a, r2 FROM metric_sample m JOIN g USING (repo_id, sha, scope_id))
    SELECT repo_id, sha, scope_id, 'solid.srp.size' AS rule_id, sample_id FROM s WHERE value > 49
    UNION ALL SELECT repo_id, sha, scope_id, 'solid.isp.width', min(sample_id) FROM s WHERE metric_kind = 'fan_out' AND value > 30 AND NOT degraded GROUP BY ALL
    UNION ALL SELECT repo_id, sha, scope_id, 'decoupling.cycles', sample_id FROM s WHERE r3 AND (metric_kind = 'cyclo' AND scope_kind = 'method' AND value > 45 OR metric_kind = 'fan_out' AND scope_kind = 'method' AND value >= 48)
    UNION ALL SELECT repo_id, sha, scope_id, 'decoupling.duplication', sample_id FROM s WHERE pack = 'ingested'""",
)
def witnesses(samples):
    return P.evaluate(samples, RULES)[1]


@query("rul_02_unmuted", "finding override", f"{GLOB_SQL} SELECT f.finding_id FROM finding f LEFT JOIN m ON m.rn = 1 AND m.rule_id = f.rule_id AND m.repo_id = f.repo_id AND m.scope_id = f.scope_id WHERE coalesce(NOT m.mute, true)")
def unmuted(findings, overrides):
    return P.unmuted(findings, overrides).select("finding_id")


@query(
    "rul_03_delta",
    "finding",
    f"""WITH c AS (SELECT scope_id, rule_id, severity FROM {FIRST.format('scope_id, rule_id', "sha = 's1998'")} WHERE rn = 1), p AS (SELECT scope_id, rule_id, severity AS sev, delta AS d FROM {FIRST.format('scope_id, rule_id', "sha = 's1997'")} WHERE rn = 1)
    SELECT scope_id, rule_id, severity, CASE WHEN sev IS NULL THEN 'new' WHEN sev = 'block' AND d <> 'resolved' AND severity = 'block' THEN 'unchanged' WHEN severity = 'block' THEN 'newly_failing' ELSE 'new' END AS delta FROM c LEFT JOIN p USING (scope_id, rule_id)""",
)
def delta(findings):
    at = lambda sha: C.latest(findings.where(F.col("sha") == sha), ["scope_id", "rule_id"], ["created_at", "seq"])
    return P.deltas(at("s1998").select("scope_id", "rule_id", "severity"), at("s1997"))


@query(
    "rul_04_resolved",
    "finding",
    f"""WITH c AS (SELECT scope_id, rule_id, severity FROM {FIRST.format('scope_id, rule_id', "sha = 's1998'")} WHERE rn = 1), p AS (SELECT scope_id, rule_id, severity AS sev, delta AS d FROM {FIRST.format('scope_id, rule_id', "sha = 's1997'")} WHERE rn = 1)
    SELECT scope_id, rule_id, 'info' AS severity, 'resolved' AS delta FROM p WHERE sev = 'block' AND d <> 'resolved' AND NOT EXISTS (SELECT 1 FROM c WHERE c.scope_id = p.scope_id AND c.rule_id = p.rule_id AND c.severity = 'block')""",
)
def resolved(findings):
    at = lambda sha: C.latest(findings.where(F.col("sha") == sha), ["scope_id", "rule_id"], ["created_at", "seq"])
    return P.resolved(at("s1998").select("scope_id", "rule_id", "severity"), at("s1997"))


VERDICT = "coalesce(['pass', 'warn', 'block'][1 + max(CASE WHEN delta <> 'resolved' THEN CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END END)], 'pass')"


@query("agg_15_verdict", "finding", f"SELECT repo_id, sha, {VERDICT} AS verdict FROM finding GROUP BY ALL")
def verdict(findings):
    return P.verdict(findings, ["repo_id", "sha"])


@query("rul_06_canonical_run", "commit", "SELECT repo_id, sha, policy, caller, scope, run_id FROM (SELECT *, row_number() OVER (PARTITION BY policy, caller, scope, repo_id, sha ORDER BY created_at DESC, run_id DESC) AS rn FROM (SELECT repo_id, 's' || CAST(rn % 3 AS STRING) AS sha, 'p' AS policy, 'c' || CAST(rn % 2 AS STRING) AS caller, CASE WHEN rn % 5 = 0 THEN 'x' END AS scope, sha AS run_id, committed_at AS created_at, scan_status = 'failed' AS degraded FROM commit) WHERE NOT degraded AND created_at >= TIMESTAMP '2024-01-11 00:00:00') WHERE rn = 1")
def canonical_run(commits):
    runs = commits.selectExpr("repo_id", "'s' || CAST(rn % 3 AS STRING) AS sha", "'p' AS policy", "'c' || CAST(rn % 2 AS STRING) AS caller", "CASE WHEN rn % 5 = 0 THEN 'x' END AS scope", "sha AS run_id", "committed_at AS created_at", "scan_status = 'failed' AS degraded")
    return P.canonical_run(runs, F.lit("2024-01-31 00:00:00"), 20 * 86400).select("repo_id", "sha", "policy", "caller", "scope", "run_id")


@query("rul_07_catch_up", "commit", "SELECT repo_id, sha FROM commit WHERE scan_status = 'scanned' AND rn % 3 <> 0 ")
def catch_up(commits):
    return P.catch_up(commits, commits.select("repo_id", "sha", (F.col("rn") % 3 != 0).alias("degraded"))).select("repo_id", "sha")


@query("rul_08_active_policy", "override", "SELECT rule_id, override_id AS policy_version FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY created_rank DESC, override_id DESC) AS rn FROM override) WHERE rn = 1")
def active_policy(activations):
    return C.latest(activations, ["rule_id"], ["created_rank", "override_id"]).select("rule_id", F.col("override_id").alias("policy_version"))


@query(
    "rul_09_gate",
    "finding",
    f"""WITH v AS (SELECT repo_id, sha, {VERDICT} AS verdict FROM finding GROUP BY ALL), q AS (SELECT repo_id, sha, repo_id <> 'r7' AS signature_ok, CASE WHEN sha < 's1995' THEN 'scanning' ELSE 'scanned' END AS scan_status FROM v UNION ALL SELECT 'none', 's1', true, 'scanned')
    SELECT q.repo_id, q.sha, CASE WHEN NOT signature_ok OR scan_status <> 'scanned' THEN 'warn' ELSE coalesce(verdict, 'pass') END AS verdict, NOT signature_ok OR scan_status <> 'scanned' AS degraded,
    CASE WHEN NOT signature_ok THEN 'policy_signature_invalid' WHEN scan_status <> 'scanned' THEN 'samples_pending' END AS reason FROM q LEFT JOIN v ON q.repo_id = v.repo_id AND q.sha = v.sha""",
)
def gate(findings):
    verdicts = P.verdict(findings, ["repo_id", "sha"])
    asked = verdicts.selectExpr("repo_id", "sha", "repo_id <> 'r7' AS signature_ok", "CASE WHEN sha < 's1995' THEN 'scanning' ELSE 'scanned' END AS scan_status")
    extra = asked.sparkSession.createDataFrame([("none", "s1", True, "scanned")], "repo_id string, sha string, signature_ok boolean, scan_status string")
    return P.gate(asked.union(extra), verdicts)


def _z(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 WHEN mad_{c} > 0 THEN ({c} - med_{c}) / (1.4826 * mad_{c}) WHEN sd_{c} > 0 THEN ({c} - mean_{c}) / sd_{c} ELSE 0 END"


DIMS = ("complexity", "churn", "coupling")
HOT_SQL = f"""d AS (SELECT scope_id, CASE WHEN cyclo IS NULL AND cognitive_complexity IS NULL THEN NULL ELSE coalesce(cyclo, 0) + coalesce(cognitive_complexity, 0) END AS complexity, modification_count AS churn,
  CASE WHEN coupling IS NULL AND fan_out IS NULL THEN NULL ELSE coalesce(coupling, 0) + coalesce(fan_out, 0) END AS coupling FROM scope_inputs),
c AS (SELECT scope_id, count(*) AS finding_count FROM finding WHERE delta IN ('new', 'newly_failing') GROUP BY scope_id),
r AS (SELECT coalesce(d.scope_id, c.scope_id) AS scope_id, complexity, churn, coupling, coalesce(finding_count, 0) AS finding_count FROM d FULL JOIN c ON d.scope_id = c.scope_id),
m AS (SELECT {', '.join(f'median({x}) AS med_{x}, avg({x}) AS mean_{x}, stddev_pop({x}) AS sd_{x}' for x in DIMS)} FROM r),
s AS (SELECT {', '.join(f'median(abs({x} - med_{x})) AS mad_{x}' for x in DIMS)} FROM r, m),
hot AS (SELECT scope_id, finding_count, {_z('complexity')} + 0.5 * ({_z('churn')}) + 0.25 * ({_z('coupling')}) + 0.1 * finding_count AS score FROM r, m, s)"""
WEIGHTS = (1.0, 0.5, 0.25, 0.1)


def _hot(inputs, findings):
    counts = findings.where(F.col("delta").isin(*P.QUALIFYING)).groupBy("scope_id").agg(F.count("*").alias("finding_count"))
    return P.hot_spots(inputs, counts, weights=WEIGHTS)


@query("hot_02_scores", "scope_inputs finding", f"WITH {HOT_SQL} SELECT scope_id, finding_count, round(score, 6) AS score FROM hot")
def hot_scores(inputs, findings):
    return rounded(_hot(inputs, findings).select("scope_id", "finding_count", "score"), "score")


@query("hot_01_pivot", "metric_sample", "SELECT scope_id, max(value) FILTER (WHERE metric_kind = 'cyclo') AS cyclo, max(value) FILTER (WHERE metric_kind = 'fan_out') AS fan_out, max(value) FILTER (WHERE metric_kind = 'modification_count_in_window') AS modification_count_in_window FROM metric_sample GROUP BY scope_id")
def pivot(samples):
    return samples.groupBy("scope_id").pivot("metric_kind", ["cyclo", "fan_out", "modification_count_in_window"]).agg(F.max("value"))


@query("hot_03_outer_union", "scope_inputs finding", "SELECT coalesce(i.scope_id, f.scope_id) AS scope_id, i.scope_id IS NOT NULL AS measured, coalesce(n, 0) AS n FROM scope_inputs i FULL JOIN (SELECT scope_id, count(*) AS n FROM finding GROUP BY scope_id) f ON i.scope_id = f.scope_id")
def outer_union(inputs, findings):
    counts = findings.groupBy("scope_id").agg(F.count("*").alias("n"))
    return inputs.select("scope_id", F.lit(True).alias("measured")).join(counts, "scope_id", "full_outer").fillna({"measured": False, "n": 0})


@query("top_01_hot_spots", "scope_inputs finding", f"WITH {HOT_SQL} SELECT scope_id, round(score, 6) AS score FROM hot ORDER BY round(score, 6) DESC, scope_id LIMIT 25")
def top_spots(inputs, findings):
    spots = rounded(_hot(inputs, findings), "score").withColumn("created_at", F.lit("2024-01-01"))
    return P.top_hot_spots(spots, 25).select("scope_id", "score")


HOURS = "CASE kind WHEN 'split_class' THEN 8 WHEN 'extract_method' THEN 2 WHEN 'invert_dependency' THEN 4 WHEN 'break_cycle' THEN 6 WHEN 'consolidate_duplication' THEN 3 ELSE 1 END"


@query(
    "pln_01_tasks",
    "scope_inputs finding",
    f"""WITH {HOT_SQL}, t AS (SELECT scope_id, round(score, 6) AS score FROM hot ORDER BY round(score, 6) DESC, scope_id LIMIT 40),
    k AS (SELECT t.scope_id, t.score, f.rule_id, CASE WHEN f.rule_id LIKE 'solid.%' THEN 'split_class' WHEN f.rule_id = 'decoupling.cycles' THEN 'break_cycle' ELSE 'consolidate_duplication' END AS kind FROM t JOIN (SELECT DISTINCT scope_id, rule_id FROM finding WHERE delta IN ('new', 'newly_failing')) f USING (scope_id))
    SELECT scope_id, rule_id, kind, round(least(40, ({HOURS}) * (1 + least(10, greatest(0, score)))), 5) AS hours FROM k""",
)
def tasks(inputs, findings):
    spots = rounded(_hot(inputs, findings), "score").withColumn("created_at", F.lit("2024-01-01"))
    return rounded(P.plan_tasks(P.top_hot_spots(spots, 40), findings).select("scope_id", "rule_id", "kind", "hours"), "hours", digits=5)


@query(
    "agg_10_robust_z",
    "lineitem",
    "WITH m AS (SELECT l_returnflag, median(l_quantity) AS med, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag, median(abs(l_quantity - med)) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN mad > 0 THEN (l_quantity - med) / (1.4826 * mad) WHEN sd > 0 THEN (l_quantity - mean) / sd ELSE 0 END, 6) AS z FROM lineitem JOIN m USING (l_returnflag) JOIN d USING (l_returnflag)",
)
def robust_z(lineitem):
    z = A.robust_z(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"), ["l_returnflag"], ["l_quantity"])
    return z.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity_z", 6).alias("z"))


@query("fn_15_16_polarity", "episode", "SELECT repo_id, count(*) FILTER (WHERE kind = 'synthetic_positive' OR outcome = 'success') AS pos, count(*) FILTER (WHERE NOT (kind = 'synthetic_positive' OR outcome = 'success') AND outcome IN ('failure', 'refused', 'degraded', 'human_corrected')) AS neg, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE kind = 'synthetic_positive' OR outcome = 'success')::DOUBLE / count(*) ELSE 0.5 END, 6) AS confidence, CASE WHEN count(*) FILTER (WHERE kind = 'synthetic_positive' OR outcome = 'success')::DOUBLE / count(*) < 0.3 THEN 'low' WHEN count(*) FILTER (WHERE kind = 'synthetic_positive' OR outcome = 'success')::DOUBLE / count(*) < 0.7 THEN 'medium' ELSE 'high' END AS band FROM episode GROUP BY repo_id")
def polarity(episodes):
    side = S.polarity("kind", "outcome")
    counts = episodes.groupBy("repo_id").agg(F.count(F.when(side == "positive", 1)).alias("pos"), F.count(F.when(side == "negative", 1)).alias("neg"))
    share = S.confidence("pos", "neg")
    return counts.select("repo_id", "pos", "neg", F.round(share, 6).alias("confidence"), S.band(share).alias("band"))
