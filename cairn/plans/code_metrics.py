"""Queries of code metrics and their composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import code_metrics as K
from cairn.plans.catalog import query
from cairn.plans.relational import rounded

TABLE = ", ".join(f"('{d}', {c}, {g}, {str(b).lower()}, {str(p).lower()})" for d, c, g, b, p in S.DECISIONS)
WALK = f"""WITH RECURSIVE t AS (SELECT * FROM (VALUES {TABLE}) v(decision, cyclo, cognitive, bonus, pushes)),
up AS (SELECT scope_id AS block, parent_scope_id AS top, 0 AS nesting FROM ast_scope WHERE kind = 'block'
  UNION ALL SELECT u.block, a.parent_scope_id, u.nesting + CASE WHEN t.pushes THEN 1 ELSE 0 END FROM up u JOIN ast_scope a ON a.scope_id = u.top AND a.kind = 'block' LEFT JOIN t ON t.decision = a.decision),
w AS (SELECT u.top AS scope_id, sum(t.cyclo) AS cyclo, sum(t.cognitive + CASE WHEN t.bonus THEN u.nesting ELSE 0 END) AS cognitive FROM up u JOIN ast_scope m ON m.scope_id = u.top AND m.kind = 'method' JOIN ast_scope b ON b.scope_id = u.block JOIN t ON t.decision = b.decision GROUP BY 1),
m AS (SELECT s.file, s.scope_id, CAST(1 + coalesce(w.cyclo, 0) AS BIGINT) AS cyclo, CAST(coalesce(w.cognitive, 0) AS BIGINT) AS cognitive FROM ast_scope s LEFT JOIN w USING (scope_id) WHERE s.kind = 'method'),
f AS (SELECT s.scope_id, CAST(coalesce(sum(m.cyclo), 0) AS BIGINT) AS cyclo, CAST(coalesce(sum(m.cognitive), 0) AS BIGINT) AS cognitive FROM ast_scope s LEFT JOIN m ON m.file = s.file WHERE s.kind = 'file' GROUP BY 1)"""


@query("met_01_02_complexity", "ast_scope", f"{WALK} SELECT scope_id, 'method' AS kind, cyclo, cognitive FROM m UNION ALL SELECT scope_id, 'file', cyclo, cognitive FROM f")
def complexity(scopes):
    return K.complexity(scopes)


@query("met_03_loc", "ast_scope", "SELECT scope_id, end_line - greatest(start_line, 1) + 1 AS loc FROM ast_scope WHERE kind = 'file' AND end_line > 0 AND end_line >= greatest(start_line, 1)")
def loc(scopes):
    return K.loc(scopes)


@query(
    "met_04_lcom4",
    "class_member field_use member_call",
    """WITH RECURSIVE e AS (SELECT a.class, a.method AS x, b.method AS y FROM field_use a JOIN field_use b ON a.class = b.class AND a.field = b.field
      UNION SELECT c.class, caller, callee FROM member_call c JOIN class_member m ON m.class = c.class AND m.method = c.callee UNION SELECT c.class, callee, caller FROM member_call c JOIN class_member m ON m.class = c.class AND m.method = c.callee),
    r AS (SELECT class, method AS x, method AS y FROM class_member UNION SELECT r.class, r.x, e.y FROM r JOIN e ON e.class = r.class AND e.x = r.y)
    SELECT class, count(DISTINCT root) AS lcom4 FROM (SELECT class, x, min(y) AS root FROM r GROUP BY ALL) GROUP BY 1""",
)
def lcom4(members, uses, calls):
    return K.lcom4(members, uses, calls)


def _fan_sql(near: str, far: str) -> str:
    return f"""WITH RECURSIVE up AS (SELECT scope_id, scope_id AS top FROM ast_scope UNION ALL SELECT u.scope_id, a.parent_scope_id FROM up u JOIN ast_scope a ON a.scope_id = u.top WHERE a.parent_scope_id IS NOT NULL),
    c AS (SELECT n.top AS scope_id, count(*) AS n FROM ast_call e JOIN up n ON n.scope_id = e.{near} WHERE NOT EXISTS (SELECT 1 FROM up f WHERE f.scope_id = e.{far} AND f.top = n.top) GROUP BY 1)
    SELECT s.scope_id, s.kind, coalesce(c.n, 0) AS n FROM ast_scope s LEFT JOIN c USING (scope_id) WHERE s.kind IN ('method', 'class', 'file')"""


@query("met_05_fan_in", "ast_scope ast_call", _fan_sql("to_scope", "from_scope"))
def fan_in(scopes, calls):
    return K.fan(scopes, calls, incoming=True)


@query("met_06_fan_out", "ast_scope ast_call", _fan_sql("from_scope", "to_scope"))
def fan_out(scopes, calls):
    return K.fan(scopes, calls, incoming=False)


IMPORTS = """p AS (SELECT DISTINCT repo, package, dir, package || '@' || dir AS ident FROM package_file),
w AS (SELECT DISTINCT i.repo, f.package || '@' || f.dir AS src, i.target FROM package_import i JOIN package_file f ON f.repo = i.repo AND f.file = i.file),
l AS (SELECT w.repo, w.src, coalesce((SELECT min(ident) FROM p WHERE p.repo = w.repo AND p.dir = w.target), (SELECT min(ident) FROM p WHERE p.repo = w.repo AND p.package = w.target HAVING count(*) = 1),
  (SELECT min(ident) FROM p WHERE p.repo = w.repo AND p.dir = substr(w.target, 2 + (SELECT max(length(m.module)) FROM module_path m WHERE m.repo = w.repo AND starts_with(w.target, m.module || '/'))))) AS dst FROM w),
i AS (SELECT DISTINCT repo, src, dst FROM l WHERE dst IS NOT NULL)"""


@query("met_07_package_imports", "package_file package_import module_path", f"WITH {IMPORTS} SELECT repo, src, dst FROM i")
def package_imports(files, imports, modules):
    return K.package_imports(files, imports, modules)


@query(
    "met_07_cycle_member",
    "package_file package_import module_path",
    f"""WITH RECURSIVE {IMPORTS}, r AS (SELECT repo, src, dst FROM i UNION SELECT r.repo, r.src, i.dst FROM r JOIN i ON i.repo = r.repo AND i.src = r.dst),
    s AS (SELECT a.repo, a.src AS package, 'scc:' || string_agg(DISTINCT a.dst, ',' ORDER BY a.dst) AS cycle_id FROM r a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)
    SELECT p.repo, p.ident AS package, CASE WHEN s.cycle_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS cycle_member, s.cycle_id FROM p LEFT JOIN s ON s.repo = p.repo AND s.package = p.ident""",
)
def cycle_member(files, imports, modules):
    packages = files.select("repo", F.concat_ws("@", "package", "dir").alias("package")).distinct()
    return K.cycle_members(packages, K.package_imports(files, imports, modules))


def _duplication_sql(keys: str) -> str:
    return rf"""WITH t AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^ \t\r\n]') AS x FROM documents),
    n AS (SELECT {keys}, CAST(sum(len(x)) AS BIGINT) AS tokens FROM t GROUP BY ALL),
    w AS (SELECT doc_id, lang, source, pos, md5(array_to_string(x[pos:pos + 49], chr(1))) AS h FROM t, range(1, greatest(len(x) - 48, 1)) r(pos) WHERE len(x) >= 50),
    d AS (SELECT {keys}, h FROM w GROUP BY ALL HAVING count(*) > 1), c AS (SELECT w.doc_id, w.lang, w.source, pos FROM w JOIN d ON {' AND '.join(f'd.{k.strip()} IS NOT DISTINCT FROM w.{k.strip()}' for k in keys.split(','))} AND d.h = w.h),
    g AS (SELECT *, least(50, coalesce(lead(pos) OVER (PARTITION BY doc_id, lang, source ORDER BY pos) - pos, 50)) AS reach FROM c),
    s AS (SELECT {keys}, CAST(sum(reach) AS BIGINT) AS covered FROM g GROUP BY ALL)
    SELECT {', '.join('n.' + k.strip() for k in keys.split(','))}, tokens, coalesce(covered, 0) AS covered, round(CASE WHEN tokens > 0 THEN coalesce(covered, 0) / tokens ELSE 0 END, 6) AS duplication_ratio FROM n LEFT JOIN s ON {' AND '.join(f's.{k.strip()} IS NOT DISTINCT FROM n.{k.strip()}' for k in keys.split(','))}"""


@query("met_08_duplication_file", "documents", _duplication_sql("doc_id"))
def duplication_file(documents):
    return rounded(K.duplication(documents, ["doc_id"], file="doc_id"), "duplication_ratio")


@query("met_08_duplication_package", "documents", _duplication_sql("lang, source"))
def duplication_package(documents):
    return rounded(K.duplication(documents, ["lang", "source"], file="doc_id"), "duplication_ratio")


@query("met_14_registry", "ast_scope", f"{WALK.replace('FROM ast_scope', 'FROM (SELECT * FROM ast_scope WHERE degraded_reason IS NULL)').replace('JOIN ast_scope', 'JOIN (SELECT * FROM ast_scope WHERE degraded_reason IS NULL)')}, z AS (SELECT scope_id, cyclo, cognitive FROM m UNION ALL SELECT scope_id, cyclo, cognitive FROM f) SELECT 'cyclo' AS metric_kind, scope_id, cyclo::DOUBLE AS value FROM z UNION ALL SELECT 'cognitive_complexity', scope_id, cognitive::DOUBLE FROM z UNION ALL SELECT 'loc', scope_id, (end_line - greatest(start_line, 1) + 1)::DOUBLE FROM ast_scope WHERE degraded_reason IS NULL AND kind = 'file' AND end_line > 0 AND end_line >= greatest(start_line, 1)")
def registry(scopes):
    return K.run_recipes(scopes, ["cyclo", "cognitive_complexity", "loc"])


SYSTEM = "(SELECT repo_id, sha, scope_id, value, CASE seq % 3 WHEN 0 THEN 'package' ELSE 'file' END AS scope_kind, CASE metric_version WHEN 1 THEN 'cycle_member' WHEN 2 THEN 'fan_in' WHEN 3 THEN 'coupling_between_objects' ELSE metric_kind END AS metric_kind FROM metric_sample WHERE repo_id <> 'r3' OR metric_version <> 3)"


def _system(samples):
    return samples.selectExpr("repo_id", "sha", "scope_id", "value", "CASE seq % 3 WHEN 0 THEN 'package' ELSE 'file' END AS scope_kind", "CASE metric_version WHEN 1 THEN 'cycle_member' WHEN 2 THEN 'fan_in' WHEN 3 THEN 'coupling_between_objects' ELSE metric_kind END AS metric_kind", "metric_version").where("repo_id <> 'r3' OR metric_version <> 3").drop("metric_version")


@query("sys_02_arch_debt_ratio", "metric_sample", f"WITH s AS {SYSTEM}, c AS (SELECT * FROM s WHERE metric_kind = 'cycle_member'), a AS (SELECT repo_id, sha, count(*) AS total FROM c GROUP BY ALL), o AS (SELECT repo_id, sha, scope_id, count(*) AS n FROM c WHERE scope_kind = 'package' GROUP BY ALL) SELECT o.repo_id, o.sha, o.scope_id, round(o.n / a.total, 6) AS arch_debt_ratio FROM o JOIN a ON a.repo_id = o.repo_id AND a.sha = o.sha")
def debt_ratio(samples):
    return rounded(K.debt_ratio(_system(samples)), "arch_debt_ratio")


@query(
    "sys_04_arch_fitness",
    "metric_sample",
    f"""WITH s AS {SYSTEM}, g AS (SELECT repo_id, sha, count(*) FILTER (WHERE metric_kind = 'cycle_member') AS c, count(*) FILTER (WHERE metric_kind = 'fan_in') AS f, avg(value) FILTER (WHERE metric_kind = 'coupling_between_objects') AS m FROM s GROUP BY ALL)
    SELECT repo_id, sha, round(CASE WHEN c > 0 AND f > 0 AND m IS NOT NULL THEN least(1, greatest(0, 1 / (1 + c) - 0.5 * m / (1 + m))) END, 6) AS arch_fitness, NOT (c > 0 AND f > 0 AND m IS NOT NULL) AS degraded FROM g""",
)
def fitness(samples):
    return rounded(K.fitness(_system(samples)), "arch_fitness")


@query("sys_06_test_reliability", "metric_sample", "WITH r AS (SELECT DISTINCT repo_id, sha FROM metric_sample), v AS (SELECT repo_id, sha, max(value) / 50 AS value FROM metric_sample WHERE metric_version = 7 GROUP BY ALL) SELECT r.repo_id, r.sha, round(v.value, 6) AS xservice_test_reliability, v.value IS NULL AS degraded FROM r LEFT JOIN v ON r.repo_id = v.repo_id AND r.sha = v.sha")
def reliability(samples):
    ratios = samples.where("metric_version = 7").groupBy("repo_id", "sha").agg((F.max("value") / 50).alias("value"))
    return rounded(K.passthrough(samples.select("repo_id", "sha").distinct(), ratios), "xservice_test_reliability")


@query(
    "met_09_structural_duplication",
    "ast_scope",
    """WITH s AS (SELECT 'q' || CAST(CAST(substr(scope_id, 2) AS BIGINT) // 500 AS STRING) AS file, kind, CASE WHEN CAST(substr(scope_id, 2) AS BIGINT) % 500 < 300 THEN '' ELSE coalesce(decision, '') END AS name, CAST(substr(scope_id, 2) AS BIGINT) AS line FROM ast_scope),
    t AS (SELECT file, coalesce(list(kind || ':' || name ORDER BY line) FILTER (WHERE kind <> 'file'), []) AS x FROM s GROUP BY 1),
    w AS (SELECT file, pos, md5(array_to_string(x[pos:pos + 49], chr(1))) AS h FROM t, range(1, greatest(len(x) - 48, 1)) r(pos) WHERE len(x) >= 50),
    d AS (SELECT file, h FROM w GROUP BY ALL HAVING count(*) > 1), c AS (SELECT w.file, pos FROM w JOIN d USING (file, h)),
    g AS (SELECT *, least(50, coalesce(lead(pos) OVER (PARTITION BY file ORDER BY pos) - pos, 50)) AS reach FROM c), u AS (SELECT file, sum(reach) AS covered FROM g GROUP BY 1)
    SELECT t.file, CAST(len(x) AS BIGINT) AS tokens, CAST(coalesce(covered, 0) AS BIGINT) AS covered, round(CASE WHEN len(x) > 0 THEN coalesce(covered, 0) / len(x) ELSE 0 END, 6) AS duplication_ratio FROM t LEFT JOIN u USING (file)""",
)
def structural_duplication(scopes):
    """Trees without text: files of five hundred scopes, whose blocks have a name in the second part only."""
    number = F.expr("CAST(substr(scope_id, 2) AS BIGINT)")
    rows = scopes.select(F.concat(F.lit("q"), F.expr("CAST(substr(scope_id, 2) AS BIGINT) div 500")).alias("file"), "kind", F.when(number % 500 < 300, "").otherwise(F.coalesce("decision", F.lit(""))).alias("name"), F.lit(None).cast("string").alias("qualified_name"), number.alias("start_line"), F.lit(0).alias("start_byte"))
    return rounded(K.duplicated_tokens(K.structural_tokens(rows), "tokens"), "duplication_ratio")


@query("fn_24_decisions_of_scopes", "ast_scope", f"SELECT scope_id, decision, coalesce(cyclo, 0) AS cyclo, coalesce(cognitive, 0) AS cognitive, coalesce(bonus, false) AS bonus, coalesce(pushes, false) AS pushes FROM ast_scope LEFT JOIN (VALUES {TABLE}) v(decision, cyclo, cognitive, bonus, pushes) USING (decision)")
def decisions_of_scopes(scopes):
    """What each scope's decision counts for; scopes without one count for nothing."""
    found = scopes.select("scope_id", "decision").join(F.broadcast(K.decisions(scopes)), "decision", "left")
    return found.fillna({"cyclo": 0, "cognitive": 0, "bonus": False, "pushes": False}).select("scope_id", "decision", "cyclo", "cognitive", "bonus", "pushes")
