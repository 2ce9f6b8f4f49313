"""Queries of the code graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators.common import cut, shared_dir
from cairn.plans.catalog import query
from cairn.sources import linked

CALLS = "('static_calls', 'observed_calls')"
LIVE = "(SELECT e.* FROM edge e WHERE NOT EXISTS (SELECT 1 FROM edge_retirement r WHERE r.edge_id = e.edge_id))"


def _links(edges):
    return edges.where(F.col("kind").isin(*G.CALLS)).select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"))


@query("gr_01_node_history", "node node_retirement", "SELECT n.node_id, n.kind, r.retired_at_sha FROM node n LEFT JOIN node_retirement r USING (node_id)")
def node_history(nodes, retired):
    return G.with_retirement(nodes, retired, "node_id", True).select("node_id", "kind", "retired_at_sha")


@query("gr_02_list_edges", "edge edge_retirement", f"SELECT edge_id, kind FROM {LIVE} e WHERE dst_node_id = 'n17' OR src_node_id = 'n17' AND kind IN {CALLS}")
def list_edges(edges, retired):
    live = G.with_retirement(edges, retired, "edge_id", False)
    return G.edges_of(live, "n17", G.CALLS).unionByName(G.edges_of(live, "n17", incoming=True)).select("edge_id", "kind").distinct()


@query("gr_03_list_nodes", "node node_retirement", "SELECT node_id, canonical_signature FROM node n WHERE repo_id = 'Brand#23' AND kind = 'method' AND NOT EXISTS (SELECT 1 FROM node_retirement r WHERE r.node_id = n.node_id)")
def list_nodes(nodes, retired):
    return G.with_retirement(nodes, retired, "node_id", False).where("repo_id = 'Brand#23' AND kind = 'method'").select("node_id", "canonical_signature")


@query("gr_04_card", "node edge edge_retirement trace_observation", f"SELECT n.node_id, n.kind, e.edge_id, e.kind AS edge_kind, e.dst_node_id, d.kind AS dst_kind, CASE WHEN e.edge_id IS NOT NULL THEN coalesce(t.observation_count, 0) END AS observation_count FROM node n LEFT JOIN {LIVE} e ON e.src_node_id = n.node_id LEFT JOIN node d ON d.node_id = e.dst_node_id LEFT JOIN trace_observation t ON t.edge_id = e.edge_id")
def card(nodes, edges, retired, observations):
    return G.card(nodes, G.with_retirement(edges, retired, "edge_id", False), observations)


@query(
    "gr_05_seed_expansion",
    "edge",
    f"WITH h AS (SELECT 'n' || CAST(i AS STRING) AS node_id, 0 AS hop FROM range(1, 30) t(i)), a AS (SELECT DISTINCT dst_node_id AS node_id, 1 AS hop FROM edge WHERE kind IN {CALLS} AND src_node_id IN (SELECT node_id FROM h)), b AS (SELECT DISTINCT dst_node_id AS node_id, 2 AS hop FROM edge WHERE kind IN {CALLS} AND src_node_id IN (SELECT node_id FROM a)) SELECT node_id, min(hop) AS hop FROM (SELECT * FROM h UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1",
)
def seed_expansion(edges):
    seeds = edges.sparkSession.range(1, 30).select(F.concat(F.lit("n"), "id").alias("node"))
    return G.reachable(_links(edges), seeds, 2).groupBy(F.col("node").alias("node_id")).agg(F.min("hop").alias("hop"))


@query("gr_06_expand_callees", "edge", f"SELECT edge_id, 1 AS hop FROM edge WHERE kind IN {CALLS} AND src_node_id = 'n11' UNION ALL SELECT edge_id, 2 FROM edge WHERE kind IN {CALLS} AND src_node_id <> 'n11' AND src_node_id IN (SELECT dst_node_id FROM edge WHERE kind IN {CALLS} AND src_node_id = 'n11')")
def expand_callees(edges):
    found, _, _ = G.expand(edges, ["n11"], 2, max_edges=4000, max_nodes=2000)
    return edges.sparkSession.createDataFrame([(e["edge_id"], e["hop"]) for e in found], "edge_id string, hop int")


@query("gr_07_ancestry", "commit", "WITH RECURSIVE a AS (SELECT repo_id || '/' || sha AS target, repo_id || '/' || sha AS id, repo_id || '/' || parent_sha AS up, 0 AS distance FROM commit UNION ALL SELECT a.target, a.up, c.repo_id || '/' || c.parent_sha, a.distance + 1 FROM a JOIN commit c ON a.up = c.repo_id || '/' || c.sha) SELECT target, id, distance FROM a")
def commit_ancestry(commits):
    rows = commits.select(F.concat_ws("/", "repo_id", "sha").alias("id"), F.when(F.col("parent_sha").isNotNull(), F.concat_ws("/", "repo_id", "parent_sha")).alias("parent"))
    return G.ancestry(rows, rows.select("id"))


TIME = """u AS (SELECT sha FROM sha_lineage WHERE sha <= 's1998'),
en AS (SELECT * FROM node n WHERE from_sha IN (SELECT sha FROM u) AND NOT EXISTS (SELECT 1 FROM node_retirement r WHERE r.node_id = n.node_id AND r.retired_at_sha <> 's1998' AND r.retired_at_sha IN (SELECT sha FROM u))),
ee AS (SELECT * FROM edge e WHERE from_sha IN (SELECT sha FROM u) AND NOT EXISTS (SELECT 1 FROM edge_retirement r WHERE r.edge_id = e.edge_id AND r.retired_at_sha <> 's1998' AND r.retired_at_sha IN (SELECT sha FROM u)))"""


@query("gr_08_time_travel", "node node_retirement edge edge_retirement sha_lineage", f"WITH {TIME} SELECT ee.edge_id, ee.src_node_id, ee.dst_node_id, en.kind FROM ee JOIN en ON en.node_id = ee.dst_node_id")
def time_travel(nodes, nodes_retired, edges, edges_retired, lineage):
    parents = lineage.select(F.col("sha").alias("id"), F.col("parent_sha").alias("parent"))
    above = G.ancestry(parents, parents.where("id = 's1998'").select("id"))
    seen = G.visible_at(nodes, nodes_retired, "node_id", above, "s1998").select(F.col("node_id").alias("dst_node_id"), F.col("kind").alias("dst_kind"))
    return G.visible_at(edges, edges_retired, "edge_id", above, "s1998").join(seen, "dst_node_id").select("edge_id", "src_node_id", "dst_node_id", F.col("dst_kind").alias("kind"))


@query("gr_09_current_neighbours", "edge edge_retirement node node_retirement", f"SELECT e.edge_id, e.src_node_id, n.node_id FROM {LIVE} e JOIN node n ON n.node_id = e.dst_node_id WHERE NOT EXISTS (SELECT 1 FROM node_retirement r WHERE r.node_id = n.node_id)")
def current_neighbours(edges, edges_retired, nodes, nodes_retired):
    live = G.with_retirement(nodes, nodes_retired, "node_id", False).select("node_id")
    rows = G.with_retirement(edges, edges_retired, "edge_id", False).select("edge_id", "src_node_id", F.col("dst_node_id").alias("node_id"))
    return rows.join(live, "node_id", "left_semi").select("edge_id", "src_node_id", "node_id")


@query("gr_10_descendants", "node", "WITH RECURSIVE d AS (SELECT node_id FROM node WHERE node_id = 'n100' UNION SELECT n.node_id FROM node n JOIN d ON n.parent_node_id = d.node_id) SELECT node_id FROM d")
def descendants(nodes):
    down = nodes.where("parent_node_id IS NOT NULL").select(F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"))
    return G.reachable(down, nodes.where("node_id = 'n100'").select(F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"))


@query(
    "gr_11_rename_pairs",
    "node",
    """WITH s AS (SELECT n.node_id, n.kind, p.canonical_signature AS ps, n.start_line FROM node n JOIN node p ON p.node_id = n.parent_node_id),
    o AS (SELECT ps, kind, min(node_id) AS old_node_id FROM s WHERE start_line % 5 = 0 GROUP BY ALL HAVING count(*) = 1), w AS (SELECT ps, kind, min(node_id) AS new_node_id FROM s WHERE start_line % 5 = 1 GROUP BY ALL HAVING count(*) = 1)
    SELECT ps AS parent_signature, kind, old_node_id, new_node_id FROM o JOIN w USING (ps, kind)""",
)
def rename_pairs(nodes):
    parents = nodes.select(F.col("node_id").alias("parent_node_id"), F.col("canonical_signature").alias("parent_signature"))
    signed = nodes.join(parents, "parent_node_id").select("node_id", "kind", "parent_signature", "start_line")
    return G.rename_pairs(signed.where("start_line % 5 = 0"), signed.where("start_line % 5 = 1"))


@query("gr_12_incident_retirements", "node_retirement edge edge_retirement", f"SELECT DISTINCT edge_id FROM {LIVE} e WHERE kind <> 'renamed_to' AND (src_node_id IN (SELECT node_id FROM node_retirement) OR dst_node_id IN (SELECT node_id FROM node_retirement))")
def incident(nodes, edges, retired):
    return G.incident_retirements(nodes, edges, retired)


@query("set_04_incident_union", "edge edge_retirement", f"SELECT DISTINCT edge_id FROM {LIVE} e WHERE src_node_id IN ('n5', 'n15', 'n25') OR dst_node_id IN ('n5', 'n15', 'n25')")
def incident_union(edges, retired):
    nodes = edges.sparkSession.createDataFrame([("n5",), ("n15",), ("n25",)], "node_id string")
    return G.incident_retirements(nodes, edges, retired)


@query(
    "gr_15_static_calls",
    "method_decl call_site",
    """WITH b AS (SELECT file, split_part(name, '.', -1) AS simple, min(node) AS node FROM method_decl GROUP BY ALL HAVING count(DISTINCT node) = 1), q AS (SELECT file, name, min(node) AS node FROM method_decl GROUP BY ALL HAVING count(DISTINCT node) = 1)
    SELECT DISTINCT 'static_calls' AS kind, caller AS src, node AS dst FROM call_site JOIN b ON b.file = call_site.file AND b.simple = callee WHERE enclosing IS NULL
    UNION SELECT DISTINCT 'static_calls', caller, node FROM call_site JOIN q ON q.file = call_site.file AND q.name = enclosing || '.' || callee WHERE enclosing IS NOT NULL""",
)
def static_calls(methods, calls):
    return G.call_edges(methods, calls)


@query("gr_14_imports", "package_import", "SELECT 'imports' AS kind, file AS src, 'package:' || target AS dst, count(*) AS n FROM (SELECT DISTINCT file, target, repo FROM package_import) GROUP BY file, target")
def imports(rows):
    edges = G.import_edges(rows.withColumnRenamed("repo", "symbol"))
    return edges.select("kind", "src", "dst", F.size("symbols").cast("long").alias("n"))


@query("gr_16_heritage", "method_decl call_site", "SELECT DISTINCT 'extends' AS kind, c.caller AS src, m.node AS dst FROM call_site c JOIN method_decl m ON m.file = c.file AND m.name = c.enclosing || '.' || c.callee")
def heritage(classes, calls):
    wanted = calls.where("enclosing IS NOT NULL").select("file", F.col("caller").alias("node"), F.lit("extends").alias("relation"), F.concat_ws(".", "enclosing", "callee").alias("target"))
    return G.heritage_edges(classes, wanted)


@query(
    "gr_17_reads_writes",
    "lineitem",
    """WITH a AS (SELECT 'n' || CAST(l_partkey % 100 AS STRING) AS method, 'c' || CAST(l_suppkey % 5 AS STRING) AS class, CASE WHEN l_linenumber % 2 = 0 THEN 'reads' ELSE 'writes' END AS direction, 'x' || CAST(l_quantity AS INTEGER) AS member, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY ALL)
    SELECT direction AS kind, method AS src, class AS dst, string_agg(member, ',' ORDER BY p, member) AS members FROM a GROUP BY ALL""",
)
def reads_writes(lineitem):
    rows = lineitem.selectExpr("'n' || CAST(l_partkey % 100 AS STRING) AS method", "'c' || CAST(l_suppkey % 5 AS STRING) AS class", "CASE WHEN l_linenumber % 2 = 0 THEN 'reads' ELSE 'writes' END AS direction", "'x' || CAST(l_quantity AS INTEGER) AS member", "l_orderkey * 10 + l_linenumber AS position")
    return G.access_edges(rows).withColumn("members", F.array_join("members", ","))


@query("gr_18_overrides", "node", "SELECT DISTINCT 'overrides' AS kind, a.node_id AS src, b.node_id AS dst FROM node a JOIN node b ON a.repo_id = b.repo_id AND split_part(a.canonical_signature, '.', 1) = split_part(b.canonical_signature, '.', 1) WHERE a.start_line % 2 = 0 AND b.start_line % 2 = 1")
def overrides(nodes):
    rows = nodes.select(F.col("repo_id").alias("file"), F.lit("T").alias("owner"), F.substring_index("canonical_signature", ".", 1).alias("simple"), F.col("node_id").alias("node"), F.when(F.expr("start_line % 2 = 0"), F.lit("T")).alias("trait"), F.expr("start_line % 2 = 1").alias("trait_default"))
    return G.override_edges(rows)


@query("gr_19_contains", "node", "SELECT 'contains' AS kind, parent_node_id AS src, node_id AS dst FROM node WHERE parent_node_id IS NOT NULL")
def contains(nodes):
    return G.contains_edges(nodes)


@query(
    "gr_19_method_blocks",
    "documents",
    r"""WITH b AS (SELECT doc_id AS node_id, regexp_replace(coalesce(text, ''), '[.] ', chr(10), 'g') AS body FROM documents),
    n AS (SELECT node_id, len(string_split(body, chr(10))) AS lines, len(list_filter(string_split(regexp_replace(body, '/\*[\s\S]*?(?:\*/|\z)|(?://|#)[^\n]*', '', 'g'), chr(10)), lambda x: trim(x) <> '')) AS logical FROM b)
    SELECT node_id, 0 AS ordinal, 'entry' AS kind, CAST(10 AS BIGINT) AS start_line, CAST(9 + greatest(1, lines // 2) AS BIGINT) AS end_line FROM n WHERE logical > 20
    UNION ALL SELECT node_id, 1, 'exit', CAST(10 + greatest(1, lines // 2) AS BIGINT), CAST(9 + lines AS BIGINT) FROM n WHERE logical > 20""",
)
def method_blocks(documents):
    """Entry and exit blocks of texts read as method bodies (checked on small bodies in the tests)."""
    return G.method_blocks(documents.select(F.col("doc_id").alias("node_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[.] ", "\n").alias("body"), F.lit(10).alias("start_line"), F.lit(0).alias("end_line")), 20)


@query("sys_05_blast_radius", "edge", f"WITH RECURSIVE l AS (SELECT DISTINCT src_node_id AS s, dst_node_id AS d FROM edge WHERE kind IN {CALLS}), r AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d) SELECT s AS node, count(*) FILTER (WHERE d <> s) AS blast_radius FROM r GROUP BY 1")
def blast(edges):
    return G.blast_radius(_links(edges))


LINKED_SQL = "WITH RECURSIVE l AS (SELECT DISTINCT src_node_id AS s, dst_node_id AS d FROM edge WHERE {0}), r AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d) SELECT s AS node, count(*) FILTER (WHERE d <> s) AS blast_radius, {1} AS degraded_reason FROM r GROUP BY 1"


def _linked(edges, exported: bool):
    """Reach over a repository's own static calls and the observed calls that a service has exported, if it has."""
    path = f"{shared_dir(edges.sparkSession)}/linked-{uuid.uuid4().hex}"
    named = edges.select(F.col("from_sha").alias("sha"), F.lit("r").alias("repo_id"), F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"), "kind")
    if exported:
        named = cut(named, "linked-edges")
        linked.export(named.where("kind <> 'static_calls'"), path, 500)
    links, reason = linked.with_linked(named.where("kind = 'static_calls'"), path, ["observed_calls"])
    found = G.blast_radius(links)
    return found.select("node", "blast_radius", F.lit(reason).cast("string").alias("degraded_reason"))


@query("gr_13_linked_blast_radius", "edge", LINKED_SQL.format("kind IN ('static_calls', 'observed_calls')", "CAST(NULL AS STRING)"))
def linked_blast_radius(edges):
    return _linked(edges, True)


@query("gr_13_without_link", "edge", LINKED_SQL.format("kind = 'static_calls'", f"'{linked.ABSENT}'"))
def without_link(edges):
    return _linked(edges, False)


DEPENDS = "l AS MATERIALIZED (SELECT DISTINCT src_node_id AS s, dst_node_id AS d FROM edge WHERE kind = 'imports')"


@query(
    "sys_01_dependency_depth",
    "edge",
    f"""WITH RECURSIVE {DEPENDS}, n AS (SELECT s AS x FROM l UNION SELECT d FROM l), r AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d),
    m AS MATERIALIZED (SELECT a.s AS x, min(a.d) AS root FROM r a JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY 1), c AS MATERIALIZED (SELECT n.x, coalesce(m.root, n.x) AS root FROM n LEFT JOIN m ON m.x = n.x),
    g AS MATERIALIZED (SELECT DISTINCT a.root AS s, b.root AS d FROM l JOIN c a ON a.x = l.s JOIN c b ON b.x = l.d WHERE a.root <> b.root),
    p AS (SELECT s, 1 AS k FROM g UNION SELECT g.s, p.k + 1 FROM p JOIN g ON g.d = p.s)
    SELECT c.x AS node, CAST(coalesce(max(p.k), 0) AS INTEGER) AS depth FROM c LEFT JOIN p ON p.s = c.root GROUP BY 1""",
)
def dependency_depth(edges):
    links = edges.where("kind = 'imports'").select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    return G.dependency_depth(nodes, links)
