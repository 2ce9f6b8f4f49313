"""Queries of episodes, concepts, retrieval and learning to rank."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import graph as G
from cairn.operators import memory as R
from cairn.operators.common import latest
from cairn.operators.ordered import nearest_rank
from cairn.plans.catalog import query
from cairn.plans.relational import rounded

START = "TIMESTAMP '2024-01-08 00:00:00'"
END = "TIMESTAMP '2024-01-31 00:00:00'"
EFFECTIVE = "(SELECT e.*, coalesce((SELECT outcome FROM episode_update u WHERE u.episode_id = e.episode_id AND u.created_at >= e.created_at ORDER BY u.created_at DESC, u.update_id DESC LIMIT 1), e.outcome) AS effective_outcome FROM episode e)"


def ts(text: str):
    return F.expr(f"CAST({text} AS TIMESTAMP_NTZ)")


@query("epi_01_observe", "episode observation context_log", "SELECT episode_id, role, coalesce(node_id, concept_id) AS target_id, weight FROM observation UNION ALL SELECT episode_id, 'degraded_recall_context', context_id, 0.0 FROM context_log WHERE served_under_degraded")
def observe(episodes, observations, contexts):
    return R.observe(episodes, observations, contexts)


@query("epi_02_effective_outcome", "episode episode_update", f"SELECT repo_id, effective_outcome, count(*) AS n FROM {EFFECTIVE} GROUP BY ALL")
def effective(episodes, updates):
    return R.effective_outcome(episodes, updates).groupBy("repo_id", "effective_outcome").agg(F.count("*").alias("n"))


@query("epi_03_recent_episodes", "episode episode_update", f"SELECT episode_id, effective_outcome FROM {EFFECTIVE} WHERE created_at >= {START} AND kind = 'agent' ORDER BY created_at DESC, episode_id LIMIT 200")
def recent(episodes, updates):
    rows = R.effective_outcome(episodes.where("kind = 'agent'").where(F.col("created_at") >= ts(START)), updates)
    return rows.orderBy(F.desc("created_at"), "episode_id").limit(200).select("episode_id", "effective_outcome")


@query("epi_03_concepts", "concept_version", "SELECT concept_id, version_index, confidence, support FROM concept_version QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY version_index DESC, confidence DESC) = 1 ORDER BY concept_id DESC")
def concepts_with_version(versions):
    """Every concept with its newest version."""
    return latest(versions, ["concept_id"], ["version_index", "confidence"]).orderBy(F.desc("concept_id")).select("concept_id", "version_index", "confidence", "support")


@query("epi_03_observations", "observation episode", "SELECT o.episode_id, o.role, o.node_id, o.concept_id, o.weight FROM observation o JOIN episode e USING (episode_id) WHERE e.repo_id = 'u3' ORDER BY e.created_at DESC, o.episode_id")
def observations_of_repository(observations, episodes):
    own = episodes.where("repo_id = 'u3'").select("episode_id", "created_at")
    return observations.join(own, "episode_id").orderBy(F.desc("created_at"), "episode_id").select("episode_id", "role", "node_id", "concept_id", "weight")


@query("epi_03_supports", "observation episode", "SELECT concept_id, o.episode_id, role, row_number() OVER (PARTITION BY concept_id ORDER BY e.created_at DESC, o.episode_id DESC) AS place FROM observation o JOIN episode e USING (episode_id) WHERE concept_id IS NOT NULL QUALIFY place <= 50")
def supports(observations, episodes):
    """The newest fifty supports of each concept: each task keeps fifty of a concept before the shuffle."""
    rows = observations.where("concept_id IS NOT NULL").join(episodes.select("episode_id", "created_at"), "episode_id")
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("created_at"), F.desc("episode_id")))
    return rows.withColumn("place", place.cast("long")).where("place <= 50").select("concept_id", "episode_id", "role", "place")


@query("epi_03_commits", "commit", "SELECT repo_id, sha, parent_sha, scan_status, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, sha DESC) AS place FROM commit QUALIFY place <= 20")
def commits_of_repositories(commits):
    """The newest twenty commits of each repository."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("committed_at"), F.desc("sha")))
    return commits.withColumn("place", place.cast("long")).where("place <= 20").select("repo_id", "sha", "parent_sha", "scan_status", "place")


@query("epi_03_trace_tail", "span", "SELECT method, n, p95, span_id, place FROM (SELECT method, span_id, row_number() OVER (PARTITION BY method ORDER BY started_at DESC, span_id DESC) AS place FROM span) JOIN (SELECT method, count(*) AS n, quantile_disc(duration_ms, 0.95) AS p95 FROM span GROUP BY 1) USING (method) WHERE place <= 10")
def trace_tail(spans):
    """The ten newest spans of each method beside its aggregate."""
    place = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("started_at"), F.desc("span_id")))
    tail = spans.select("method", "span_id", "started_at").withColumn("place", place.cast("long")).where("place <= 10")
    return tail.join(nearest_rank(spans, ["method"], "duration_ms", p95=0.95), "method").select("method", "n", "p95", "span_id", "place")


@query("epi_04_corrections", "episode episode_update", "SELECT e.episode_id, u.update_id, u.outcome FROM episode e JOIN episode_update u ON u.episode_id = e.episode_id AND u.outcome = 'human_corrected' WHERE e.kind = 'agent'")
def corrections(episodes, updates):
    return updates.where("outcome = 'human_corrected'").join(episodes.where("kind = 'agent'").select("episode_id"), "episode_id", "left_semi").select("episode_id", "update_id", "outcome")


@query("str_09_after_mark", "episode", f"SELECT episode_id FROM episode WHERE (created_at, episode_id) > ({START}, 'ep5')")
def after_mark(episodes):
    return R.after_mark(episodes, ts(START), "ep5").select("episode_id")


MEMBERS = "(SELECT episode_id, sha256(string_agg(DISTINCT role || ':' || coalesce(node_id, concept_id), chr(10) ORDER BY role || ':' || coalesce(node_id, concept_id))) AS signature FROM observation GROUP BY episode_id)"


@query("fn_03_set_signature", "observation", f"SELECT episode_id, signature FROM {MEMBERS}")
def set_signature(observations):
    return R.episode_signatures(observations)


CONCEPTS = f"(SELECT signature, count(*) FILTER (WHERE kind = 'synthetic_positive' OR outcome = 'success') AS positive, count(*) FILTER (WHERE NOT (kind = 'synthetic_positive' OR outcome = 'success')) AS negative FROM {MEMBERS} m JOIN episode e USING (episode_id) GROUP BY 1)"


@query(
    "con_01_02_concepts",
    "episode observation",
    f"SELECT signature, positive, negative, round(positive / (positive + negative), 6) AS confidence, CASE WHEN positive / (positive + negative) < 0.3 THEN 'low' WHEN positive / (positive + negative) < 0.7 THEN 'medium' ELSE 'high' END AS band, positive >= 10 AS \"create\" FROM {CONCEPTS}",
)
def concepts(episodes, observations):
    return rounded(R.concept_counts(episodes, observations), "confidence")


SUPPORT = "(SELECT DISTINCT 'cx' || CAST(k % 20 AS STRING) AS concept_id, episode_id, CASE WHEN kind = 'synthetic_positive' OR outcome = 'success' THEN 'positive' ELSE 'negative' END AS side, k FROM episode)"


@query(
    "con_03_next_versions",
    "episode",
    f"""WITH s AS {SUPPORT}, c AS (SELECT concept_id, 3 AS version_index, count(*) FILTER (WHERE side = 'positive') AS positive, count(*) FILTER (WHERE side = 'negative') AS negative FROM s WHERE k % 3 = 0 GROUP BY 1),
    m AS (SELECT concept_id, count(*) FILTER (WHERE side = 'positive') AS p, count(*) FILTER (WHERE side = 'negative') AS n FROM s WHERE k % 3 <> 0 GROUP BY 1)
    SELECT concept_id, 4 AS version_index, positive + p AS positive, negative + n AS negative, round((positive + p) / (positive + p + negative + n), 6) AS confidence FROM c JOIN m USING (concept_id)""",
)
def next_versions(episodes):
    s = episodes.select(F.concat(F.lit("cx"), F.col("k") % 20).alias("concept_id"), "episode_id", S.polarity("kind", "outcome").alias("side"), "k").distinct()
    old = s.where("k % 3 = 0")
    side = lambda x: F.count(F.when(F.col("side") == x, 1)).alias(x)
    current = old.groupBy("concept_id").agg(F.lit(3).alias("version_index"), side("positive"), side("negative"))
    return rounded(R.next_versions(current, s.drop("k"), old.select("concept_id", "episode_id")), "confidence")


@query(
    "con_04_synthetic_positives",
    "episode episode_update",
    """WITH u AS (SELECT episode_id, outcome FROM episode_update QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY created_at DESC, update_id DESC) = 1),
    f AS (SELECT parent_episode_id, episode_id AS feedback_id FROM episode WHERE kind = 'feedback' AND parent_episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_episode_id ORDER BY created_at DESC, episode_id DESC) = 1)
    SELECT e.episode_id, f.feedback_id FROM episode e JOIN u ON u.episode_id = e.episode_id AND u.outcome = 'human_corrected' JOIN f ON f.parent_episode_id = e.episode_id WHERE e.kind = 'agent'
    AND NOT EXISTS (SELECT 1 FROM episode s WHERE s.kind = 'synthetic_positive' AND s.parent_episode_id = e.episode_id)""",
)
def synthetic(episodes, updates):
    return R.synthetic_positives(episodes, updates)


LAST = "(SELECT * FROM concept_version QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY version_index DESC) = 1)"


@query("pro_01_promotable", "concept_version publish_event", f"SELECT concept_id, version_index, support FROM {LAST} v WHERE confidence >= 0.7 AND support >= 5 AND NOT EXISTS (SELECT 1 FROM publish_event p WHERE p.concept_id = v.concept_id AND p.status = 'published') ORDER BY confidence DESC, support DESC, concept_id LIMIT 64")
def promotable(versions, events):
    return R.promotable(versions, events.where("status = 'published'").select("concept_id")).select("concept_id", "version_index", "support")


@query("pro_02_stalled", "publish_event", "SELECT concept_id, arg_max(status, event_id) AS status, count(*) AS attempts FROM publish_event GROUP BY 1 HAVING arg_max(status, event_id) NOT IN ('published', 'superseded') AND count(*) < 100")
def stalled(events):
    return R.stalled(events, 100)


@query("pro_02_orphans", "concept_version publish_event", f"SELECT concept_id FROM {LAST} v WHERE confidence >= 0.7 AND NOT EXISTS (SELECT 1 FROM publish_event p WHERE p.concept_id = v.concept_id)")
def orphans(versions, events):
    from cairn.operators.common import latest, without

    return without(latest(versions, ["concept_id"], ["version_index"]).where("confidence >= 0.7"), events, "concept_id").select("concept_id")


@query("vec_02_published", "concept_version publish_event", "SELECT concept_id, version_index FROM concept_version WHERE concept_id IN (SELECT concept_id FROM (SELECT concept_id, arg_max(status, event_id) AS s FROM publish_event GROUP BY 1) WHERE s = 'published')")
def published(versions, events):
    return R.published_points(versions, events).select("concept_id", "version_index")


COSINE = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"
NEAREST = f"(SELECT e.vec_id, e.label, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _query_vector(vectors):
    return vectors.where("vec_id = 0").select("embedding").first()[0]


@query("vec_01_nearest", "embeddings", f"SELECT vec_id, label, round(score, 5) AS score FROM {NEAREST} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 10")
def nearest(vectors):
    return R.nearest(vectors, _query_vector(vectors), 5, 2).select("vec_id", "label", F.round("score", 5).alias("score"))


RECALL = f"""s AS (SELECT 'n' || CAST(vec_id AS STRING) AS node_id, CASE WHEN label = 0 THEN 'concept' ELSE 'method' END AS kind, round(score, 6) AS score, 0 AS hop FROM {NEAREST} QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5),
l AS (SELECT DISTINCT src_node_id AS a, dst_node_id AS b FROM edge WHERE kind IN ('static_calls', 'observed_calls')),
o AS (SELECT DISTINCT b AS node_id, 1 AS hop FROM s JOIN l ON a = node_id), w AS (SELECT DISTINCT b AS node_id, 2 AS hop FROM o JOIN l ON a = node_id),
f AS (SELECT node_id, min(hop) AS hop FROM (SELECT * FROM o UNION ALL SELECT * FROM w) WHERE node_id NOT IN (SELECT node_id FROM s) GROUP BY 1),
c AS (SELECT * FROM s UNION ALL SELECT node_id, 'method', (SELECT max(score) FROM s) * pow(0.5, hop), hop FROM f)"""


@query("vec_03_04_recall", "embeddings edge", f"WITH {RECALL} SELECT node_id, kind, hop, round(score - 0.1 * hop + CASE WHEN kind = 'concept' THEN 0.05 ELSE 0 END, 8) AS final FROM c ORDER BY round(score - 0.1 * hop + CASE WHEN kind = 'concept' THEN 0.05 ELSE 0 END, 8) DESC, hop, node_id LIMIT 40")
def recall(vectors, edges):
    hits = R.nearest(vectors, _query_vector(vectors), 5)
    seeds = hits.select(F.concat(F.lit("n"), "vec_id").alias("node_id"), F.when(F.col("label") == 0, "concept").otherwise("method").alias("kind"), F.round("score", 6).alias("score"))
    links = edges.where(F.col("kind").isin(*G.CALLS)).select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"))
    reached = G.reachable(links, seeds.select(F.col("node_id").alias("node")), 2).groupBy(F.col("node").alias("node_id")).agg(F.min("hop").alias("hop")).where("hop > 0")
    ranked = R.with_frontier(seeds, reached.withColumn("kind", F.lit("method")))
    final = F.round(F.col("score") - 0.1 * F.col("hop") + F.when(F.col("kind") == "concept", 0.05).otherwise(0.0), 8)
    return ranked.withColumn("final", final).orderBy(F.desc("final"), "hop", "node_id").limit(40).select("node_id", "kind", "hop", "final")


@query("vec_05_linear_rank", "documents", "SELECT doc_id, round((0.25 + 0.5 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END - 0.001 * coalesce(n_chars, 0))::DOUBLE, 6) AS score FROM documents")
def linear_rank(documents):
    features = [F.when(F.col("lang") == "en", 1.0).otherwise(0.0), F.coalesce("n_chars", F.lit(0)).cast("double")]
    return documents.select("doc_id", F.round(R.linear_score(features, [0.5, -0.001], 0.25), 6).alias("score"))


@query("vec_06_fallback_context", "context_log", "SELECT repo_id, verb, context_id FROM context_log WHERE NOT served_under_degraded QUALIFY row_number() OVER (PARTITION BY repo_id, verb ORDER BY created_at DESC, seq DESC) = 1")
def fallback(contexts):
    return R.fallback_context(contexts).select("repo_id", "verb", "context_id")


@query(
    "vec_07_summary",
    "node edge trace_observation",
    """WITH t AS (SELECT n.node_id, n.kind, e.dst_node_id, min(e.edge_id) AS edge_id, max(coalesce(o.observation_count, 0)) AS n FROM node n JOIN edge e ON e.src_node_id = n.node_id LEFT JOIN trace_observation o USING (edge_id) GROUP BY ALL),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, edge_id) AS rn FROM t) WHERE rn <= 32)
    SELECT node_id, kind || ' ' || node_id || ' reaches ' || string_agg(dst_node_id, ', ' ORDER BY rn) AS text, string_agg(edge_id, ',' ORDER BY rn) AS citations FROM r GROUP BY node_id, kind""",
)
def summary(nodes, edges, observations):
    return R.summary(G.card(nodes, edges, observations)).withColumn("citations", F.array_join("citations", ","))


PAIRS = f"""u AS (SELECT episode_id, arg_max('h' || CAST(update_id % 5 AS STRING), (created_at, update_id)) AS actor FROM episode_update WHERE outcome = 'human_corrected' GROUP BY 1),
sp AS (SELECT * FROM episode WHERE kind = 'synthetic_positive' AND created_at >= {START}),
a AS (SELECT sp.episode_id, sp.created_at, u.actor, 1.0 AS label FROM sp LEFT JOIN u ON u.episode_id = sp.parent_episode_id
  UNION ALL SELECT episode_id, created_at, NULL, 1.0 FROM episode WHERE kind = 'agent' AND outcome = 'success' AND created_at >= {START}
  UNION ALL SELECT episode_id, created_at, NULL, -1.0 FROM episode WHERE kind = 'agent' AND outcome IN ('failure', 'degraded') AND created_at >= {START}
  UNION ALL SELECT p.episode_id, p.created_at, u.actor, -1.0 FROM episode p LEFT JOIN u ON u.episode_id = p.episode_id WHERE p.episode_id IN (SELECT parent_episode_id FROM sp)),
pairs AS (SELECT episode_id, max(label)::DOUBLE AS label, min(created_at) AS created_at, max(actor) AS actor FROM a GROUP BY 1)"""


def _pairs(episodes, updates):
    return R.labelled_pairs(episodes, updates.withColumn("actor", F.concat(F.lit("h"), F.col("update_id") % 5)), ts(START))


@query("ltr_01_labelled_pairs", "episode episode_update", f"WITH {PAIRS} SELECT episode_id, label, created_at, actor FROM pairs")
def labelled_pairs(episodes, updates):
    return _pairs(episodes, updates)


@query("ltr_02_capped_pairs", "episode episode_update", f"WITH {PAIRS} SELECT episode_id, label FROM (SELECT *, coalesce(created_at BETWEEN {END} - INTERVAL 480 HOUR AND {END} AND actor IS NOT NULL, false) AS inside FROM pairs) QUALIFY NOT inside OR row_number() OVER (PARTITION BY actor, inside ORDER BY created_at, episode_id) <= 3")
def capped(episodes, updates):
    return R.capped_pairs(_pairs(episodes, updates), ts(END), 480, 3).select("episode_id", "label")


@query(
    "ltr_03_features",
    "episode episode_update observation",
    f"""WITH {PAIRS}, o AS (SELECT episode_id, max(CASE WHEN role = 'cited' THEN 1.0 ELSE 0.0 END) AS c, max(CASE WHEN role = 'touched' THEN 1.0 ELSE 0.0 END) AS n, max(CASE WHEN role = 'used' THEN 1.0 ELSE 0.0 END) AS e, least(1, greatest(0, avg(CASE WHEN weight > 0 THEN weight END))) AS s FROM observation GROUP BY 1)
    SELECT episode_id, label, coalesce(c, 0)::DOUBLE AS kind_concept, coalesce(n, 0)::DOUBLE AS kind_node, coalesce(e, 0)::DOUBLE AS kind_edge, round(coalesce(s, 0), 6) AS score_signal FROM pairs LEFT JOIN o USING (episode_id)""",
)
def features(episodes, updates, observations):
    return rounded(R.pair_features(_pairs(episodes, updates), observations).select("episode_id", "label", "kind_concept", "kind_node", "kind_edge", "score_signal"), "score_signal")


@query("ltr_04_train", "episode episode_update observation", None)
def train(episodes, updates, observations):
    """Weights of the sequential trainer (checked against an independent loop in the tests)."""
    fitted = R.train_linear(R.pair_features(_pairs(episodes, updates), observations))
    return fitted.select(F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), F.round("intercept", 6).alias("intercept"), F.round("train_loss", 6).alias("train_loss"))


@query("ltr_04_train_batch", "episode episode_update observation", None)
def train_batch(episodes, updates, observations):
    """Weights by gradient sums over all pairs (checked against an independent loop in the tests)."""
    fitted = R.train_batch(R.pair_features(_pairs(episodes, updates), observations))
    return fitted.select(F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), F.round("intercept", 6).alias("intercept"), F.round("train_loss", 6).alias("train_loss"))


@query("ltr_06_retrain", "episode", "SELECT repo_id, labelled, baseline, labelled >= 50 AS due, CASE WHEN baseline = 0 THEN labelled > 0 ELSE (labelled - baseline) / baseline >= 0.05 END AS early FROM (SELECT repo_id, count(*) FILTER (WHERE outcome = 'success') AS labelled, count(*) FILTER (WHERE outcome = 'success' AND k % 3 <> 0) AS baseline FROM episode GROUP BY 1)")
def retrain(episodes):
    good = F.col("outcome") == "success"
    counts = episodes.groupBy("repo_id").agg(F.count(F.when(good, 1)).alias("labelled"), F.count(F.when(good & (F.col("k") % 3 != 0), 1)).alias("baseline"))
    return R.retrain(counts)


@query("set_01_02_pair_classes", "episode episode_update", f"WITH {PAIRS} SELECT label::DOUBLE AS label, count(*) AS n FROM a GROUP BY 1")
def pair_classes(episodes, updates):
    synthetic = episodes.where("kind = 'synthetic_positive'").where(F.col("created_at") >= ts(START))
    agents = episodes.where("kind = 'agent'").where(F.col("created_at") >= ts(START))
    positive = synthetic.select("episode_id").unionByName(agents.where("outcome = 'success'").select("episode_id"))
    corrected = episodes.join(synthetic.select(F.col("parent_episode_id").alias("episode_id")), "episode_id", "left_semi").select("episode_id")
    negative = agents.where("outcome IN ('failure', 'degraded')").select("episode_id").unionByName(corrected)
    return positive.withColumn("label", F.lit(1.0)).unionByName(negative.withColumn("label", F.lit(-1.0))).groupBy("label").agg(F.count("*").alias("n"))
