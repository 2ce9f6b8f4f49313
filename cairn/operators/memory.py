"""Episodic memory: outcomes, concepts, promotion, retrieval, re-ranking and its training."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.common import cut, latest, scratch, without
from cairn.operators.stats import trailing_cap

CREATE_AT, PROMOTE_CONFIDENCE, PROMOTE_SUPPORT, BATCH, ATTEMPTS = 10, 0.7, 5, 64, 10
LABELLED_FLOOR, GROWTH = 50, 0.05
#: Rows of a range of the sequential trainer: what one task holds at a time, six floats of each.
SEQUENTIAL_ROWS = 4_000_000


# --- episodes


def observe(episodes: DataFrame, observations: DataFrame, contexts: DataFrame) -> DataFrame:
    """Observations to append: those given, and a degraded_recall_context for each episode whose context was served degraded."""
    flagged = episodes.join(contexts.where("served_under_degraded"), "episode_id").select("episode_id", F.lit("degraded_recall_context").alias("role"), F.col("context_id").alias("target_id"), F.lit(0.0).alias("weight"))
    given = observations.select("episode_id", "role", F.coalesce("node_id", "concept_id").alias("target_id"), "weight")
    return given.unionByName(flagged)


def effective_outcome(episodes: DataFrame, updates: DataFrame) -> DataFrame:
    """episodes with effective_outcome: that of the newest update not before the episode, else its own."""
    later = updates.select("episode_id", F.col("outcome").alias("_new"), F.col("created_at").alias("_at"), "update_id")
    newest = episodes.select("episode_id", "created_at").join(later, "episode_id").where("_at >= created_at").groupBy("episode_id").agg(F.max_by("_new", F.struct("_at", "update_id")).alias("_new"))
    return episodes.join(newest, "episode_id", "left").withColumn("effective_outcome", F.coalesce("_new", "outcome")).drop("_new")


def after_mark(episodes: DataFrame, created_at: Column, episode_id: str) -> DataFrame:
    """Episodes beyond a high-water mark, oldest first."""
    return episodes.where((F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("episode_id") > episode_id)))


def lag_seconds(episodes: DataFrame, mark: Column) -> DataFrame:
    """How far the newest episode is ahead of the mark, at least 0."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    return episodes.agg(F.greatest(F.lit(0.0), F.coalesce(seconds(F.max("created_at")) - seconds(mark), F.lit(0.0))).alias("lag_seconds"))


def synthetic_positives(episodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Agent episodes whose newest update is human_corrected, with their newest feedback, and no synthetic episode yet."""
    last = latest(updates, ["episode_id"], ["created_at", "update_id"]).where("outcome = 'human_corrected'").select("episode_id")
    children = episodes.where("parent_episode_id IS NOT NULL")
    feedback = latest(children.where("kind = 'feedback'").select("parent_episode_id", F.col("episode_id").alias("feedback_id"), "created_at"), ["parent_episode_id"], ["created_at", "feedback_id"])
    made = children.where("kind = 'synthetic_positive'").select(F.col("parent_episode_id").alias("episode_id"))
    agents = episodes.where("kind = 'agent'").join(last, "episode_id", "left_semi").join(made, "episode_id", "left_anti")
    return agents.join(feedback.select(F.col("parent_episode_id").alias("episode_id"), "feedback_id"), "episode_id").select("episode_id", "feedback_id")


# --- concepts


def episode_signatures(observations: DataFrame) -> DataFrame:
    """episode_id, signature: the digest of an episode's set of role:target members; episodes without members have none."""
    member = F.concat_ws(":", "role", F.coalesce("node_id", "concept_id"))
    sets = observations.where("node_id IS NOT NULL OR concept_id IS NOT NULL").groupBy("episode_id").agg(F.collect_set(member).alias("_m"))
    return sets.select("episode_id", S.set_signature(F.col("_m")).alias("signature"))


def concept_counts(episodes: DataFrame, observations: DataFrame) -> DataFrame:
    """signature, positive, negative (distinct episodes), confidence, band, create: whether there are positives enough for a concept."""
    sided = episodes.select("episode_id", S.polarity("kind", "outcome").alias("_side")).where("_side IS NOT NULL").distinct()
    counts = episode_signatures(observations).join(sided, "episode_id").groupBy("signature").agg(F.count(F.when(F.col("_side") == "positive", 1)).alias("positive"), F.count(F.when(F.col("_side") == "negative", 1)).alias("negative"))
    share = S.confidence("positive", "negative")
    return counts.withColumn("confidence", share).withColumn("band", S.band(share)).withColumn("create", F.col("positive") >= CREATE_AT)


def next_versions(current: DataFrame, supports: DataFrame, seen: DataFrame) -> DataFrame:
    """New versions of concepts whose counts change. current: concept_id, version_index, positive, negative; supports: concept_id, episode_id, side; seen: concept_id, episode_id."""
    new = supports.distinct().join(seen.distinct(), ["concept_id", "episode_id"], "left_anti")
    more = new.groupBy("concept_id").agg(F.count(F.when(F.col("side") == "positive", 1)).alias("_pos"), F.count(F.when(F.col("side") == "negative", 1)).alias("_neg")).where("_pos + _neg > 0")
    grown = current.join(more, "concept_id").select("concept_id", (F.col("version_index") + 1).alias("version_index"), (F.col("positive") + F.col("_pos")).alias("positive"), (F.col("negative") + F.col("_neg")).alias("negative"))
    return grown.withColumn("confidence", S.confidence("positive", "negative"))


def promotable(versions: DataFrame, published: DataFrame, batch: int = BATCH) -> DataFrame:
    """The next concepts to promote: newest version sure and supported enough, never published; surest first."""
    ready = latest(versions, ["concept_id"], ["version_index"]).where((F.col("confidence") >= PROMOTE_CONFIDENCE) & (F.col("support") >= PROMOTE_SUPPORT))
    return without(ready, published.distinct(), "concept_id").orderBy(F.desc("confidence"), F.desc("support"), "concept_id").limit(batch)


def stalled(events: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """Concepts whose latest event neither published nor superseded them, with fewer attempts than allowed."""
    state = events.groupBy("concept_id").agg(F.max_by("status", "event_id").alias("status"), F.count("*").alias("attempts"))
    return state.where(~F.col("status").isin("published", "superseded") & (F.col("attempts") < most))


def published_points(points: DataFrame, events: DataFrame, key: str = "concept_id") -> DataFrame:
    """Points whose latest event is ``published``."""
    return points.join(latest(events, [key], ["event_id"]).where("status = 'published'"), key, "left_semi")


# --- retrieval


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, overfetch: int = 1, kind: str = "label", vector: str = "embedding") -> DataFrame:
    """The k * overfetch nearest of each kind by cosine to one query vector: the query is a literal, each task keeps its best before the shuffle."""
    scored = vectors.withColumn("score", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("score"), "vec_id"))
    return scored.select("vec_id", kind, "score", place.alias("place")).where(F.col("place") <= k * overfetch)


def with_frontier(seeds: DataFrame, frontier: DataFrame) -> DataFrame:
    """Candidates (node_id, kind, score, hop): seeds, and frontier nodes that are no seeds with the best seed's score halved each hop."""
    best = F.broadcast(seeds.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("_best")))
    fresh = frontier.join(seeds.select("node_id"), "node_id", "left_anti").crossJoin(best)
    return seeds.select("node_id", "kind", "score", F.lit(0).alias("hop")).unionByName(fresh.select("node_id", "kind", S.hop_discount("_best", "hop").alias("score"), "hop"))


def cold_rank(candidates: DataFrame, k: int) -> DataFrame:
    """The k best by score - hop / 10, concepts 0.05 ahead; ties keep the order of hop and id."""
    final = F.col("score") - 0.1 * F.col("hop") + F.when(F.col("kind") == "concept", 0.05).otherwise(0.0)
    return candidates.withColumn("final", final).orderBy(F.desc("final"), "hop", "node_id").limit(k)


def linear_score(features: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    total = F.lit(float(bias))
    for w, x in zip(weights, features, strict=True):
        total = total + F.lit(float(w)) * x
    return F.when(F.isnan(total) | (F.abs(total) == float("inf")), 0.0).otherwise(total)


def fallback_context(contexts: DataFrame) -> DataFrame:
    """The last context of each repository and verb that was not served degraded."""
    return latest(contexts.where("not served_under_degraded"), ["repo_id", "verb"], ["created_at", "seq"])


def summary(cards: DataFrame, most: int = 32) -> DataFrame:
    """node_id, text, citations: a template over at most so many distinct targets of a node's card."""
    targets = cards.where("dst_node_id IS NOT NULL").groupBy("node_id", "kind", "dst_node_id").agg(F.min("edge_id").alias("edge_id"), F.max("observation_count").alias("_n"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("_n"), "edge_id"))
    first = targets.withColumn("_at", place).where(F.col("_at") <= most)
    listed = first.groupBy("node_id", "kind").agg(F.array_sort(F.collect_list(F.struct("_at", "dst_node_id", "edge_id"))).alias("_l"))
    names = F.array_join(F.transform("_l", lambda x: x["dst_node_id"]), ", ")
    return listed.select("node_id", F.concat(F.col("kind"), F.lit(" "), F.col("node_id"), F.lit(" reaches "), names).alias("text"), F.transform("_l", lambda x: x["edge_id"]).alias("citations"))


# --- learning to rank


def labelled_pairs(episodes: DataFrame, updates: DataFrame, since: Column) -> DataFrame:
    """episode_id, created_at, actor (of a correction), label (1.0 or -1.0), one row an episode; an episode on both sides is positive."""
    fix = updates.where("outcome = 'human_corrected'").groupBy("episode_id").agg(F.max_by("actor", F.struct("created_at", "update_id")).alias("actor"))
    rows = episodes.select("episode_id", "parent_episode_id", "kind", "outcome", "created_at")
    recent = rows.where(F.col("created_at") >= since)
    parent_fix = fix.withColumnRenamed("episode_id", "parent_episode_id")
    synthetic = recent.where("kind = 'synthetic_positive'")
    good = synthetic.join(parent_fix, "parent_episode_id", "left").select("episode_id", "created_at", "actor", F.lit(1.0).alias("label"))
    good = good.unionByName(recent.where("kind = 'agent' AND outcome = 'success'").select("episode_id", "created_at", F.lit(None).cast("string").alias("actor"), F.lit(1.0).alias("label")))
    bad = recent.where("kind = 'agent' AND outcome IN ('failure', 'degraded')").select("episode_id", "created_at", F.lit(None).cast("string").alias("actor"), F.lit(-1.0).alias("label"))
    parents = rows.join(synthetic.select(F.col("parent_episode_id").alias("episode_id")), "episode_id", "left_semi")
    corrected = parents.join(fix, "episode_id", "left").select("episode_id", "created_at", "actor", F.lit(-1.0).alias("label"))
    both = good.unionByName(bad).unionByName(corrected)
    return both.groupBy("episode_id").agg(F.max("label").alias("label"), F.min("created_at").alias("created_at"), F.max("actor").alias("actor"))


def capped_pairs(pairs: DataFrame, now: Column, hours: int = 1, most: int = 50) -> DataFrame:
    return trailing_cap(pairs, "actor", "created_at", "episode_id", now, hours, most)


FEATURES = ("bias", "kind_concept", "kind_node", "kind_edge", "score_signal")


def pair_features(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """pairs with the features of their observations: role flags, clamped mean of the positive weights."""
    flag = lambda *roles: F.coalesce(F.max(F.when(F.col("role").isin(*roles), 1.0).otherwise(0.0)), F.lit(0.0))
    own = observations.groupBy("episode_id").agg(
        flag("concept_hit", "cited").alias("kind_concept"), flag("node_hit", "call_edge_hit", "touched").alias("kind_node"), flag("edge_hit", "used").alias("kind_edge"), F.coalesce(S.clamp(F.avg(F.when(F.col("weight") > 0, F.col("weight")))), F.lit(0.0)).alias("score_signal")
    )
    rows = pairs.join(own, "episode_id", "left").withColumn("bias", F.lit(1.0))
    return rows.fillna(0.0, list(FEATURES[1:]))


def _descend(y: Sequence[float], x: Sequence[Sequence[float]], state: tuple, rate: float, with_loss: bool) -> tuple:
    """State (weights, intercept, summed loss) after a step for each row; x: a list a feature. Plain floats: numpy's scalars take several times as long."""
    (w0, w1, w2, w3, w4), b, loss = state
    exp, log1p = math.exp, math.log1p
    for label, x0, x1, x2, x3, x4 in zip(y, *x, strict=True):
        margin = label * (w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 + w4 * x4 + b)
        if with_loss:
            loss += log1p(exp(-margin)) if margin > -30 else -margin
        step = rate * label / (1 + exp(margin if margin < 700.0 else 700.0))
        w0, w1, w2, w3, w4, b = w0 + step * x0, w1 + step * x1, w2 + step * x2, w3 + step * x3, w4 + step * x4, b + step
    return (w0, w1, w2, w3, w4), b, loss


def train_linear(samples: DataFrame, epochs: int = 50, rate: float = 0.1, fraction: float = 0.1, most: int | None = None, block: int = SEQUENTIAL_ROWS) -> DataFrame:
    """weights (one a feature), intercept, train_loss: logistic regression by stochastic gradient descent in the order of episode ids.

    Each step depends on the one before, so the steps make a chain by definition. Ranges of about ``block`` ids lie
    packed in the shared folder; a task takes the steps of one range and hands the weights on to the next, so no
    task holds more than a range. The time grows with rows and epochs; train_batch is the one that is spread out.
    most: refuse more rows than that.
    """
    rows = samples.where(~S.hold_out("episode_id", fraction)).select("episode_id", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labelled pairs: use train_batch, or a shorter window")
    columns = ["label", *FEATURES]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for turn, batch in enumerate(batches):
            lists = [pa.array([batch.column(i + 1)], pa.list_(pa.float64())) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([turn], pa.int32()), *lists], names=["part", "turn", *columns])

    def steps(state: tuple, turns: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[batch.column(i + 2)[k].values.to_numpy() for i in range(len(columns))] for batch in batches for k in range(batch.num_rows)]
            now = state
            for turn in range(turns):
                for piece in held:
                    y, *x = (c.tolist() for c in piece)
                    now = _descend(y, x, now, rate, last and turn == turns - 1)
            yield pa.RecordBatch.from_arrays([pa.array([list(now[0])]), pa.array([float(now[1])]), pa.array([float(now[2])])], names=["w", "b", "loss"])

        return run

    with scratch(samples.sparkSession):
        plain = cut(rows, "train-rows")
        total = plain.count()
        blocks = max(1, math.ceil(total / block))
        dealt = plain.repartitionByRange(blocks, "episode_id").sortWithinPartitions("episode_id")
        packed = cut(dealt.mapInArrow(pack, f"part int, turn int, {', '.join(f'{c} array<double>' for c in columns)}"), "train-packed")
        state = ((0.0,) * len(FEATURES), 0.0, 0.0)
        for epoch in range(epochs if blocks > 1 else min(epochs, 1)):
            for part in range(blocks):
                last = blocks == 1 or epoch == epochs - 1
                mine = packed.where(F.col("part") == part).coalesce(1).sortWithinPartitions("turn")
                found = mine.mapInArrow(steps(state, 1 if blocks > 1 else epochs, last), "w array<double>, b double, loss double").first()
                if found is not None:  # a range without rows
                    state = (tuple(found["w"]), found["b"], found["loss"])
    return samples.sparkSession.createDataFrame([(list(state[0]), state[1], state[2] / max(total, 1))], "weights array<double>, intercept double, train_loss double")


def train_batch(samples: DataFrame, epochs: int = 50, rate: float = 0.1, fraction: float = 0.1) -> DataFrame:
    """weights, intercept, train_loss as train_linear gives them, by gradient descent over all rows at once.

    Each epoch is one aggregate of gradient sums, so it is combined in every task and the driver holds the
    weights only. Equal rows are counted first and written once. train_loss is that before the last step;
    without rows all is zero.
    """
    rows = samples.where(~S.hold_out("episode_id", fraction))
    with scratch(samples.sparkSession) as _:
        counted = cut(rows.groupBy("label", *FEATURES).agg(F.count("*").alias("n")), "pairs")
        w, b, loss = [0.0] * len(FEATURES), 0.0, 0.0
        for _epoch in range(epochs):
            margin = F.col("label") * (sum((F.col(c) * F.lit(v) for c, v in zip(FEATURES, w, strict=True)), F.lit(b)))
            step = F.col("n") * F.col("label") / (1 + F.exp(F.least(margin, F.lit(700.0))))
            cost = F.col("n") * F.when(margin > -30, F.log1p(F.exp(-margin))).otherwise(-margin)
            sums = counted.agg(F.sum("n").alias("n"), F.sum(cost).alias("loss"), F.sum(step).alias("b"), *[F.sum(step * F.col(c)).alias(c) for c in FEATURES]).first()
            if not sums["n"]:
                break
            w = [v + rate * sums[c] / sums["n"] for c, v in zip(FEATURES, w, strict=True)]
            b, loss = b + rate * sums["b"] / sums["n"], sums["loss"] / sums["n"]
    return samples.sparkSession.createDataFrame([(w, b, loss)], "weights array<double>, intercept double, train_loss double")


def retrain(counts: DataFrame) -> DataFrame:
    """counts (labelled, baseline) with due (floor reached) and early (grown enough, or no baseline yet)."""
    grown = (F.col("labelled") - F.col("baseline")) / F.col("baseline") >= GROWTH
    early = F.when(F.coalesce(F.col("baseline"), F.lit(0)) == 0, F.col("labelled") > 0).otherwise(grown)
    return counts.withColumn("due", F.col("labelled") >= LABELLED_FLOOR).withColumn("early", early)
