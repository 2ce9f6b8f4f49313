"""Property graphs: reads, reachability, ancestry, components, strong components, edge builders.

Iterations run on DataFrames and write each round to the shared folder; frontiers, never the whole graph,
are joined against the edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.common import cut, pairs_once, without
from cairn.operators.graph_survey import survey, survey_links

CALLS = ("static_calls", "observed_calls")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- reads


def with_retirement(rows: DataFrame, retired: DataFrame, key: str, include_retired: bool) -> DataFrame:
    """Current rows, or all with the commit they were retired at."""
    return rows.join(retired.select(key, "retired_at_sha"), key, "left") if include_retired else without(rows, retired, key)


def edges_of(edges: DataFrame, node: str, kinds: Sequence[str] | None = None, incoming: bool = False, limit: int | None = None) -> DataFrame:
    """Edges from (or to) a node, by kind and id."""
    rows = edges.where(F.col("dst_node_id" if incoming else "src_node_id") == node)
    rows = (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).orderBy("kind", "edge_id")
    return rows.limit(limit) if limit else rows


def card(nodes: DataFrame, edges: DataFrame, observations: DataFrame) -> DataFrame:
    """Every node with its outgoing edges, their targets' kinds and observation counts."""
    seen = edges.join(observations, "edge_id", "left").withColumn("observation_count", F.coalesce("observation_count", F.lit(0).cast("long")))
    kinds = nodes.select(F.col("node_id").alias("dst_node_id"), F.col("kind").alias("dst_kind"))
    out = seen.join(kinds, "dst_node_id", "left").select(F.col("src_node_id").alias("node_id"), "edge_id", F.col("kind").alias("edge_kind"), "dst_node_id", "dst_kind", "observation_count")
    return nodes.select("node_id", "kind").join(out, "node_id", "left")


# --- traversals


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, node, hop): everything that sources (node) reach along edges (src, dst), at its first hop; the source at hop 0."""
    links = edges.select("src", "dst").distinct()
    frontier = cut(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hop", F.lit(0)), "reach")
    parts, hop = [frontier], 0
    while max_depth is None or hop < max_depth:
        hop += 1
        step = frontier.join(links, frontier.node == links.src).select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(_union(parts), ["source", "node"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if not frontier.take(1):
            break
        parts.append(frontier)
    return _union(parts)


def blast_radius(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, blast_radius: how many other nodes each source reaches; without sources, each node that an edge leaves."""
    held = cut(edges.select("src", "dst").where("src IS NOT NULL").distinct(), "blast-links")
    found = survey_links(held.where("dst IS NOT NULL"), reach=True).select("node", F.col("reach").alias("blast_radius"))
    sources = held.select(F.col("src").alias("node")) if sources is None else sources
    return sources.select("node").where("node IS NOT NULL").distinct().join(found, "node", "left").select("node", F.coalesce("blast_radius", F.lit(0)).alias("blast_radius"))


def ancestry(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, distance): the target and everything above it; parents (id, parent). Steps double, so rounds grow with the logarithm of the depth."""
    jump = cut(parents.where("parent IS NOT NULL").select("id", "parent").distinct(), "jump")
    known, step = cut(targets.select(F.col("id").alias("target"), "id", F.lit(0).alias("distance")), "ancestry"), 1
    while jump.take(1):
        further = known.join(jump, "id").select("target", F.col("parent").alias("id"), (F.col("distance") + step).alias("distance"))
        known = cut(known.unionByName(further), "ancestry")
        double = jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.id")).select("a.id", "b.parent")
        jump, step = cut(double, "jump"), 2 * step
        if step > 1 << 30:
            raise ValueError("the parents have a cycle")
    return known


def visible_at(rows: DataFrame, retired: DataFrame, key: str, ancestors: DataFrame, target: str) -> DataFrame:
    """Rows that exist at a commit: made at or above it, and not retired strictly above it. ancestors: ids at or above the target."""
    up = ancestors.select("id")
    made = rows.join(up.withColumnRenamed("id", "from_sha"), "from_sha", "left_semi")
    gone = retired.where(F.col("retired_at_sha") != target).join(up.withColumnRenamed("id", "retired_at_sha"), "retired_at_sha", "left_semi")
    return without(made, gone, key)


def expand(edges: DataFrame, seeds: Sequence[str], depth: int, max_edges: int = 64, max_nodes: int | None = None, kinds: Sequence[str] = CALLS, callers: bool = False) -> tuple[list[dict], dict[str, int], bool]:
    """Edges in the order found (with hop), nodes with their first hop, and whether a budget or the depth cut the walk.

    A budgeted read for one request: each level asks the edges for at most the budget that is left, and what
    stays on the driver is bounded by max_edges.
    """
    start, end = ("dst_node_id", "src_node_id") if callers else ("src_node_id", "dst_node_id")
    spark, links = edges.sparkSession, edges.where(F.col("kind").isin(*kinds))
    layer, seen_nodes = list(dict.fromkeys(seeds)), dict.fromkeys(seeds, 0)
    found: dict[str, dict] = {}

    def ask(nodes: list[str], limit: int):
        place = spark.createDataFrame(list(enumerate(nodes)), f"_at long, {start} string")
        fresh = links.join(F.broadcast(place), start)
        if found:
            known = spark.createDataFrame([(e,) for e in found], "edge_id string")
            fresh = fresh.join(F.broadcast(known), "edge_id", "left_anti")
        return fresh.orderBy("_at", "kind", "edge_id").limit(limit).select("edge_id", "kind", start, end).collect()

    for hop in range(1, depth + 1):
        left = max_edges - len(found)
        if not layer or left <= 0:
            return list(found.values()), seen_nodes, bool(layer)
        rows = ask(layer, left + 1)
        truncated, layer = len(rows) > left, []
        for row in rows[:left]:
            found[row["edge_id"]] = {**row.asDict(), "hop": hop}
            if row[end] not in seen_nodes:
                if max_nodes is not None and len(seen_nodes) - len(set(seeds)) >= max_nodes:
                    return list(found.values()), seen_nodes, True
                seen_nodes[row[end]] = hop
                layer.append(row[end])
        if truncated:
            return list(found.values()), seen_nodes, True
    return list(found.values()), seen_nodes, bool(layer and ask(layer, 1))


# --- components


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b), by large-star and small-star rounds (Kiveris et al., 2014); root: the smallest node."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = cut(small, "stars")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes on cycles of two or more; root: the smallest of them. edges (src, dst); self-loops are ignored."""
    return survey(edges).where("size > 1").select("node", "root")


def coloured_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes on cycles of two or more: colouring (Orzan, 2004). edges (src, dst); self-loops are ignored.

    Rounds: edges that no cycle can use are trimmed; the largest name that reaches a node is its colour; what
    reaches the bearer of a colour within the colour is its strong component, and leaves the graph.
    """
    left, parts = cut(edges.where("src <> dst").select("src", "dst").distinct(), "scc"), []
    while True:
        while True:  # an edge on a cycle starts where one ends and ends where one starts
            before = left.count()
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            left = cut(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            if left.count() == before:
                break
        if not before:
            break
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            pushed = left.join(colour, left.src == colour.node).select(F.col("dst").alias("node"), "colour")
            after = cut(colour.union(pushed).groupBy("node").agg(F.max("colour").alias("colour")), "colour")
            moved = after.join(colour, ["node", "colour"], "left_anti").take(1)
            colour = after
            if not moved:
                break
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        back = cut(ends.where("cs = cd").select("src", "dst", F.col("cs").alias("root")), "back")
        front = cut(colour.where("node = colour").select("node", F.col("colour").alias("root")), "front")
        members = [front]
        while front.take(1):
            step = front.join(back, [front.node == back.dst, front.root == back.root]).select(back.src.alias("node"), back.root).distinct()
            front = cut(step.join(_union(members), ["node", "root"], "left_anti"), "front")
            members.append(front)
        done = cut(_union(members), "scc-members")
        parts.append(done)
        rest = left.join(done.select(F.col("node").alias("src")), "src", "left_anti")
        left = cut(rest.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    found = cut(_union(parts), "scc-found")
    several = found.groupBy("root").count().where("count > 1").select("root")
    return found.join(several, "root", "left_semi").select("node", "root")


def dependency_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, depth: edges on the longest path from it in the graph whose strong components are single nodes."""
    return nodes.select("node").join(survey(edges).select("node", "depth"), "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def levels(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """node, depth: edges on the longest path from it; dag (src, dst) has no cycle. A written round for each step of the longest path."""
    parts, front, level = [nodes.select("node", F.lit(0).alias("depth"))], None, 0
    while True:  # in round k: what has a path of k edges below it
        level += 1
        below = dag if front is None else dag.join(front.withColumnRenamed("node", "dst"), "dst", "left_semi")
        front = cut(below.select(F.col("src").alias("node")).distinct(), "front")
        if not front.take(1):
            break
        parts.append(front.withColumn("depth", F.lit(level)))
    return _union(parts).groupBy("node").agg(F.max("depth").alias("depth"))


# --- deltas and edge builders


def rename_pairs(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(old_node_id, new_node_id): where a parent signature and kind lost exactly one node and gained exactly one. Both: parent_signature, kind, node_id."""

    def single(rows: DataFrame, name: str) -> DataFrame:
        there = rows.where("parent_signature IS NOT NULL AND parent_signature <> ''")
        return there.groupBy("parent_signature", "kind").agg(F.count("*").alias("_n"), F.first("node_id").alias(name)).where("_n = 1").drop("_n")

    return single(gone, "old_node_id").join(single(new, "new_node_id"), ["parent_signature", "kind"])


def incident_retirements(nodes: DataFrame, edges: DataFrame, retired_edges: DataFrame) -> DataFrame:
    """Edges to retire with their nodes: those that start or end there, but renames, and not yet retired."""
    rows = edges.where("kind <> 'renamed_to'").select("edge_id", "src_node_id", "dst_node_id")
    ends = rows.join(nodes.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi").select("edge_id").union(rows.join(nodes.select(F.col("node_id").alias("dst_node_id")), "dst_node_id", "left_semi").select("edge_id"))
    return without(ends.distinct(), retired_edges, "edge_id")


def _edge(kind: str, src: str | Column, dst: str | Column, **more: Column) -> list[Column]:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return [F.lit(kind).alias("kind"), as_col(src).alias("src"), as_col(dst).alias("dst"), *[c.alias(n) for n, c in more.items()]]


def import_edges(imports: DataFrame) -> DataFrame:
    """File to package for each import that is not relative. imports: file, target, symbol."""
    rows = imports.where(~F.col("target").startswith("."))
    return rows.groupBy("file", "target").agg(F.array_sort(F.collect_set("symbol")).alias("symbols")).select(*_edge("imports", "file", F.concat(F.lit("package:"), "target"), symbols=F.col("symbols")))


def call_edges(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Static calls within a file. methods: file, name (dotted), node; calls: file, caller, callee, enclosing (the class for a call on the receiver, else null).

    A bare call has an edge if exactly one method of the file has that last segment; a call on the receiver if
    exactly one node has the class's dotted name. Others have none.
    """

    def only(name: Column) -> DataFrame:
        return methods.select("file", name.alias("_name"), "node").distinct().groupBy("file", "_name").agg(F.count("*").alias("_n"), F.first("node").alias("node")).where("_n = 1").drop("_n")

    bare = calls.where("enclosing IS NULL").withColumn("_name", F.col("callee")).join(only(F.substring_index("name", ".", -1)), ["file", "_name"])
    own = calls.where("enclosing IS NOT NULL").withColumn("_name", F.concat_ws(".", "enclosing", "callee")).join(only(F.col("name")), ["file", "_name"])
    return bare.unionByName(own).select(*_edge("static_calls", "caller", "node")).distinct()


def heritage_edges(classes: DataFrame, heritage: DataFrame) -> DataFrame:
    """extends and implements to classes of the same file. classes: file, name, node; heritage: file, node, relation, target."""
    targets = classes.select("file", F.col("name").alias("target"), F.col("node").alias("dst"))
    wanted = heritage.select("file", "target", F.col("relation").alias("kind"), F.col("node").alias("src"))
    return pairs_once(wanted, targets, ["file", "target"]).select("kind", "src", "dst")


def access_edges(accesses: DataFrame) -> DataFrame:
    """One edge for each method, class and direction, with the member names in the order they first occur. accesses: method, class, direction, member, position."""
    first = accesses.groupBy("method", "class", "direction", "member").agg(F.min("position").alias("_at"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("_at", "member"))), lambda x: x["member"])
    return first.groupBy("direction", "method", "class").agg(members.alias("members")).select(F.col("direction").alias("kind"), F.col("method").alias("src"), F.col("class").alias("dst"), "members")


def override_edges(methods: DataFrame) -> DataFrame:
    """Methods of an implementation to the trait's default of the same name and file. methods: file, owner, simple, node, trait, trait_default."""
    defaults = methods.where("trait_default").select("file", F.col("owner").alias("trait"), "simple", F.col("node").alias("dst"))
    own = methods.where("trait IS NOT NULL").select("file", "trait", "simple", F.col("node").alias("src"))
    return pairs_once(own, defaults, ["file", "trait", "simple"]).select(F.lit("overrides").alias("kind"), "src", "dst")


def contains_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_node_id IS NOT NULL").select(*_edge("contains", "parent_node_id", "node_id"))


def method_blocks(methods: DataFrame, threshold: int = 80) -> DataFrame:
    """Entry and exit block of methods with more logical lines than the threshold, parted in the middle. methods: node_id, body, start_line, end_line."""
    bare = F.regexp_replace("body", r"/\*[\s\S]*?(?:\*/|\z)|(?://|#)[^\n]*", "")
    logical = F.size(F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != ""))
    lines = F.size(F.split("body", "\n"))
    rows = methods.withColumn("_mid", F.greatest(F.lit(1), F.floor(lines / 2))).withColumn("_base", F.when(F.col("start_line") > 0, F.col("start_line")).otherwise(1)).withColumn("_lines", lines).where(logical > threshold)
    last = F.when(F.col("end_line") > 0, F.col("end_line")).otherwise(F.col("_base") + F.col("_lines") - 1)
    block = lambda n, kind, a, b: F.struct(F.lit(n).alias("ordinal"), F.lit(kind).alias("kind"), a.cast("long").alias("start_line"), b.cast("long").alias("end_line"))
    both = F.array(block(0, "entry", F.col("_base"), F.col("_base") + F.col("_mid") - 1), block(1, "exit", F.col("_base") + F.col("_mid"), last))
    return rows.select("node_id", F.explode(both).alias("b")).select("node_id", "b.*")
