"""Strong components, longest paths and reach of a directed graph: in one pass where a part of it fits a task, by levels where not.

Of a graph with more than LOCAL_EDGES edges (STRUCTURE_EDGES without reach; counted before), large strong components become one node
each, which keeps their number of nodes: a task finds their cores in a sample, joins give the rest.

A part is a set of whole weak components with as many edges or less. A task numbers its
strong components from the sinks up (Tarjan, 1972), so one walk in that order gives longest paths, and merging
bitmaps of 64 nodes a word from the sinks up gives how many nodes each one reaches. A weak component above the
bound goes through the same steps as joins: colouring, levels of longest paths, words merged by bit_or. At no
point is there a table of (node, node it reaches).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.common import cut
from cairn.operators.ordered import ranges

PACK_EDGES = 200_000  # about so many edges of whole weak components go to a task together
LOCAL_EDGES = 500_000  # of one weak component whose reach a task counts
STRUCTURE_EDGES = 4_000_000  # of one whose components and paths only are asked for: no bitmaps
SAMPLE_EDGES = 4_000_000  # of the sample in which cores of strong components are looked for
CORE_NODES = 64  # the smallest core that becomes one node
BITMAP_WORDS = 1 << 23  # of a task's bitmaps at a time: 64 MB; larger graphs are walked once for each block of nodes


def condense(n: int, start: list[int], to: list[int]) -> tuple[np.ndarray, int]:
    """The strong component of each node, numbered so that edges lead to smaller numbers, and how many there are. start, to: edges by source."""
    number, low, component, at = [0] * n, [0] * n, [-1] * n, list(start[:-1])
    counter = found = 0
    open_nodes: list[int] = []
    for first in range(n):
        if number[first]:
            continue
        path = [first]
        while path:
            v = path[-1]
            if not number[v]:
                counter += 1
                number[v] = low[v] = counter
                open_nodes.append(v)
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif component[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                while component[v] < 0:
                    component[open_nodes.pop()] = found
                found += 1
    return np.array(component, np.int64), found


def reach_counts(component: np.ndarray, found: int, start: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How many nodes each strong component reaches, its own among them. start, to: edges between components by source; weight: how many nodes each stands for."""
    heavy = np.flatnonzero(weight > 1)
    n, counts = len(component), np.zeros(found, np.int64)
    words = max(1, min(-(-n // 64), BITMAP_WORDS // max(found, 1)))
    for low in range(0, n, 64 * words):
        place = np.arange(min(64 * words, n - low), dtype=np.int64)
        bits = np.zeros((found, words), np.uint64)
        np.bitwise_or.at(bits, (component[low + place], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        for c in range(found):
            below = to[start[c] : start[c + 1]]
            if len(below):
                bits[c] |= np.bitwise_or.reduce(bits[below], axis=0)
        counts += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for v in heavy[(heavy >= low) & (heavy < low + len(place))]:
            held = bits[:, (v - low) >> 6] >> np.uint64((v - low) & 63) & np.uint64(1)
            counts += held.astype(np.int64) * (weight[v] - 1)
    return counts


def components_of_codes(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """condense of edges in any order."""
    by_source = np.argsort(s, kind="stable")
    start = np.searchsorted(s[by_source], np.arange(n + 1))
    return condense(n, start.tolist(), d[by_source].tolist())


def survey_codes(s: np.ndarray, d: np.ndarray, n: int, reach: bool, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """root (the smallest member), size, depth, reach of n nodes, by number; s, d: the ends of some edges; weight: how many nodes each stands for."""
    weight = np.ones(n, np.int64) if weight is None else weight
    component, found = components_of_codes(s, d, n)
    between = component[s] != component[d]
    pairs = np.unique(component[s][between] * found + component[d][between])
    to = pairs % found
    start = np.searchsorted(pairs // found, np.arange(found + 1))
    depth = np.zeros(found, np.int64)
    for c in range(found):
        if start[c] < start[c + 1]:
            depth[c] = depth[to[start[c] : start[c + 1]]].max() + 1
    root = np.full(found, n, np.int64)
    np.minimum.at(root, component, np.arange(n))
    size = np.zeros(found, np.int64)
    np.add.at(size, component, weight)
    out = {"root": root[component], "size": size[component], "depth": depth[component]}
    if reach:
        out["reach"] = reach_counts(component, found, start, to, weight)[component] - 1
    return out


def survey_local(src: np.ndarray, dst: np.ndarray, reach: bool) -> pd.DataFrame:
    """node, root (the smallest member), size, depth, reach of the nodes of some edges."""
    names, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    found = survey_codes(ends[: len(src)], ends[len(src) :], len(names), reach)
    return pd.DataFrame({"node": names, "root": names[found["root"]], "size": found["size"], "depth": found["depth"], "reach": found.get("reach")})


def _codes(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The names of a table of edges in order, once each, and its ends as places among them."""
    both = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    names, place = both.dictionary.take(order), np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    ends = place[both.indices.to_numpy()]
    return names, ends[: table.num_rows], ends[table.num_rows :]


def _survey_table(table: pa.Table, reach: bool) -> pa.Table:
    """survey_local of a table of edges; names stay in Arrow. size: how many nodes the source stands for, if the row tells."""
    names, s, d = _codes(table)
    told, weight = table["size"].is_valid().to_numpy(), np.ones(len(names), np.int64)
    weight[s[told]] = table["size"].drop_null().to_numpy()
    found = survey_codes(s, d, len(names), reach, weight)
    held = pa.array(found["reach"]) if reach else pa.nulls(len(names), pa.int64())
    return pa.table({"node": names, "root": names.take(pa.array(found["root"])), "size": found["size"], "depth": found["depth"], "reach": held})


def survey(edges: DataFrame, reach: bool = False, local_edges: int | None = None) -> DataFrame:
    """node, root, size, depth, reach for each node of edges (src, dst: text): its strong component (named by the smallest member) and how
    many nodes that has, the edges on the longest path from it between components, and (if asked) how many other nodes it reaches."""
    links = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "survey-links")
    return survey_links(links, reach, local_edges)


def survey_links(links: DataFrame, reach: bool = False, local_edges: int | None = None) -> DataFrame:
    """survey of whole edges, each once, that are written down."""
    most = (LOCAL_EDGES if reach else STRUCTURE_EDGES) if local_edges is None else local_edges
    total = links.count()
    members = _grown(links, total, most) if total > most else None
    if members is None:
        return _survey_parts(links.withColumn("size", F.lit(None).cast("long")), total, reach, most)
    rest, member = members
    found = cut(_survey_parts(rest, rest.count(), reach, most), "survey-found")
    roots = rest.where("size IS NOT NULL").select(F.col("src").alias("node"))
    cores = found.join(roots, "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("_root"), "size", "depth", "reach")
    inside = member.join(cores, "root").select("node", F.col("_root").alias("root"), "size", "depth", "reach")
    return found.join(roots, "node", "left_anti").unionByName(inside)


def _core(table: pa.Table, least: int) -> pa.Table:
    """node, root of the strong components with least nodes or more, if they hold a quarter of the nodes."""
    names, s, d = _codes(table)
    component, found = components_of_codes(s, d, len(names))
    size, root = np.bincount(component, minlength=found), np.full(found, len(names), np.int64)
    np.minimum.at(root, component, np.arange(len(names)))
    inside = np.flatnonzero(size[component] >= least)
    inside = inside if 4 * len(inside) >= len(names) else inside[:0]
    return pa.table({"node": names.take(pa.array(inside)), "root": names.take(pa.array(root[component[inside]]))})


def _named(links: DataFrame, member: DataFrame) -> DataFrame:
    """links (src, dst, at_src, at_dst: whether that end is a core) whose ends are cores where a member says so, without those inside a core.

    An end that is a core already has most of the links; it is no key of the join, the other end stands for it.
    """
    for end, other in (("src", "dst"), ("dst", "src")):
        at = f"at_{end}"
        key = F.when(F.col(at), F.col(other)).otherwise(F.col(end))
        names = member.select(F.col("node").alias("_key"), F.lit(False).alias(at), F.col("root").alias("_root"))
        links = links.withColumn("_key", key).join(names, ["_key", at], "left")
        links = links.select(F.coalesce("_root", end).alias(end), other, (F.col(at) | F.col("_root").isNotNull()).alias(at), f"at_{other}")
    return links.where("src <> dst").select("src", "dst", "at_src", "at_dst")


def _grown(links: DataFrame, total: int, most: int) -> tuple[DataFrame, DataFrame] | None:
    """Links (src, dst, size) between what is left when large strong components are one node each, and their members (node, root: the
    smallest member); none if there are no large ones. A row from a root to itself tells its size.

    Cores are the strong components of the links among a sample of nodes. A node with a link from a core and one to
    it belongs to it; so cores grow by joins, as long as they grow by a quarter or a fifth of the links goes. What
    belongs to a core by a longer way stays a node of its own, which the survey of the rest puts right.
    """
    least, share = CORE_NODES, min(1.0, math.sqrt(SAMPLE_EDGES / total))
    chosen = lambda c: F.pmod(F.xxhash64(F.lit("core"), c), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = links.where(chosen("src") & chosen("dst")).limit(2 * SAMPLE_EDGES).withColumn("pack", F.lit(0))
    member = cut(sample.groupBy("pack").applyInArrow(lambda table: _core(table, least), "node string, root string"), "survey-core")
    held, found = member.count(), [member]
    if not held:
        return None
    rest = links.select("*", F.lit(False).alias("at_src"), F.lit(False).alias("at_dst"))
    while True:
        rest = cut(_named(rest, member), "survey-rest")
        left = rest.count()
        if left <= most:
            break
        out = rest.where("at_src AND NOT at_dst").select(F.col("dst").alias("node"), F.col("src").alias("root"), F.lit(1).alias("way"))
        back = rest.where("at_dst AND NOT at_src").select(F.col("src").alias("node"), F.col("dst").alias("root"), F.lit(2).alias("way"))
        both = out.unionByName(back).groupBy("node", "root").agg(F.bit_or("way").alias("way")).where("way = 3")
        member = cut(both.groupBy("node").agg(F.min("root").alias("root")), "survey-core")
        new = member.count()
        if not new or (4 * new < held and 5 * left > 4 * total):
            break
        found.append(member)
        held, total = held + new, left
    member = found[0]
    for more in found[1:]:
        member = member.unionByName(more)
    names = cut(member.groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("name"), F.count("*").alias("size")), "survey-names")
    member = member.join(names.select(F.col("_root").alias("root"), "name"), "root").select("node", F.col("name").alias("root"))
    rest = rest.select("src", "dst").distinct()
    for end in ("src", "dst"):
        rest = rest.join(names.select(F.col("_root").alias(end), "name"), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    own = names.select(F.col("name").alias("src"), F.col("name").alias("dst"), "size")
    return cut(rest.select("src", "dst", F.lit(None).cast("long").alias("size")).unionByName(own), "survey-links"), member


def _survey_parts(links: DataFrame, total: int, reach: bool, most: int) -> DataFrame:
    """survey of links (src, dst, size); size, in rows from a node to itself: how many nodes it stands for, one where none tells."""
    from cairn.operators.graph import components

    schema = "node string, root string, size long, depth long, reach long"

    def run(table: pa.Table) -> pa.Table:
        return _survey_table(table, reach)

    if total <= most:
        return links.withColumn("pack", F.lit(0)).groupBy("pack").applyInArrow(run, schema)
    weak = components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = cut(links.join(weak.select(F.col("node").alias("src"), F.col("root").alias("weak")), "src", "left").withColumn("weak", F.coalesce("weak", "src")), "survey-placed")
    large = placed.groupBy("weak").agg(F.count("*").alias("n")).where(F.col("n") > most).select("weak")
    large = cut(large, "survey-large")
    packs = math.ceil(total / max(min(most, PACK_EDGES), 1))
    small = placed.join(large, "weak", "left_anti").withColumn("pack", F.pmod(F.xxhash64("weak"), F.lit(packs)))
    out = small.groupBy("pack").applyInArrow(run, schema)
    wide = placed.join(large, "weak", "left_semi").select("src", "dst", "size")
    return out.unionByName(_survey_wide(wide, reach)) if large.take(1) else out


def _survey_wide(links: DataFrame, reach: bool) -> DataFrame:
    from cairn.operators.graph import coloured_components, levels

    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    nodes = nodes.join(links.where("size IS NOT NULL").select(F.col("src").alias("node"), F.col("size").alias("own")), "node", "left").withColumn("own", F.coalesce("own", F.lit(1).cast("long")))
    coloured = coloured_components(links).withColumnRenamed("root", "colour").join(nodes, "node")
    named = coloured.groupBy("colour").agg(F.min("node").alias("root"), F.sum("own").alias("size"))
    found = coloured.join(named, "colour").select("node", "root", "size")
    found = cut(nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("size", "own").alias("size")), "survey-roots")
    end = lambda c, name: found.select(F.col("node").alias(c), F.col("root").alias(name))
    dag = cut(links.join(end("src", "s"), "src").join(end("dst", "d"), "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct(), "survey-dag")
    depth = cut(levels(found.select(F.col("root").alias("node")).distinct(), dag).withColumnRenamed("node", "root"), "survey-depth")
    out = found.join(depth.withColumn("depth", F.col("depth").cast("long")), "root")
    if not reach:
        return out.select("node", "root", "size", "depth", F.lit(None).cast("long").alias("reach"))
    # a bit for each strong component; those of a word that have different sizes lie in words of their own
    place = ranges(found.select("root", "size").distinct(), ["size"], ["root"], "survey-bits")
    word = F.struct("size", F.shiftleft(F.col("_part").cast("long"), 40).bitwiseOR(F.shiftright("_at", 6)).alias("place"))
    own = cut(place.select("root", word.alias("word"), F.expr("shiftleft(1L, CAST(_at & 63 AS INT))").alias("bits")).join(depth, "root"), "survey-own")
    done = own.where("depth = 0").select("root", "word", "bits")
    deepest = depth.agg(F.max("depth")).first()[0] or 0
    for level in range(1, deepest + 1):
        below = dag.join(depth.where(F.col("depth") == level).select(F.col("root").alias("src")), "src", "left_semi")
        reached = below.join(done.withColumnRenamed("root", "dst"), "dst").select(F.col("src").alias("root"), "word", "bits")
        step = reached.unionByName(own.where(F.col("depth") == level).select("root", "word", "bits")).groupBy("root", "word").agg(F.bit_or("bits").alias("bits"))
        done = done.unionByName(cut(step, "survey-reach"))
    counts = done.groupBy("root").agg((F.sum(F.bit_count("bits") * F.col("word.size")) - 1).cast("long").alias("reach"))
    return out.join(counts, "root").select("node", "root", "size", "depth", "reach")
