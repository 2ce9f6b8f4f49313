"""Prefix trie of conversations: every distinct sequence of first turns is a node, with its members and subtree sums.

A conversation may be spliced: its first ``head`` turns are those of another conversation (its base), its own
turns follow after as many of its own. Nodes have names that can be computed anywhere: the sequence's value as
a polynomial over a prime field, with the digests of its turns as coefficients. The value of a piece of a
conversation and its length are enough to continue it, so turns are ordered by ranges of (conversation, turn)
and a conversation may lie on any number of tasks; no step needs a whole conversation in one place.

Tasks combine what they hold into partial tries (node tables) and let go of them at a fixed size. Tables are
merged by node, FAN of them into one a round, until one table is left: members add up, end lists join. An end
list is kept in pieces of 4,096 neighbouring ids, so that no value grows with its node. Sums over subtrees go
bottom-up, over distances of one, two, four and so on: the rounds grow with the logarithm of the depth.

Defined cases: null role or text: empty; null turn: before the others; turns equal in number stand in the
order of their digests, repeated rows count each; rows without a conversation id are left out; a conversation
whose base is absent starts with its own later turns, and one with no turn left is a member of the root; an
empty table has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.common import cut, scratch

PRIME = (1 << 127) - 1
BASE = 0x2F0B_9C5D_71E8_43A6_95D2_1B7C_E03F_684B  # any number of about that size
_INVERSE = pow(BASE, -1, PRIME)
ROOT = 1
HEAD = 8  # turns that a conversation can take from its base, at most
HELD = 50_000  # nodes of a partial trie before a task lets go of it
FAN = 64  # tables that are merged into one in a round
PIECE = 12  # bits of an id within a piece of an end list

_powers = [1]
for _ in range(256):
    _powers.append(_powers[-1] * BASE % PRIME)


def _power(k: int) -> int:
    return _powers[k] if 0 <= k < len(_powers) else pow(BASE, k, PRIME)


def _name(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _value(name: bytes) -> int:
    return int.from_bytes(name, "big")


# --- turns in order, with the values of their prefixes


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, digest, n_bytes): with part (this task), place in the part's piece of the conversation, value after and before, whether the piece ends."""
    part = TaskContext.get().partitionId()
    waiting, conv, place, value = None, None, 0, 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        conv_ids, places, n_bytes, after, before, last = zip(*rows, strict=True)
        columns = [pa.array(conv_ids, pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array(places, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(last, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "n_bytes", "value", "before", "last"])

    for batch in batches:
        out = []
        for own, digest, n_bytes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fresh = waiting is None or own != conv
            if waiting is not None:
                out.append((*waiting, fresh))
            if fresh:
                conv, place, value = own, 0, 0
            before, place = value, place + 1
            value = (value * BASE + int(digest, 16)) % PRIME
            waiting = (own, place, n_bytes, _name(value), _name(before))
        if out:
            yield batch_of(out)
    if waiting is not None:
        yield batch_of([(*waiting, True)])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, place, n_bytes, value, before, last; the texts stay where they are, only their digests are sorted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 31)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")
    return sorted_rows.mapInArrow(_prefixes, "conv_id long, part long, place long, n_bytes long, value binary, before binary, last boolean")


# --- splicing

_PLAN = "conv_id long, shared array<struct<depth: long, node: binary, parent: binary, n_bytes: long, ends: boolean>>, pieces array<struct<part: long, shift: long, start: binary, skip: long, ends_at: long>>"


def _walk(marks: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]], int]:
    """Values (with bytes) after each of the first HEAD turns, from 0; (part, turns before, value before) of each piece; the length."""
    heads, pieces, length, start = [(ROOT, 0)], [], 0, ROOT
    by_part: dict[int, dict[int, dict]] = {}
    for mark in marks:
        by_part.setdefault(mark["part"], {})[mark["place"]] = mark
    for part in sorted(by_part):
        own = by_part[part]
        pieces.append((part, length, start))
        for place in sorted(own):
            if length + place == len(heads) <= HEAD:
                heads.append(((start * _power(place) + _value(own[place]["value"])) % PRIME, own[place]["n_bytes"]))
        most = max(own)
        start, length = (start * _power(most) + _value(own[most]["value"])) % PRIME, length + most
    return heads, pieces, length


def _splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, head, marks, base_marks: the nodes taken from the base, and for each piece of the own turns how its nodes follow."""
    kinds = pa.schema([("conv_id", pa.int64()), ("shared", pa.list_(pa.struct([("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n_bytes", pa.int64()), ("ends", pa.bool_())]))), ("pieces", pa.list_(pa.struct([("part", pa.int64()), ("shift", pa.int64()), ("start", pa.binary()), ("skip", pa.int64()), ("ends_at", pa.int64())])))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            head = row["head"]
            heads, pieces, length = _walk(row["marks"])
            base = _walk(row["base_marks"])[0][: head + 1] if row["base_marks"] else [(ROOT, 0)]
            taken, left = len(base) - 1, max(0, length - head)
            shared = [{"depth": d, "node": _name(base[d][0]), "parent": _name(base[d - 1][0]) if d else None, "n_bytes": base[d][1], "ends": d == taken and not left} for d in range(taken + 1)]
            own = []
            if left:
                change = base[-1][0] - heads[head][0]
                for part, before, start in pieces:
                    own.append({"part": part, "shift": taken - head + before, "start": _name((start + change * _power(before - head)) % PRIME), "skip": head - before, "ends_at": taken + left})
            out.append({"conv_id": row["conv_id"], "shared": shared, "pieces": own})
        yield pa.RecordBatch.from_pylist(out, schema=kinds)


# --- partial tries and their merging

_TABLE = "node binary, chunk long, parent binary, depth long, n_bytes long, n_convs long, first long, ids array<long>, task long"


def _partial_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows into node tables. A row has its node and its parent, or its place in a piece and the piece's start."""
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}
    task = TaskContext.get().partitionId()

    def release() -> Iterator[pa.RecordBatch]:
        rows = [(node, None, *x, None) for node, x in nodes.items()] + [(node, chunk, None, None, None, None, None, ids) for (node, chunk), ids in ends.items()]
        nodes.clear()
        ends.clear()
        for low in range(0, len(rows), 4096):
            columns = list(zip(*rows[low : low + 4096], strict=True))
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(columns[0]), pa.int64())], names=["node", "chunk", "parent", "depth", "n_bytes", "n_convs", "first", "ids", "task"])

    for batch in batches:
        for conv, depth, n_bytes, at_end, node, parent, start, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if start is not None:
                start = _value(start)
                node, parent = _name((start * _power(place) + _value(node)) % PRIME), _name((start * _power(place - 1) + _value(parent)) % PRIME)
            held = nodes.get(node)
            if held is None:
                nodes[node] = [parent, depth, n_bytes, 1, conv]
            else:
                held[3] += 1
                held[4] = min(held[4], conv)
            if at_end:
                ends.setdefault((node, conv >> PIECE), []).append(conv)
        if len(nodes) + len(ends) >= HELD:
            yield from release()
    yield from release()


def _merge(tables: DataFrame) -> DataFrame:
    """FAN tables of a node (or of a piece of its end list) into one."""
    ids = F.array_sort(F.flatten(F.collect_list("ids")))
    merged = [F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.sum("n_convs").alias("n_convs"), F.min("first").alias("first"), ids.alias("ids")]
    return tables.groupBy("node", "chunk", F.expr(f"task div {FAN}").alias("task")).agg(*merged)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of end lists sorted by node and place: the SHA-256 of each list, a piece at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = ",".join(map(str, ids.as_py()))
            if own != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = own, hashlib.sha256(text.encode())
            else:
                sha.update(f",{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def node_table(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """node, chunk, parent, depth, n_bytes (of the last text), n_convs, first (smallest member), ids: the merged table.

    A node has one row without chunk; its end list has rows with chunk and ids only. base and head: expressions
    of conv_id; head is 0 to HEAD.
    """
    if (base is None) != (head is None):
        raise ValueError("base and head go together")
    placed = cut(ordered_turns(turns), "trie-turns")
    marks = placed.where(F.col("last") | (F.col("place") <= HEAD)).groupBy("conv_id").agg(F.collect_list(F.struct("part", "place", "value", "n_bytes")).alias("marks"))
    marks = cut(marks.select("conv_id", "marks", (base if base is not None else F.col("conv_id")).cast("long").alias("base_id"), (head if head is not None else F.lit(0)).cast("long").alias("head")), "trie-marks")
    near = F.filter("marks", lambda x: x["place"] <= HEAD)
    bases = marks.select(F.col("conv_id").alias("base_id"), near.alias("base_marks")).join(marks.select("base_id").distinct(), "base_id", "left_semi")
    plan = cut(marks.join(bases, "base_id", "left").select("conv_id", "head", "marks", "base_marks").mapInArrow(_splice, _PLAN), "trie-plan")
    none = lambda kind: F.lit(None).cast(kind)
    shared = plan.select("conv_id", F.explode("shared").alias("x")).select("conv_id", "x.depth", "x.n_bytes", F.col("x.ends").alias("at_end"), "x.node", "x.parent", none("binary").alias("start"), none("long").alias("place"))
    pieces = plan.select("conv_id", F.explode("pieces").alias("x")).select("conv_id", "x.*")
    depth = F.col("place") + F.col("shift")
    own = placed.join(pieces, ["conv_id", "part"]).where("place > skip").select("conv_id", depth.alias("depth"), "n_bytes", (depth == F.col("ends_at")).alias("at_end"), F.col("value").alias("node"), F.col("before").alias("parent"), "start", "place")
    tables = cut(own.unionByName(shared).mapInArrow(_partial_trie, _TABLE), "trie-tables")
    left = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tables, left = _merge(tables), -(-left // FAN)
        if left <= 1:
            return tables.drop("task")
        tables = cut(tables, "trie-tables")


def rollup(nodes: DataFrame) -> DataFrame:
    """node, n_children, n_leaves, saved_tokens; nodes: node, parent, depth, n_bytes, n_convs.

    After round k a node holds the sums over what lies less than 2**k below it, and the name of the node 2**k
    above it. Sums are combined before the shuffle, so a node with very many children costs a row a task.
    """
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    up = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    up = cut(up.select("node", "depth", F.col("parent").alias("above"), "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")), "trie-sums")
    deepest, step = up.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        below = up.where("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        # Only what lies 2 * step deep or more has a node that high above; the root is never looked up.
        further = up.where(F.col("depth") >= 2 * step).select("node", F.col("above").alias("half"))
        higher = further.join(up.where(F.col("depth") >= step).select(F.col("node").alias("half"), "above"), "half").select("node", "above")
        sums = up.drop("above").join(below, "node", "left").join(higher, "node", "left")
        up = cut(sums.select("node", "depth", "above", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "trie-sums")
        step *= 2
    return up.select("node", "n_children", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent.

    saved_tokens: bytes of text that need not be read again where members share a node, over the subtree.
    """
    with scratch(turns.sparkSession) as keep:
        merged = cut(node_table(turns, base, head), "trie-merged")
        nodes = merged.where("chunk IS NULL").drop("chunk", "ids")
        pieces = merged.where("chunk IS NOT NULL").select("node", "chunk", "ids")
        ends = pieces.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")
        above = nodes.select(F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
        top = F.broadcast(nodes.where("depth = 0").select(F.col("first").alias("top")))  # one row
        parents = nodes.where("depth > 1").select("node", "parent").join(above, "parent").select("node", "parent_conv_id")
        rows = nodes.join(rollup(nodes), "node").join(ends, "node", "left").join(parents, "node", "left").crossJoin(top)
        none = hashlib.sha256().hexdigest()
        out = rows.select(
            F.col("first").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
            "node",
            "parent",
        )
        return keep(out, "trie")
