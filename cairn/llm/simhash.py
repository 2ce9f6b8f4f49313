"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: lower-cased (A-Z) words, shingles of ``width`` words, XXH64 with seed 42 of each; a bit is
set if it is set in over half of the hashes.

Links: equal fingerprints are one node. Two fingerprints that differ in at most r bits agree on at least
one of r + 1 blocks of the 64 bits; what is left differs in at most r bits again, so a second cut into
r + 1 blocks gives (r + 1)^2 shards keys for a fingerprint, and every linked pair meets in one of them.
Shards above ``most`` fingerprints are cut again, twice at most; what is above it then is
searched all the same. In each shard
a BK-tree (children keyed by their Hamming distance to the parent) is searched along the edges within the
radius. A shard is keyed data and goes to one task, instead of a broadcast of all trees: the trees grow
with the corpus, and a broadcast must not. Each shard gives a spanning forest of its links, never all
pairs. Components: alternating large-star and small-star rounds over distinct fingerprints, each round
written to the shared folder.

Defined cases: a null or empty text has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle; copies share a fingerprint; a null id can't be a component's name unless
the component has no other; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.common import cut, likely, scratch
from cairn.operators.graph import components

SEED, BITS = 42, 64
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hash of every shingle, repeats included."""
    words = _words(text.translate(_lower))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 15):  # memory stays bounded for very long texts
        part = hashes[start : start + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            prints = np.fromiter((fingerprint(t.as_py() or b"", width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(work, f"doc_id {df.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """Integers under the Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a new value; its node number."""
        node = len(self.values)
        self.values.append(value)
        self.edges.append({})
        if node:
            at = 0
            while True:
                distance = (self.values[at] ^ value).bit_count()
                below = self.edges[at].get(distance)
                if below is None:
                    self.edges[at][distance] = node
                    break
                at = below
        return node

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Node numbers of the values at most radius away."""
        values, edges = self.values, self.edges
        todo = [0] if values else []
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            low, high = distance - radius, distance + radius
            todo.extend(below for edge, below in edges[at].items() if low <= edge <= high)


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(smaller, larger) pairs that connect what links of at most radius bits connect."""
    tree, root = BKTree(), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in values:
        near = list(tree.within(value, radius))
        node = tree.add(value)
        root.append(node)
        for other in near:
            a, b = find(node), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for node, value in enumerate(values):
        top = find(node)
        least[top] = min(least.get(top, value), value)
    return [(least[find(node)], value) for node, value in enumerate(values) if value != least[find(node)]]



def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Bit numbers dealt into so many consecutive blocks."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _children(paths: list[tuple], free: dict[tuple, list[int]], parts: int) -> list[tuple]:
    """Two more cuts of each path; free gets the bits that stay free."""
    for _ in range(2):
        deeper = []
        for path in paths:
            for k, taken in enumerate(_cuts(free[path], parts)):
                free[(*path, k)] = [b for b in free[path] if b not in set(taken)]
                deeper.append((*path, k))
        paths = deeper
    return paths


def shard_keys(nodes: DataFrame, radius: int, most: int, cuts: int = 3) -> DataFrame:
    """(fp, path, shard): every pair within the radius meets in a shard. Shards above ``most`` are cut again, ``cuts`` times in all.

    path names the blocks taken, shard holds the bits of these blocks.
    """
    spark, parts = nodes.sparkSession, radius + 1
    free = {(): list(range(BITS))}
    name = lambda path: "".join(map(str, path))

    def mask(path: tuple) -> int:
        return _mask([b for b in range(BITS) if b not in set(free[path])])

    def deal(rows: DataFrame, paths: list[tuple]) -> DataFrame:
        """rows (fp, path) to the children of their path: a join with a table of (r + 1)^(2 cuts) masks at most."""
        table = spark.createDataFrame([(name(p[:-2]), name(p), mask(p)) for p in paths], "path string, child string, mask long")
        return rows.join(F.broadcast(table), "path").select("fp", F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("shard"))

    level = _children([()], free, parts)
    first = F.explode(F.array(*[F.struct(F.lit(name(p)).alias("path"), F.col("fp").bitwiseAND(F.lit(mask(p))).alias("shard")) for p in level]))
    keys, out = nodes.select("fp", first.alias("k")).select("fp", "k.path", "k.shard"), None
    for _ in range(cuts - 1):
        keys = cut(keys, "simhash-shards")
        big = cut(keys.groupBy("path", "shard").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n"), "simhash-large")
        names = {r["path"] for r in big.select("path").distinct().collect()}  # names of blocks, as few as the masks
        if not names:
            break
        small, large = keys.join(big, ["path", "shard"], "left_anti"), keys.join(big, ["path", "shard"], "left_semi")
        out = small if out is None else out.unionByName(small)
        level = _children([p for p in level if name(p) in names], free, parts)
        keys = deal(large.select("fp", "path"), level)
    return keys if out is None else out.unionByName(keys)


def links(nodes: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """Distinct links (a, b) that span every component. nodes: distinct column fp."""
    keys = shard_keys(nodes, radius, most)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        values = [v & (2**64 - 1) for v in sorted(set(rows["fp"].tolist()))]
        found = spanning_links(values, radius) if len(values) > 1 else []
        return pd.DataFrame(np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    keys = keys.withColumn("n", F.lit(1))
    paired = keys.groupBy("path", "shard").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.drop("n").join(paired, ["path", "shard"]).groupBy("path", "shard").applyInPandas(search, "a long, b long").distinct()


def near_duplicates(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id: the smallest doc_id that links reach."""
    prints = cut(fingerprints(df, width, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(by_print, "fp").select("doc_id", "fp", shown.alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of df for each component: the one with the smallest id (null last), then the smallest text hash.

    Columns of any names come back as they were; of rows equal in id and text any one stays.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("in"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("in", "id", F.xxhash64("text").alias("hash"), "text")
    texts = rows.select(F.struct(F.col("id").isNull().alias("none"), "id", "hash").alias("name"), "text").groupBy("name").agg(F.min("text").alias("text"))
    named = near_duplicates(texts, width, radius, "name", "text").where("doc_id = component_id").select("doc_id.id", "doc_id.hash").distinct()
    kept = rows.join(named, rows["id"].eqNullSafe(named["id"]) & (rows["hash"] == named["hash"]), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("in.*")


# --- near copies by the words they share

BUCKETS = 1 << 18
PAIRS_A_TASK = 4096  # of one leader, in a group
PARITY = 512


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def rare_prefix(shingles: np.ndarray, seen: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles, so many that two sets with a Jaccard of ``least`` share one of them.

    Sets that share at least ceil(least * n) of their n shingles can't have all of these among the rest;
    this holds for any order that is the same for all sets. seen: counts of hash buckets.
    """
    n = len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1 if len(shingles) else 0
    return shingles[np.lexsort((shingles, seen[(shingles % np.uint64(BUCKETS)).astype(np.int64)]))[:n]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's hashes falls into each of PARITY buckets, as longs. Two sets differ in as many elements at least as their parities in bits."""
    counts = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITY, minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def keep_unlike(df: DataFrame, width: int = 5, least: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df of which no two have a Jaccard of ``least`` or more over shingles of ``width`` words; from each row left out a chain of such pairs leads to one that stays.

    Candidates: what the BK-trees link within the radius, and all texts that share one of their rarest
    shingles (rare_prefix). The latter finds every pair: at a Jaccard of 0.8 about 10 of 64 bits differ and up
    to 16 may, and blocks for 16 bits (17^2 keys of 8 bits) are more work than all pairs. Rarity comes from
    counts of a fixed number of hash buckets.

    Rows that share a shingle are not paired with each other but with the first of them, in the order of their
    ids (null last); a row whose exact Jaccard to it is ``least`` or more goes, at once for all shingles, and
    the first is done. So a group of copies costs a pair a row. What is left, texts that share a rare shingle
    and are unlike, goes on with the next 8, 64, ... of each shingle until none is left. Pairs whose sizes, ranks
    or parities show them to be unlike go before any text is moved: ranks, as a pair also meets at the rarest
    shingle it shares, and no more than what follows there can be shared. Texts meet in groups of one leader and
    at most PAIRS_A_TASK others, as a stream. Columns of any names come back as they were.
    """
    kind = df.schema[id_col].dataType.simpleString()

    @F.pandas_udf("long")
    def name_of(text: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((xxhash.xxh64_intdigest(shingle_set(t, width).tobytes(), SEED) for t in text), np.uint64, len(text)).view(np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(1):
                np.add.at(total, (shingle_set(t.as_py(), width) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])

    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("in"), F.col(f"`{id_col}`").alias("id"), name_of(F.col(f"`{text_col}`").cast("binary")).alias("node"))
    order = F.struct(F.col("id").isNull(), "id", F.xxhash64(F.col(f"in.`{text_col}`")))
    rows = cut(marked.groupBy("node").agg(F.min_by("in", order).alias("in"), F.min("id").alias("id")), "near-rows")
    texts = rows.select("node", F.col(f"in.`{text_col}`").cast("binary").alias("text"), "id")

    seen = np.zeros(BUCKETS, np.int64)
    for r in texts.select("node", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # a fixed number of rows
        seen[r["bucket"]] = r["n"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(t.as_py(), width) for t in part.column(1)]
                found = [rare_prefix(own, seen, least) for own in sets]
                of = np.repeat(np.arange(len(found)), [len(f) for f in found])
                sizes = np.array([len(own) for own in sets], np.int32)
                ranks = np.concatenate([np.arange(1, len(f) + 1, dtype=np.int32) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), part.column(2).take(pa.array(of)), part.column(0).take(pa.array(of)), pa.array(sizes[of]), pa.array(ranks)], names=["shingle", "id", "node", "size", "rank"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, parities = [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py() or b"", width)
                own = np.unique(hashes)
                prints.append(fingerprint_of(hashes))
                sizes.append(len(own))
                parities.append(parity(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(parities, pa.list_(pa.int64()))], names=["node", "id", "fp", "size", "parity"])

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in batches:
            out = []
            for leads, node, text in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                own = shingle_set(text.as_py(), width)
                if leads.as_py():
                    leader = own
                elif min(len(own), len(leader)) >= least * max(len(own), len(leader)) - 1e-9 and jaccard(own, leader) >= least:
                    out.append(node.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["node"])

    def like(pairs: DataFrame) -> DataFrame:
        """node: the b of pairs (a, b) that are near. A leader with many others leads several groups."""
        end = lambda c: prints.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
        apart = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        pairs = pairs.where("a <> b").distinct().join(end("a"), "a").join(end("b"), "b")
        pairs = cut(pairs.where(apart <= (F.col("a_size") + F.col("b_size")) * ((1 - least) / (1 + least)) + 1e-6).select("a", "b"), "near-pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("parts"))
        led = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("leads"), F.col("a").alias("node"))
        other = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(False).alias("leads"), F.col("b").alias("node"))
        wanted = cut(led.unionByName(other), "near-wanted")
        both = wanted.join(likely(texts.select("node", "text"), wanted, ["node"]), "node").select("a", "part", "leads", "node", "text")
        both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))
        return cut(both.mapInArrow(copies, "node long").distinct(), "near-gone")

    line = Window.partitionBy("shingle").orderBy(F.asc_nulls_last("id"), "node")

    def shared(members: DataFrame) -> DataFrame:
        """members of shingles that others have too."""
        met = members.withColumn("met", F.coalesce(F.lag("node").over(line), F.lead("node").over(line)).isNotNull())
        return cut(met.where("met").drop("met"), "near-members")

    with scratch(df.sparkSession) as keep:
        prints = cut(texts.mapInArrow(sketches, f"node long, id {kind}, fp long, size int, parity array<long>"), "fingerprints")
        head = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("head"))
        near = links(head.select("fp"), radius)
        a, b = head.select(F.col("fp").alias("a"), F.col("head").alias("x")), head.select(F.col("fp").alias("b"), F.col("head").alias("y"))
        linked = near.join(a, "a").join(b, "b").select(F.least("x", "y")["node"].alias("a"), F.greatest("x", "y")["node"].alias("b"))
        linked = linked.unionByName(prints.join(head, "fp").select(F.col("head.node").alias("a"), F.col("node").alias("b")))

        members = shared(texts.select("node", "text", "id").mapInArrow(prefixes, f"shingle long, id {kind}, node long, size int, rank int"))
        gone, leaders = None, 1
        while True:
            placed = members.withColumn("at", F.row_number().over(line))
            heads = placed.where(F.col("at") <= leaders).select("shingle", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("rank").alias("a_rank"), F.col("at").alias("a_at"))
            sizes = F.least("size", "a_size") >= F.greatest("size", "a_size") * least - 1e-9
            ranks = F.least(F.col("size") - F.col("rank"), F.col("a_size") - F.col("a_rank")) + 1 >= (F.col("size") + F.col("a_size")) * (least / (1 + least)) - 1e-6
            pairs = placed.join(heads, "shingle").where((F.col("a_at") < F.col("at")) & sizes & ranks).select("a", F.col("node").alias("b"))
            new = like(pairs if gone is not None else pairs.unionByName(linked))
            gone = new if gone is None else gone.unionByName(new)
            members = shared(placed.where(F.col("at") > leaders).drop("at").join(new, "node", "left_anti").select("shingle", "id", "node", "size", "rank"))
            if not members.take(1):
                break
            leaders *= 8
        gone = keep(gone.distinct(), "near-copies")
    return rows.join(gone, "node", "left_anti").select("in.*")
