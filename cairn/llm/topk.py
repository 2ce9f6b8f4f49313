"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

Vectors become integers floor(scale * x). For bounds they are turned by an orthogonal basis (directions of
decreasing energy, from a bounded sample), which changes no inner product but gathers it in the first
components. Their components are put into segments, coarse to fine down to pairs. With means m and
deviations d of the segments (each of length n), the squared distance of q and x is at least the sum over
segments of n * ((mq - mx)^2 + (dq - dx)^2); in terms of the inner product
(|q|^2 + |x|^2 - distance^2) / 2 it is at most the sum of n * (mq * mx + dq * dx).

1. Rows go to the group of their nearest pivot (a sampled row), and groups in blocks of at most about
   ROW_BLOCK rows by a hash, so that no block is hot. A group has the range of each segment's mean and the
   largest deviation.
2. A query knows the score of its k-th best in the sample, which its result must reach. It is sent only to
   blocks of groups whose range can reach it; rows are not copied, but for one copy for every QUERY_CHUNK
   queries.
3. In a block, levels are applied coarse to fine; what a level leaves is bounded by the next, the most
   promising raise the bar, and survivors of the finest get exact integer scores. The k best of each block
   meet in one ranking by query.

Where vectors have no structure (directions of equal energy), coarse levels remove little and the finest
does the work; the share removed is what ``pruned`` tells.

Bounds: the sample has at most SAMPLE rows and SAMPLE_BYTES, and there are at most PIVOTS groups; their
statistics are what is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part; a vector that is
shorter than others (an empty one too) has zeros behind; repeated vectors are ranked by id; rows with a
null id take no part; scores must fit 64 bits; with fewer than k candidates all are returned; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.common import cut

ROW_BLOCK, QUERY_BATCH, QUERY_CHUNK = 16_384, 128, 262_144
BLOCK_BYTES = 64 << 20  # of one block's components
SAMPLE, SAMPLE_BYTES, PIVOTS = 4096, 32 << 20, 512
_EXACT = float(1 << 53)


def levels(width: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has pairs."""
    finest = max(1, width // 2)
    return sorted({max(1, finest // 8), max(1, finest // 2), finest})


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that their product sums to the bound."""
    edges = np.linspace(0, rows.shape[1], segments + 1).round().astype(int)
    sizes = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / sizes
    spread = np.sqrt(np.maximum(0.0, np.add.reduceat((rows - np.repeat(means, sizes, axis=1)) ** 2, edges[:-1], axis=1) / sizes))
    return np.concatenate([means, spread], axis=1) * np.tile(np.sqrt(sizes), 2)


def basis(sample: np.ndarray) -> np.ndarray:
    """Orthogonal directions of decreasing energy, in columns."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(sample.shape[1])


class Block:
    """Rows with the statistics of every level."""

    def __init__(self, rows: np.ndarray, row_ids: np.ndarray, turn: np.ndarray):
        order = np.argsort(row_ids, kind="stable")
        self.rows, self.ids = rows[order], row_ids[order]
        self.turn, self.levels = turn, levels(rows.shape[1])
        turned = self.rows @ turn
        self.stats = [statistics(turned, s) for s in self.levels]
        self.peak = float(np.abs(rows).max(initial=1.0))
        self.pairs = self.left = 0  # pairs seen, and left for exact scores

    def best(self, queries: np.ndarray, query_ids: np.ndarray, reach: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, row id, score) of the k best of each query among those that reach its bar; equal scores go to the smaller id."""
        peak = max(self.peak, float(np.abs(queries).max(initial=1.0)))
        if peak * peak * self.rows.shape[1] >= _EXACT:
            return self._best_whole(queries, query_ids, k)
        slack = 1e-9 * peak * peak * self.rows.shape[1] + 1e-6  # rounding of the bounds
        own = [statistics(queries @ self.turn, s) for s in self.levels]
        alive = np.arange(len(self.rows))  # rows that some query of the batch still needs
        for level in range(len(self.levels)):
            bound = own[level] @ self.stats[level][alive].T
            bound[query_ids[:, None] == self.ids[alive][None, :]] = -np.inf
            if level == len(self.levels) - 1 and len(alive) > 4 * k:
                lead = np.argpartition(-bound, 4 * k - 1, axis=1)[:, : 4 * k]
                scores = np.einsum("qld,qd->ql", self.rows[alive[lead]], queries)
                scores[np.take_along_axis(bound, lead, axis=1) == -np.inf] = -np.inf
                reach = np.maximum(reach, np.partition(scores, -k, axis=1)[:, -k])
            mask = bound + slack >= reach[:, None]
            mask &= bound > -np.inf
            needed = mask.any(axis=0)
            alive, mask = alive[needed], mask[:, needed]
        self.pairs += len(queries) * len(self.rows)
        self.left += int(mask.sum())
        out: list[tuple[int, int, int]] = []
        dense = len(alive) > k and mask.mean() > 0.05  # then one product costs less than picking survivors apart
        if dense:
            together = queries @ self.rows[alive].T
            together[~mask] = -np.inf
            bar = np.partition(together, -k, axis=1)[:, -k]
            mask &= together >= bar[:, None]
        for i, query in enumerate(queries):
            at = np.flatnonzero(mask[i])
            scores = together[i, at] if dense else self.rows[alive[at]] @ query
            first = np.lexsort((self.ids[alive[at]], -scores))[:k]
            out.extend((int(query_ids[i]), int(self.ids[alive[at[j]]]), int(scores[j])) for j in first)
        return out

    def _best_whole(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Beyond the integers that doubles hold: Python's."""
        out = []
        for i, query in enumerate(queries):
            whole = sorted(((sum(int(a) * int(b) for a, b in zip(query, row, strict=True)), int(x)) for row, x in zip(self.rows, self.ids, strict=True) if x != query_ids[i]), key=lambda x: (-x[0], x[1]))
            out.extend((int(query_ids[i]), row, score) for score, row in whole[:k])
        return out


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: floor(scale * component) of the vectors that take part."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & sound)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of one width, zeros behind."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = offsets - offsets[0]
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        out[i, : b - a] = flat[a:b]
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score. is_query speaks of the column vec_id."""
    spark = df.sparkSession
    rows = quantised(df, scale, id_col, vector_col)
    size = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width, count = max(1, size[0] or 1), size[1]
    at_most = max(k + 1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(at_most).collect()
    sample = np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in taken]).reshape(-1, width)
    turn = basis(sample)
    block_rows = max(16, min(ROW_BLOCK, BLOCK_BYTES // (8 * width)))
    pivots = (sample @ turn)[: max(1, min(PIVOTS, -(-count // block_rows), len(sample)))]
    coarse = levels(width)[0]
    shared = spark.sparkContext.broadcast((turn, pivots, sample, np.array([r["vec_id"] for r in taken], np.int64)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, v, pivot, stats: the statistics of the coarse level."""
        turn, pivots, _, _ = shared.value
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                turned = _matrix(part.column(1), width) @ turn
                stats = statistics(turned, coarse)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((turned @ pivots.T - half).argmax(axis=1).astype(np.int32)), pa.array(list(stats), pa.list_(pa.float64()))], names=["vec_id", "v", "pivot", "stats"])

    placed = cut(rows.mapInArrow(group, "vec_id long, v array<double>, pivot int, stats array<double>"), "topk-rows")
    bounds = [f(F.get("stats", F.lit(i))).alias(f"{n}{i}") for i in range(2 * coarse) for n, f in (("low", F.min), ("high", F.max))]
    ranges = placed.groupBy("pivot").agg(F.count("*").alias("n"), *bounds).orderBy("pivot").collect()  # a row for each of at most PIVOTS groups
    low = np.array([[r[f"low{i}"] for i in range(2 * coarse)] for r in ranges]).reshape(-1, 2 * coarse)
    high = np.array([[r[f"high{i}"] for i in range(2 * coarse)] for r in ranges]).reshape(-1, 2 * coarse)
    parts = [-(-r["n"] // block_rows) for r in ranges]
    names = [r["pivot"] for r in ranges]
    where = spark.sparkContext.broadcast((low, high))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, v, reach, at: the numbers of the groups that a query must see."""
        turn, _, sample, sample_ids = shared.value
        low, high = where.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own, ids = _matrix(part.column(1), width), part.column(0).to_numpy()
                peak = max(float(np.abs(own).max(initial=1.0)), float(np.abs(sample).max(initial=1.0)))
                slack = 1e-9 * peak * peak * width + 1e-6
                scores = own @ sample.T
                scores[ids[:, None] == sample_ids[None, :]] = -np.inf
                reach = np.partition(scores, -k, axis=1)[:, -k] - slack if scores.shape[1] >= k else np.full(len(own), -np.inf)
                stats = statistics(own @ turn, coarse)
                most = np.maximum(stats, 0) @ high.T + np.minimum(stats, 0) @ low.T
                at = [np.flatnonzero(b >= r).astype(np.int32) for b, r in zip(most + slack, reach, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(reach), pa.array(at, pa.list_(pa.int32()))], names=["vec_id", "v", "reach", "at"])

    queries = rows.where(is_query)
    chunks = max(1, -(-queries.count() // QUERY_CHUNK))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i) if values else F.lit(0)
    number = pick(names, F.col("g") + 1)
    sent = queries.mapInArrow(send, "vec_id long, v array<double>, reach double, at array<int>").select("vec_id", "v", "reach", F.explode("at").alias("g"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    sent = sent.select(number.alias("pivot"), F.explode(F.sequence(F.lit(0), pick(parts, F.col("g") + 1) - 1)).alias("part"), chunk.alias("chunk"), F.lit(True).alias("asks"), "vec_id", "v", "reach")
    by_pivot = dict(zip(names, parts, strict=True))
    split = F.pmod(F.xxhash64("vec_id"), pick([by_pivot.get(p, 1) for p in range(max(names, default=0) + 1)], F.col("pivot") + 1)).cast("int")
    held = placed.select("pivot", split.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("reach"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its rows come first, then the queries in a stream."""
        key, block, rows, ids = None, None, [], []
        turn = shared.value[0]
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            marks = np.column_stack([keys, asks])
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a]) != key:
                    key, block, rows, ids = tuple(keys[a]), None, [], []
                part = batch.slice(a, b - a)
                matrix, names = _matrix(part.column(5), width), part.column(4).to_numpy()
                if not asks[a]:
                    rows.append(matrix)
                    ids.append(names)
                    continue
                if block is None and rows:
                    block, rows = Block(np.concatenate(rows), np.concatenate(ids), turn), []
                reach = part.column(6).to_numpy()
                for i in range(0, len(names) if block else 0, QUERY_BATCH):
                    found = block.best(matrix[i : i + QUERY_BATCH], names[i : i + QUERY_BATCH], reach[i : i + QUERY_BATCH], k)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    both = held.unionByName(sent).repartition("pivot", "part", "chunk").sortWithinPartitions("pivot", "part", "chunk", "asks")
    found = both.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
