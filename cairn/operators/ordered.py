"""Order within keys without a task that holds a key: ranges of (key, order), counts by range, prefix sums.

Rows are dealt by ranges of the keys and the order, so a key that holds a large part of the rows lies in as many
ranges as it needs. What is known of a range (how many rows of which key) is one row a key and range; sums over
those place each range within its key.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cairn.operators.common import cut, value_counts


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ranges") -> DataFrame:
    """df with _part, the range of a row, and _at, its place there (from 0); written down, so that both stay as they are."""
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), name)


# --- order statistics


def order_statistics(counted: DataFrame, keys: Sequence[str], nearest: bool = False, **shares: float) -> DataFrame:
    """keys, n, mean and one column for each share, from counts of values (keys, _v, _n), which may repeat.

    Linear: the value at share * (n - 1), interpolated between its neighbours; nearest: the value at
    ceil(share * n), no mean. The ranks that are asked for are looked up among the counts of ranges, so only
    the ranges that hold one are read again.
    """
    names = list(shares)
    held = ranges(counted.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n")), keys, ["_v"], "ranks").drop("_at")
    sums = [] if nearest else [F.sum(F.col("_v") * F.col("_n")).alias("_s")]
    parts = held.groupBy(*keys, "_part").agg(F.sum("_n").alias("_rows"), *sums)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mean = F.lit(None).cast("double") if nearest else F.sum("_s").over(whole) / F.sum("_rows").over(whole)
    parts = parts.select("*", before.alias("_before"), F.sum("_rows").over(whole).alias("_all"), mean.alias("_mean"))
    if nearest:
        at = [F.greatest(F.lit(1), F.ceil(F.lit(float(shares[s])) * F.col("_all"))) - 1 for s in names]
        wanted = [F.least(a, F.col("_all") - 1) for a in at]
    else:
        low = [F.floor(F.lit(float(shares[s])) * (F.col("_all") - 1)) for s in names]
        wanted = [x for a in low for x in (a, F.least(a + 1, F.col("_all") - 1))]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), w.cast("long").alias("rank")) for i, w in enumerate(wanted)])
    here = F.filter(slots, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_rows")))
    parts = parts.select(*keys, "_part", "_before", "_all", "_mean", here.alias("_wanted"))
    found = join_keys(held, parts.where(F.size("_wanted") > 0), [*keys, "_part"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v"))
    found = found.select(*keys, "_v", "_n", "_all", "_mean", "_wanted", upto.alias("_upto"))
    mine = F.filter("_wanted", lambda x: (x["rank"] >= F.col("_upto") - F.col("_n")) & (x["rank"] < F.col("_upto")))
    picks = [F.max(F.when(F.col("_x.slot") == i, F.col("_v"))).alias(f"_p{i}") for i in range(len(wanted))]
    rows = found.select(*keys, "_v", "_all", "_mean", F.explode(mine).alias("_x")).groupBy(*keys).agg(F.first("_all").alias("n"), F.first("_mean").alias("mean"), *picks)
    if not keys:
        rows = rows.where("n IS NOT NULL")  # no values at all
    if nearest:
        return rows.select(*keys, "n", *[F.col(f"_p{i}").alias(s) for i, s in enumerate(names)])
    return rows.select(*keys, "n", "mean", *[_between(shares[s], F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}")).alias(s) for i, s in enumerate(names)])


def _between(share: float, low: Column, high: Column) -> Column:
    at = F.lit(float(share)) * (F.col("n") - 1)
    below = F.floor(at)
    return F.when(low == high, low).otherwise((below + 1 - at) * low + (at - below) * high)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which nulls are equal to nulls; without keys, right is one row, which is broadcast."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = None
    for k in keys:
        step = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        same = step if same is None else same & step
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, **shares: float) -> DataFrame:
    """keys, n, mean and exact percentiles by linear interpolation, one for each named share. Nulls do not count."""
    return order_statistics(value_counts(df, keys, value), keys, **shares)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, **shares: float) -> DataFrame:
    """Order statistics at ceil(share * n): keys, n and one column for each share."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return order_statistics(counted, keys, nearest=True, **shares)


# --- windows of rows


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """df with _part and _own: each range's rows, and (not _own) the size - 1 rows of its first key that come before it.

    What precedes a range lies in the ends of the ranges before it; only keys that go on over a border have
    any, two a range at most.
    """
    held = ranges(df, keys, order, "halo")
    held = held.withColumnRenamed("_at", "_place")
    pieces = held.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    by_key = Window.partitionBy(*keys)
    start = F.coalesce(F.sum("_rows").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("*", F.count("*").over(by_key).alias("_pieces"), start.alias("_start")).where("_pieces > 1")
    # Of the pieces that follow, those nearer than size rows (each has one row at least).
    ahead = F.collect_list(F.struct(F.col("_part").alias("to"), F.col("_start").alias("at"))).over(by_key.orderBy("_part").rowsBetween(1, size - 1))
    pieces = pieces.withColumn("_ahead", ahead).select(*keys, "_part", "_first", "_start", F.explode(F.filter("_ahead", lambda x: x["at"] - (size - 1) < F.col("_start") + F.col("_rows"))).alias("_x"))
    pieces = pieces.select(*keys, "_part", (F.col("_x.at") - (size - 1) - F.col("_start") + F.col("_first")).alias("_from"), F.col("_x.to").alias("_to"))
    tails = join_keys(held, pieces, [*keys, "_part"]).where("_place >= _from").withColumn("_part", F.col("_to"))
    columns = [*df.columns, "_part"]
    return held.select(*columns, F.lit(True).alias("_own")).unionByName(tails.select(*columns, F.lit(False).alias("_own")))


class RollingOrder:
    """The last values in the order of arrival and in the order of size; None takes a place but has no size."""

    def __init__(self, size: int, values: Sequence[float | None] = ()):
        self.size, self.last, self.sorted = size, deque(values), sorted(v for v in values if v is not None)

    def add(self, value: float | None) -> None:
        if len(self.last) == self.size:
            gone = self.last.popleft()
            if gone is not None:
                del self.sorted[bisect_left(self.sorted, gone)]
        self.last.append(value)
        if value is not None:
            insort(self.sorted, value)

    def at(self, share: float) -> float | None:
        """The value at ceil(share * n), the first at least."""
        n = len(self.sorted)
        return self.sorted[max(1, math.ceil(share * n)) - 1] if n else None


def rolling_quantiles(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 256, **shares: float) -> DataFrame:
    """df with window_n and order statistics of the last ``size`` rows of the key after each row; null values are in no statistic."""
    rows = with_halo(df.withColumn("_value", F.col(value).cast("double")), [key], order, size)
    names, asked = list(shares), [float(s) for s in shares.values()]
    columns = df.columns

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, window = None, RollingOrder(size)
        for batch in batches:
            part, own, names_, values = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_part", "_own", key, "_value"))
            counts, stats = [], [[] for _ in asked]
            for p, mine, k, v in zip(part, own, names_, values, strict=True):
                if piece != (p, k):
                    piece, window = (p, k), RollingOrder(size)
                window.add(v)
                if mine:
                    counts.append(len(window.sorted))
                    for out, share in zip(stats, asked, strict=True):
                        out.append(window.at(share))
            kept = batch.filter(batch.column(batch.schema.get_field_index("_own")))
            yield pa.RecordBatch.from_arrays([*[kept.column(kept.schema.get_field_index(c)) for c in columns], pa.array(counts, pa.int64()), *[pa.array(x, pa.float64()) for x in stats]], names=[*columns, "window_n", *names])

    schema = StructType([*df.schema.fields, StructField("window_n", LongType()), *[StructField(s, DoubleType()) for s in names]])
    dealt = rows.repartition("_part").sortWithinPartitions("_part", key, *order, "_own")
    return dealt.mapInArrow(roll, schema)


# --- intervals


def narrowest(points: DataFrame, id_col: str, intervals: DataFrame, keys: Sequence[str], line: str = "line", node: str = "node_id") -> DataFrame:
    """id_col, node: the shortest interval (start_line to end_line; ties: the smaller node) that holds the point's line; points without one are left out.

    A sweep: starts and points are sorted by line, and of the open intervals a heap has the shortest on top. An
    interval is one row however long it is, and one more for each further range of its key that it reaches into.
    """
    none = lambda kind: F.lit(None).cast(kind)
    id_type, node_type = points.schema[id_col].dataType, intervals.schema[node].dataType
    starts = intervals.where("start_line <= end_line").select(*keys, F.col("start_line").cast("long").alias("_line"), F.lit(0).alias("_kind"), F.col("end_line").cast("long").alias("_end"), F.col("start_line").cast("long").alias("_start"), F.col(node).alias("_node"), none(id_type).alias("_id"))
    asked = points.where(F.col(line).isNotNull()).select(*keys, F.col(line).cast("long").alias("_line"), F.lit(1).alias("_kind"), none("long").alias("_end"), none("long").alias("_start"), none(node_type).alias("_node"), F.col(id_col).alias("_id"))
    known = [F.col(k).isNotNull() for k in keys]
    rows = starts.unionByName(asked)
    for k in known:
        rows = rows.where(k)
    held = ranges(rows, keys, ["_line", "_kind"], "sweep").drop("_at")
    pieces = held.groupBy(*keys, "_part").agg(F.min("_line").alias("_first"))
    following = Window.partitionBy(*keys).orderBy("_part")
    pieces = cut(pieces.withColumn("_next", F.lead("_first").over(following)), "sweep-pieces")
    reaching = held.where("_kind = 0").join(pieces.where("_next IS NOT NULL").select(*keys, "_part", "_next"), [*keys, "_part"]).where("_end >= _next").drop("_next")
    later = pieces.select(*keys, F.col("_part").alias("_to"), "_first")
    carried = reaching.join(later, list(keys)).where("_to > _part AND _first <= _end").withColumn("_part", F.col("_to")).withColumn("_line", F.col("_first")).drop("_to", "_first")
    columns = [*keys, "_kind", "_line", "_end", "_start", "_node", "_id", "_part"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, heap = None, []
        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(len(keys))]
            own = list(zip(batch.column(len(columns) - 1).to_pylist(), *names, strict=True))
            ids, nodes = [], []
            for here, kind, at, end, start, name, point in zip(own, *(batch.column(len(keys) + i).to_pylist() for i in range(6)), strict=True):
                if here != piece:
                    piece, heap = here, []
                if kind == 0:
                    heappush(heap, (end - start, name, end))
                    continue
                while heap and heap[0][2] < at:
                    heappop(heap)
                if heap:
                    ids.append(point)
                    nodes.append(heap[0][1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("_id").type), pa.array(nodes, batch.schema.field("_node").type)], names=[id_col, node])

    both = held.select(*columns).unionByName(carried.select(*columns))
    schema = StructType([StructField(id_col, id_type), StructField(node, node_type)])
    return both.repartition("_part").sortWithinPartitions("_part", *keys, "_line", "_kind").mapInArrow(sweep, schema)
