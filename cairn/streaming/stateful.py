"""Keyed state with timers and times to live: children that wait for a late parent, rolling windows of idle keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairn.operators.ordered import RollingOrder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(times: pd.Series) -> pd.Series:
    return pd.to_datetime(times, utc=True).astype("datetime64[us, UTC]").astype("int64")


def _roles(spans: DataFrame) -> DataFrame:
    """Each span under its own name (as a parent) and under its parent's (as a child)."""
    both = F.array(
        F.struct(F.col("span_id").alias("link"), F.lit(False).alias("child")),
        F.struct(F.col("parent_span_id").alias("link"), F.lit(True).alias("child")),
    )
    rows = spans.select("trace_id", "span_id", "started_at", "method", "duration_ms", F.explode(both).alias("x"))
    return rows.select("trace_id", F.col("x.link").alias("link"), F.col("x.child").alias("child"), "span_id", "started_at", "method", "duration_ms").where("link IS NOT NULL")


def decide(children: dict, parent: int | None, ttl: int, now: int) -> tuple[list, list, list[int]]:
    """(with the parent, alone, times at which to decide again) of waiting children {span: time}; times in microseconds.

    A child is kept for ttl; a sibling that comes meanwhile, or the parent, renews that. So children before the
    parent are its own if no gap above ttl lies between, and children after it for ttl. now: nothing that is
    older comes any more.
    """
    matched, alone, again = [], [], []
    order = sorted(children, key=lambda s: (children[s], str(s)))
    runs: list[list] = []
    for span in order:
        at = children[span]
        if parent is not None and at >= parent:
            (matched if at - parent <= ttl else alone).append(span)
        elif runs and at - children[runs[-1][-1]] <= ttl:
            runs[-1].append(span)
        else:
            runs.append([span])
    for run in runs:
        end = children[run[-1]]
        if parent is not None and parent - end <= ttl:
            matched += run
            continue
        due = end + ttl if parent is None else min(end + ttl, parent)
        if now > due:
            alone += run
        else:
            again.append(due)
    return matched, alone, again


BUCKETS = 512  # keys of the state: a link's own would be as many calls into the state store as there are spans


class _LateParents(StatefulProcessor):
    """State of a bucket of links: the parents that have come, and the children that wait, in one list; a timer for the first of them that is due."""

    def __init__(self, ttl: int, fields: str, columns: list[str]):
        self.ttl, self.fields, self.columns = ttl, fields, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)

    def _settle(self, fresh: Iterator[tuple], now: int) -> pd.DataFrame:
        """What can be said now of the children of the bucket, with fresh rows (trace, link, child, span, at, method, duration) added."""
        parents, children = {}, {}
        for trace, link, child, span, at, method, duration in chain(self.held.get() if self.held.exists() else (), fresh):
            if child:
                children.setdefault((trace, link), {})[span] = (at, method, duration)
            elif (trace, link) not in parents or (at, method) < parents[trace, link]:
                parents[trace, link] = (at, method)
        rows, kept, due, waited = [], [], [], set()
        for key, held in children.items():
            parent = parents.get(key)
            matched, alone, again = decide({s: v[0] for s, v in held.items()}, parent[0] if parent else None, self.ttl, now)
            mine = set(matched)
            for span in [*matched, *alone]:
                at, method, duration = held.pop(span)
                caller = parent[1] if span in mine and parent[1] != method else None
                rows.append((key[0], span, at, method, duration, caller, caller is None))
            kept += [(*key, True, span, *value) for span, value in held.items()]
            if again:
                due += again
                waited.add(key)
        for key, (at, method) in parents.items():
            if now <= at + self.ttl or key in waited:
                kept.append((*key, False, None, at, method, None))
            if now <= at + self.ttl:
                due.append(at + self.ttl)
        if kept:
            self.held.put(kept)
        else:
            self.held.clear()
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        out = pd.DataFrame(rows, columns=self.columns)
        out["started_at"] = pd.to_datetime(out["started_at"].astype("int64"), unit="us")
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        def fresh() -> Iterator[tuple]:
            for frame in rows:
                durations = [None if pd.isna(d) else float(d) for d in frame["duration_ms"]]
                yield from zip(*(frame[c].tolist() for c in ("trace_id", "link", "child", "span_id")), _micros(frame["started_at"]).tolist(), frame["method"].tolist(), durations, strict=True)

        yield self._settle(fresh(), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(iter(()), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)


_CALLS = ["trace_id", "span_id", "started_at", "method", "duration_ms", "caller", "solo"]


def late_parents(spans: DataFrame, ttl_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Each span of a stream with its caller, as soon as the parent is there, or solo when no parent can come.

    spans: trace_id, span_id, parent_span_id (null: a root, solo at once), started_at (timestamp), method,
    duration_ms. Links (a span and its children) are dealt to BUCKETS by hash, so a trace of any size is spread
    out, and a bucket's state is read and written once a batch. Solo rows come by timer, ttl after the last sibling; delay: how far arrival may be out of order. A call of a method by itself is solo.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = f"trace_id {kinds['trace_id']}, span_id {kinds['span_id']}, started_at timestamp, method string, duration_ms double, caller string, solo boolean"
    marked = spans.withWatermark("started_at", delay)
    fields = f"trace_id {kinds['trace_id']}, link {kinds['span_id']}, child boolean, span_id {kinds['span_id']}, at long, method string, duration_ms double"
    processor = _LateParents(ttl_seconds * 1_000_000, fields, _CALLS)
    linked = _roles(marked).withColumn("bucket", F.pmod(F.xxhash64("trace_id", "link"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    roots = marked.where("parent_span_id IS NULL").select(*_CALLS[:5], F.lit(None).cast("string").alias("caller"), F.lit(True).alias("solo"))
    return linked.unionByName(roots)


def late_parents_batch(spans: DataFrame, ttl_seconds: int) -> DataFrame:
    """The same of a stored table: gaps between siblings and parent by a window over each link."""
    rows = _roles(spans)
    parents = rows.where(~F.col("child")).groupBy("trace_id", "link").agg(F.min(F.struct("started_at", "method")).alias("p"))
    children = rows.where("child").join(parents, ["trace_id", "link"], "left").withColumn("before", F.coalesce(F.col("started_at") < F.col("p.started_at"), F.lit(False)))
    ahead = Window.partitionBy("trace_id", "link", "before").orderBy("started_at", "span_id")
    seconds = lambda c: c.cast("timestamp").cast("decimal(20, 6)")
    following = F.coalesce(F.lead("started_at").over(ahead), F.col("p.started_at"))
    broken = F.sum((seconds(following) - seconds(F.col("started_at")) > ttl_seconds).cast("int")).over(ahead.rowsBetween(0, Window.unboundedFollowing))
    fits = F.col("p").isNotNull() & F.when(F.col("before"), broken == 0).otherwise(seconds(F.col("started_at")) - seconds(F.col("p.started_at")) <= ttl_seconds)
    caller = F.when(fits & (F.col("p.method") != F.col("method")), F.col("p.method"))
    linked = children.select(*_CALLS[:5], caller.alias("caller"), caller.isNull().alias("solo"))
    roots = spans.where("parent_span_id IS NULL").select(*_CALLS[:5], F.lit(None).cast("string").alias("caller"), F.lit(True).alias("solo"))
    return linked.unionByName(roots)


# --- rolling windows


class _Rolling(StatefulProcessor):
    """State of a key: its last values (a list), and the time of its newest span; a timer forgets both."""

    def __init__(self, key: str, size: int, shares: dict[str, float], ttl: int):
        self.key, self.size, self.shares, self.ttl = key, size, shares, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "value double")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = RollingOrder(self.size, [v[0] for v in self.last.get()] if self.last.exists() else [])
        frame = pd.concat(list(rows)).sort_values(["started_at", "span_id"])
        out = []
        for span, value in zip(frame["span_id"], frame["duration_ms"], strict=True):
            window.add(None if pd.isna(value) else float(value))
            out.append((key[0], span, len(window.sorted), *[window.at(s) for s in self.shares.values()]))
        self.last.put([(v,) for v in window.last])
        newest = max(_micros(frame["started_at"]).max() // 1000, self.newest.get()[0] if self.newest.exists() else 0)
        self.newest.update((int(newest),))
        self.handle.registerTimer(int(newest) + self.ttl)
        yield pd.DataFrame(out, columns=[self.key, "span_id", "n", *self.shares])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self.newest.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.newest.clear()
        return iter([])


def rolling(spans: DataFrame, key: str, size: int = 256, ttl_seconds: int = 7 * 86400, delay: str = "1 hour", **shares: float) -> DataFrame:
    """key, span_id, n and order statistics (p50 and p95 if none are named) over the last ``size`` durations of the key, after each span, in the order of arrival.

    State of a key: its last durations, never more than size, in RocksDB; a key is forgotten once event time
    (less delay) is ttl_seconds past its newest span. The window stays sorted as values come and go.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    shares = shares or {"p50": 0.5, "p95": 0.95}
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = f"{key} {kinds[key]}, span_id {kinds['span_id']}, n long, {', '.join(f'{s} double' for s in shares)}"
    narrow = spans.select(key, "span_id", "started_at", "duration_ms").withWatermark("started_at", delay)
    return narrow.groupBy(key).transformWithStateInPandas(_Rolling(key, size, shares, ttl_seconds * 1000), outputStructType=schema, outputMode="Append", timeMode="EventTime")
