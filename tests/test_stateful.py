"""Late parents and rolling windows by keyed state, under shuffled arrival."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.streaming import stateful as K
from cairn.streaming.spans import drain

FIELDS = "trace_id long, span_id long, parent_span_id long, started_at timestamp, method string, duration_ms double"


def arriving(spark, folder, rows, batches, seed):
    """The rows as a stream of files, in an order that has nothing to do with their times."""
    rng = random.Random(seed)
    rows = rng.sample(rows, len(rows))
    frame = lambda part: spark.createDataFrame([(t, s, p, at, m, d) for t, s, p, at, m, d in part], FIELDS.replace("timestamp", "long")).withColumn("started_at", F.timestamp_micros("started_at"))
    for n in range(batches):
        frame(rows[n::batches]).coalesce(1).write.mode("append").parquet(folder)
    # A span that is far ahead of all comes last, so that every timer runs.
    frame([(-1, -1, None, 2 * 10**15, "end", 0.0)]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_waiting_children():
    """decide against runs counted step by step; what can be said early is what is said at the end."""
    rng = random.Random(8)
    for _ in range(3000):
        children = {i: rng.randrange(60) for i in range(rng.randrange(7))}
        parent, ttl = rng.choice([None, rng.randrange(60)]), rng.randrange(1, 15)
        want = set()
        for span, at in children.items():
            if parent is None or at > parent + ttl:
                continue
            stops = sorted({t for t in children.values() if at <= t < parent} | {parent}) if at < parent else []
            if all(b - a <= ttl for a, b in zip([at, *stops], stops, strict=False)):
                want.add(span)
        matched, alone, again = K.decide(children, parent, ttl, 10**6)
        assert set(matched) == want and set(alone) == set(children) - want and not again
        now = rng.randrange(80)
        early, lost, later = K.decide({s: t for s, t in children.items() if t <= now}, parent if parent is not None and parent <= now else None, ttl, now)
        assert set(early) <= want and set(lost) <= set(children) - want and all(d >= now for d in later)


def test_late_parents_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    minute, rows = 60_000_000, []
    for trace in range(12):
        base = 10**15 + trace * minute
        for span in range(8):
            parent = None if span == 0 else rng.choice([0, 0, 1, 99])
            rows.append((trace, span, parent, base + rng.randrange(50) * minute, f"m{rng.randrange(4)}", float(span)))
    rows = [r for r in rows if r[1] or r[0] % 4]  # some parents never come
    out = drain(K.late_parents(arriving(spark, str(tmp_path / "in"), rows, 3, 2), 600, "2 hours"), "late-test")
    key = lambda r: (r.trace_id, r.span_id, r.started_at, r.method, r.duration_ms, r.caller, r.solo)
    frame = spark.createDataFrame([r for r in rows], FIELDS.replace("timestamp", "long")).withColumn("started_at", F.timestamp_micros("started_at"))
    want = sorted(map(key, K.late_parents_batch(frame, 600).collect()))
    assert sorted(map(key, out.where("trace_id >= 0").collect()), key=str) == sorted(want, key=str)
    assert len(want) == len(rows) and {s for *_, s in want} == {True, False}


def test_links_share_the_keys_of_the_state(spark, tmp_path, monkeypatch):
    """Thousands of links, few keys: the state is asked once a bucket and batch; links of a bucket stay apart."""
    monkeypatch.setattr(K, "BUCKETS", 3)
    minute, rng = 60_000_000, random.Random(2)
    rows = [(t, s, None if s == 0 else rng.choice([0, 1, 77]), 10**15 + rng.randrange(90) * minute, f"m{s % 3}", None if s == 2 else float(s)) for t in range(700) for s in range(4) if s or t % 5]
    stream = arriving(spark, str(tmp_path / "in"), rows, 2, 4)
    folder_calls = K.late_parents(stream, 900, "3 hours")
    got = drain(folder_calls, "buckets-test").where("trace_id >= 0")
    frame = spark.createDataFrame(rows, FIELDS.replace("timestamp", "long")).withColumn("started_at", F.timestamp_micros("started_at"))
    want = K.late_parents_batch(frame, 900)
    assert got.count() == len(rows) and got.select(*want.columns).exceptAll(want).count() == 0
    assert "bucket" in folder_calls._jdf.queryExecution().analyzed().toString()


def test_rolling_forgets_idle_keys(spark, tmp_path):
    """Two spans of a key, and one after the time to live: the window starts anew; a busy key keeps its own."""
    second = 1_000_000
    folder = str(tmp_path / "in")
    frame = lambda part: spark.createDataFrame(part, FIELDS.replace("timestamp", "long")).withColumn("started_at", F.timestamp_micros("started_at"))
    times = [(1, "idle", 0), (3, "busy", 5), (2, "idle", 10), (4, "busy", 50), (5, "busy", 90), (6, "busy", 130), (7, "busy", 180), (8, "idle", 200), (9, "busy", 210)]
    for span, key, at in times:
        frame([(0, span, None, 10**15 + at * second, key, float(span))]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.span_id: (r.n, r.p50) for r in drain(K.rolling(stream, "method", 3, 100, "0 seconds", p50=0.5), "rolling-test").collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0), 3: (1, 3.0), 4: (2, 3.0), 5: (3, 4.0), 6: (3, 5.0), 7: (3, 6.0), 8: (1, 8.0), 9: (3, 7.0)}


@pytest.mark.parametrize("size", [1, 3, 256])
def test_rolling_order(size):
    rng, window, seen = random.Random(1), K.RollingOrder(size), []
    for _ in range(700):
        value = rng.choice([None, float(rng.randrange(9))])
        window.add(value)
        seen.append(value)
        kept = sorted(v for v in seen[-size:] if v is not None)
        assert window.sorted == kept and window.at(0.5) == (kept[(len(kept) + 1) // 2 - 1] if kept else None)
