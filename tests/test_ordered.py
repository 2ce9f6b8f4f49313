"""Order within keys over ranges, with a key that lies in several of them; threads and nested scopes of cuts."""

import math
import random
import threading

import pytest

from cairn.operators import common as C
from cairn.operators import ordered as O


@pytest.fixture
def many_parts(spark):
    """No joining of small partitions: four ranges, so that a large key lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(rng):
    rows = [("hot", i, float(rng.randrange(5000))) for i in range(3000)] + [(k, i, rng.choice([None, 1.0, 2.5])) for k in ("a", "z", None) for i in range(7)]
    return [*rows, ("nulls", 0, None)]


def test_ranks_of_a_key_in_several_ranges(spark, many_parts):
    rows = skewed(random.Random(3))
    df = spark.createDataFrame(rows, "k string, i int, v double")
    spread = O.ranges(df.where("v IS NOT NULL"), ["k"], ["v"]).where("k = 'hot'")
    assert spread.select("_part").distinct().count() >= 3
    shares = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    linear = {r.k: r for r in O.percentiles(df, ["k"], "v", **shares).collect()}
    nearest = {r.k: r for r in O.nearest_rank(df, ["k"], "v", **shares).collect()}
    assert set(linear) == set(nearest) == {"hot", "a", "z", None}
    for k in linear:
        xs = sorted(v for key, _, v in rows if key == k and v is not None)
        assert linear[k].n == nearest[k].n == len(xs) and linear[k].mean == pytest.approx(sum(xs) / len(xs))
        for name, p in shares.items():
            at = p * (len(xs) - 1)
            low, high = xs[math.floor(at)], xs[min(len(xs) - 1, math.floor(at) + 1)]
            assert linear[k][name] == pytest.approx(low + (at - math.floor(at)) * (high - low))
            assert nearest[k][name] == xs[max(1, math.ceil(p * len(xs))) - 1]
    whole = O.percentiles(df, [], "v", p50=0.5).collect()
    xs = sorted(v for _, _, v in rows if v is not None)
    assert len(whole) == 1 and whole[0].p50 == (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2


@pytest.mark.parametrize("size", [1, 5, 256, 2000])
def test_rolling_over_ranges(spark, many_parts, size):
    """The window is longer than a range in the last case, so that the rows before it lie in several."""
    rows = skewed(random.Random(4))
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r.k, r.i): (r.window_n, r.p50, r.p95) for r in O.rolling_quantiles(df, "k", ["i"], "v", size, p50=0.5, p95=0.95).collect()}
    want = {}
    for key in {k for k, *_ in rows}:
        mine = sorted((i, v) for k, i, v in rows if k == key)
        for at, (i, _) in enumerate(mine):
            xs = sorted(v for _, v in mine[max(0, at + 1 - size) : at + 1] if v is not None)
            pick = lambda p: xs[max(1, math.ceil(p * len(xs))) - 1] if xs else None  # noqa: B023, E731
            want[key, i] = (len(xs), pick(0.5), pick(0.95))
    assert got == want
    assert O.rolling_quantiles(df.limit(0), "k", ["i"], "v", p50=0.5).count() == 0


def test_scopes_of_two_threads_and_nested_ones(spark):
    """What another thread cuts while a scope is open stays, and an inner result lives until the outer scope ends."""
    kept, opened, cut_there = [], threading.Event(), threading.Event()

    def other():
        opened.wait()
        kept.append(C.cut(spark.range(5), "other"))
        cut_there.set()

    thread = threading.Thread(target=other)
    thread.start()
    with C.scratch(spark) as keep:
        gone = C.cut(spark.range(3), "gone")
        opened.set()
        cut_there.wait()
        with C.scratch(spark) as inner:
            inside = C.cut(spark.range(2), "inside")
            middle = inner(inside, "middle")
        assert middle.count() == 2
        result = keep(middle, "result")
    thread.join()
    assert result.count() == 2 and kept[0].count() == 5
    there = lambda df: C.exists(spark, df.inputFiles()[0].rsplit("/", 1)[0])
    assert there(result) and there(kept[0]) and not any(map(there, (gone, inside, middle)))


def test_narrowest_interval_over_ranges(spark, many_parts):
    """Overlapping intervals, a file with most of the rows, and an interval of a million lines that costs a row a range."""
    rng = random.Random(12)
    intervals = [("big", f"i{n}", start, start + rng.choice([0, 3, 40, 900])) for n in range(300) for start in [rng.randrange(5000)]]
    intervals += [("big", "all", 0, 10**6), ("small", "a", 5, 9), ("small", "b", 5, 9), ("small", "wrong", 9, 5), (None, "null", 0, 9)]
    points = [(n, rng.choice(["big", "big", "small", "none"]), rng.randrange(5200)) for n in range(800)] + [(900, "small", 7), (901, "small", 10), (902, "big", None), (903, None, 5), (904, "big", 10**6), (905, "big", 10**6 + 1)]
    found = O.narrowest(spark.createDataFrame(points, "id long, file string, line long"), "id", spark.createDataFrame(intervals, "file string, node_id string, start_line long, end_line long"), ["file"])
    want = {}
    for point, file, line in points:
        fits = [(end - start, node) for f, node, start, end in intervals if f == file and f is not None and line is not None and start <= line <= end]
        if fits:
            want[point] = min(fits)[1]
    assert {r.id: r.node_id for r in found.collect()} == want and found.count() == len(want)


def test_publisher_after_a_crash(spark, tmp_path):
    """A batch that stopped between its tables is invisible, is found, and comes out right when it is run again."""
    from cairn.sources import publisher as W

    store, fields = str(tmp_path / "store"), "item_id long, version long, embedding array<double>"
    W.publish(spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0]), (3, 1, None)], fields), store, 1, 2)
    second = spark.createDataFrame([(1, 2, [5.0, 6.0]), (2, 2, [7.0]), (4, 1, [float("nan"), 0.0]), (5, 1, [0.0, 1.0]), (5, 2, [1.0, 1.0])], fields)
    W.write_vectors(W.queue(second, store, 2), store, 2, 2)
    assert {(r.item_id, r.version) for r in W.live(spark, store).collect()} == {(1, 1), (2, 1)}
    assert [r.batch for r in W.unfinished(spark, store).collect()] == [2]
    for _ in range(2):  # once to repair, once more to see that nothing changes
        W.publish(second, store, 2, 2)
        assert {(r.item_id, r.version, tuple(r.embedding)) for r in W.live(spark, store).collect()} == {(1, 2, (5.0, 6.0)), (2, 1, (3.0, 4.0)), (5, 2, (1.0, 1.0))}
        assert {(r.item_id, r.version, r.kind, r.reason) for r in W.state(spark, store).collect()} == {(1, 1, "superseded", "newer_version"), (1, 2, "published", None), (2, 1, "published", None), (2, 2, "failed", "wrong_size"), (3, 1, "failed", "no_vector"), (4, 1, "failed", "not_finite"), (5, 1, "superseded", "newer_version"), (5, 2, "published", None)}
        assert W.unfinished(spark, store).count() == 0


def test_appends_read_only_months_that_may_hold_a_key(spark, tmp_path):
    from cairn.sources import sinks

    path = str(tmp_path / "facts")
    day = lambda rows: spark.createDataFrame(rows, "id long, t string").selectExpr("id", "CAST(t AS TIMESTAMP) AS created_at")
    for month in range(1, 7):
        sinks.append_new(day([(100 * month + n, f"2024-{month:02d}-03 00:00:00") for n in range(20)]), path, ["id"])
    again = day([(305, "2024-03-03 00:00:00"), (306, "2024-05-01 00:00:00"), (999, "2024-06-01 00:00:00"), (999, "2024-06-01 00:00:00")])
    assert [d.month for d in sinks.months_that_may_hold(again, path, ["id"])] == [3]
    plan = sinks.stored(again, path, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-03-01" in plan
    for _ in range(2):
        sinks.append_new(again, path, ["id"])
        assert spark.read.parquet(path).count() == 121 and spark.read.parquet(path).select("id").distinct().count() == 121


def test_a_key_of_many_months_is_asked_for_once(spark, tmp_path):
    """Marks of keys meet by the mark: the join of a batch with a store of many months has no row a month."""
    from cairn.sources import sinks

    path = str(tmp_path / "facts")
    rows = spark.range(2000).selectExpr("id", "make_timestamp(2000 + CAST(id % 40 AS INT), 1, 1, 0, 0, 0) AS created_at")
    sinks.append_new(rows, path, ["id"])
    assert spark.read.parquet(f"{path}-keys").count() == 2000
    assert sinks.months_that_may_hold(rows.where("id < 3"), path, ["id"]) == [__import__("datetime").date(2000 + n, 1, 1) for n in range(3)]
    sinks.append_new(rows, path, ["id"])
    assert spark.read.parquet(path).count() == 2000 == spark.read.parquet(f"{path}-keys").count()
