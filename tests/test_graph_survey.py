"""Strong components, longest paths and reach against closures, in one task and by levels."""

import random

import pytest

from cairn.operators import graph_survey as S


def brute(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        front = [n]
        while front:
            for a, b in edges:
                if a == front[-1] and b not in reach[n] and b != n:
                    reach[n].add(b)
                    front.insert(0, b)
            front.pop()
    group = {n: frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in nodes}
    memo = {}

    def depth(g):
        if g not in memo:
            memo[g] = max((1 + depth(group[b]) for a, b in edges if a in g and b not in g), default=0)
        return memo[g]

    return {(n, min(group[n]), len(group[n]), depth(group[n]), len(reach[n])) for n in nodes}


def graph(seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)}
    edges |= {(f"c{i}", f"c{i + 1}") for i in range(5)} | {("x", "y"), ("y", "x"), ("l", "l"), ("y", "z")}
    return sorted(edges)


@pytest.mark.parametrize("seed,most", [(1, None), (2, None), (3, 12), (4, 4)])
def test_survey(spark, seed, most):
    """All in one task; small weak components in packs and the large one by levels; nearly all by levels."""
    edges = graph(seed)
    df = spark.createDataFrame([*edges, edges[0], (None, "q")], "src string, dst string")
    got = {(r.node, r.root, r.size, r.depth, r.reach) for r in S.survey(df, True, most).collect()}
    assert got == brute(edges)


@pytest.mark.parametrize("seed,most,sample", [(6, 30, 4_000_000), (7, 6, 60)])
def test_survey_by_cores(spark, monkeypatch, seed, most, sample):
    """Strong components become one node each, found whole or from a sample; the rest is one task's, or goes by levels with their sizes."""
    rng = random.Random(seed)
    edges = {(f"{g}{rng.randrange(20):02d}", f"{g}{rng.randrange(20):02d}") for g in "abc" for _ in range(60)}
    edges |= {("a01", "u"), ("u", "v"), ("v", "b03"), ("z", "a07"), ("z", "zz"), ("zz", "z"), ("c01", "w"), ("w", "w"), ("0", "b01"), ("b02", "0")}
    cuts, real = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df, name: cuts.append(name) or real(df, name))
    monkeypatch.setattr(S, "CORE_NODES", 3, raising=False)
    monkeypatch.setattr(S, "SAMPLE_EDGES", sample, raising=False)
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = [(r.node, r.root, r.size, r.depth, r.reach) for r in S.survey(df, True, most).collect()]
    assert set(got) == brute(sorted(edges)) and len(got) == len(set(got))
    assert "survey-names" in cuts and (most > 6 or "survey-reach" in cuts)


def test_sources_whose_edges_have_no_end(spark):
    from cairn.operators import graph as G

    df = spark.createDataFrame([("a", "b"), ("c", None), (None, "a"), ("b", "b")], "src string, dst string")
    assert {tuple(r) for r in G.blast_radius(df).collect()} == {("a", 1), ("b", 0), ("c", 0)}


def test_blocks_of_bitmaps_and_no_edges(spark, monkeypatch):
    edges = graph(5)
    monkeypatch.setattr(S, "BITMAP_WORDS", 1)
    import numpy as np

    src, dst = (np.array(c, str) for c in zip(*edges, strict=True))
    got = {tuple(r) for r in S.survey_local(src, dst, True).itertuples(index=False)}
    assert got == brute(edges)
    assert S.survey(spark.createDataFrame([], "src string, dst string"), True).count() == 0


def test_long_path_without_recursion():
    import numpy as np

    n = 50_000
    names = np.array([f"{i:06d}" for i in range(n)])
    out = S.survey_local(names[:-1], names[1:], False).set_index("node")
    assert out.loc["000000", "depth"] == n - 1 and out["size"].max() == 1
    ring = S.survey_local(names, np.roll(names, -1), False)
    assert ring["size"].min() == n and set(ring["root"]) == {"000000"}


def test_pairs_once_without_a_global_distinct(spark):
    """Each pair once though rows repeat and a class has two names; a class of one name takes no part in the comparison of pairs."""
    from cairn.operators import graph as G

    classes = spark.createDataFrame([("f", "A", "n1"), ("f", "A", "n1"), ("f", "B", "n1"), ("f", "A", "n2"), ("g", "A", "n3"), ("f", "B", None)], "file string, name string, node string")
    calls = spark.createDataFrame([("f", "x", "extends", "A"), ("f", "x", "extends", "B"), ("f", "x", "extends", "A"), ("g", "x", "extends", "A"), ("f", "y", "implements", "B")], "file string, node string, relation string, target string")
    got = [tuple(r) for r in G.heritage_edges(classes, calls).collect()]
    assert sorted(got, key=str) == sorted([("extends", "x", "n1"), ("extends", "x", "n2"), ("extends", "x", "n3"), ("extends", "x", None), ("implements", "y", "n1"), ("implements", "y", None)], key=str)
    rows = spark.range(400).selectExpr("'f' AS file", "concat('o', id % 2) AS owner", "'m' AS simple", "concat('n', id) AS node", "IF(id % 2 = 0, 'o1', NULL) AS trait", "id % 2 = 1 AS trait_default")
    pairs = G.override_edges(rows)
    assert pairs.count() == 200 * 200 == pairs.distinct().count()
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not text.lstrip().startswith("Aggregate")


def test_pairs_of_a_key_are_written_as_blocks(spark, tmp_path, monkeypatch):
    """Pairs of a key lie together in the file, so that it keeps runs (1.7 bytes a pair before); and a key is not one task's."""
    from pyspark.sql import functions as F

    from cairn.operators import common as C

    left = spark.range(6_000).selectExpr("concat('k', id % 30) AS k", "concat('a', id) AS src")
    right = spark.range(6_000).selectExpr("concat('k', id % 30) AS k", "concat('b', id) AS dst")
    C.pairs_once(left, right, ["k"]).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 30 * 200 * 200
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 0.6 * 30 * 200 * 200

    for name, most in (("PAIR_ROWS", 16), ("PAIR_DST", 16), ("PAIR_TILES", 3)):
        monkeypatch.setattr(C, name, most, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = C.pairs_once(left.where("k = 'k1'"), right.where("k = 'k1'"), ["k"])
        assert pairs.distinct().count() == 200 * 200
        assert max(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()) < 0.6 * 200 * 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_weak_component_of_a_quarter_million_edges_is_one_task(spark):
    """It went by written rounds above 200,000 edges; a task takes it, and its numbers are those of the rounds' method."""
    from cairn.operators import common as C

    n = 60_000
    edges = spark.range(n).selectExpr("explode(array(id + 1, id + 7, id * 13 + 5, id * 7 + 3, id * 31 + 11)) AS d", "id AS s").selectExpr("concat('n', s) AS src", "concat('n', d % 60000) AS dst")
    cuts, real = [], C._written
    try:
        C._written = lambda df, name, scopes: cuts.append(name) or real(df, name, scopes)
        out = S.survey(edges, True).agg({"size": "min", "reach": "min"}).first()
    finally:
        C._written = real
    assert "scc" not in cuts and cuts[0] == "survey-links"
    assert out["min(size)"] == n and out["min(reach)"] == n - 1
