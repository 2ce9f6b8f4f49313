"""Operators on small literal tables: the edge cases of each."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import code_metrics as K
from cairn.operators import common as C
from cairn.operators import graph as G
from cairn.operators import memory as R
from cairn.operators import ordered as O
from cairn.operators import policy as P
from cairn.operators import samples as M
from cairn.operators import stats as A


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


# --- samples and statistics


def test_active_samples(spark):
    fields = "sample_id string, repo_id string, sha string, scope_id string, metric_kind string, metric_version long, value double, seq long"
    rows = [("a", "r", "s", "x", "k", 1, 1.0, 1), ("b", "r", "s", "x", "k", 1, 2.0, 2), ("c", "r", "s", "y", "k", 1, 3.0, 1), ("d", "r", "s", "z", "k", 1, None, 1), ("e", "r", "s", "q", "k", 1, 5.0, 1)]
    scopes = table(spark, [(k, k, "p") for k in "xyz"], "scope_id string, canonical_signature string, package string")
    got = M.active(table(spark, rows, fields), table(spark, [("c",)], "sample_id string"), scopes)
    assert as_set(got, "sample_id") == {("b",)}  # the newest; c is retracted, d has no value, q has no scope


def test_percentiles(spark):
    rng = random.Random(1)
    data = {k: [rng.choice([0, 1, 2.5, 7, 100]) * rng.random() for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101))}
    df = table(spark, [(k, v) for k, xs in data.items() for v in [*xs, None]], "k string, v double")
    for r in O.percentiles(df, ["k"], "v", p0=0.0, p50=0.5, p90=0.9, p100=1.0).collect():
        xs = sorted(data[r.k])
        at = lambda p: xs[int(p * (len(xs) - 1))] + (p * (len(xs) - 1) % 1) * (xs[min(len(xs) - 1, int(p * (len(xs) - 1)) + 1)] - xs[int(p * (len(xs) - 1))])  # noqa: B023, E731
        assert (r.n, r.p0, r.p100) == (len(xs), xs[0], xs[-1])
        assert r.p50 == pytest.approx(at(0.5)) and r.p90 == pytest.approx(at(0.9)) and r.mean == pytest.approx(statistics.fmean(xs))
    assert O.percentiles(df.limit(0), ["k"], "v", p50=0.5).count() == 0


def test_robust_z(spark):
    data = {"spread": [1.0, 2, 3, 4, 100], "no_mad": [5.0, 5, 5, 5, 9], "flat": [3.0, 3, 3], "one": [7.0]}
    df = table(spark, [(k, i, v if v is None else float(v)) for k, xs in data.items() for i, v in enumerate([*xs, None])], "k string, i int, v double")
    for r in A.robust_z(df, ["k"], ["v"]).collect():
        xs = data[r.k]
        med = statistics.median(xs)
        mad, sd = statistics.median(abs(x - med) for x in xs), statistics.pstdev(xs)
        want = 0.0 if r.v is None else (r.v - med) / (1.4826 * mad) if mad else (r.v - statistics.fmean(xs)) / sd if sd else 0.0
        assert r.v_z == pytest.approx(want)


def test_slope_and_fresh(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 0.0, 4.0), ("c", 1.0, 4.0), ("c", 1.0, 8.0)]
    got = {r.k: (r.slope, r.degraded) for r in A.slope(table(spark, rows, "k string, x double, y double"), ["k"], "y", "x").collect()}
    assert got == {"a": (2.0, False), "b": (None, True), "c": (0.0, False)}
    built = table(spark, [(1, "2024-01-01 00:00:00"), (2, "2023-12-31 23:59:59"), (3, None)], "i int, t string").select("i", F.col("t").cast("timestamp").alias("built_at"))
    assert as_set(M.fresh(built, F.lit("2024-01-01 01:00:00")), "i", "degraded_reason") == {(1, None), (2, "percentile_stale"), (3, "percentile_stale")}


def test_hysteresis(spark):
    steps = [(0, 150), (20, 150), (30, 150), (40, 10), (60, 10), (71, 10), (80, 200)]
    df = table(spark, [("q", s, d) for s, d in steps], "k string, s long, depth int").withColumn("t", F.timestamp_seconds("s"))
    got = [r.degraded for r in A.hysteresis(df, "k", "t", "depth").orderBy("s").collect()]
    assert got == [False, False, True, True, True, False, False]


def test_keyset_and_hydration(spark):
    df = table(spark, [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2)], "a int, b int, c int")
    assert as_set(df.where(C.keyset_after(["a", "b", "c"], [1, 2, 1])), "a", "b", "c") == {(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2) if (a, b, c) > (1, 2, 1)}
    lists = table(spark, [(1, ["x", "gone", "x"])], "k int, ids array<string>")
    got = C.hydrate(lists, "k", "ids", table(spark, [("x", "X")], "id string, name string"), "id")
    assert as_set(got, "position", "id", "name") == {(0, "x", "X"), (1, "gone", None), (2, "x", "X")}


# --- policy

SAMPLE = "repo_id string, sha string, scope_id string, sample_id string, metric_kind string, scope_kind string, pack string, source string, value double, degraded boolean"


def sample(scope, sid, kind="cyclo", value=1.0, degraded=False, pack="base"):
    return ("r", "s", scope, sid, kind, "method", pack, "computed", value, degraded)


def test_absent_operand_is_false_before_negation(spark):
    df = table(spark, [sample("a", "1", value=None), sample("a", "2", value=9.0), sample("a", "3", pack="")], SAMPLE)
    large = P.Compare("value", ">", 5.0)
    got = as_set(df.select("sample_id", P.on_row(large).alias("x"), P.on_row(P.Negate(large)).alias("y"), P.on_row(P.Compare("pack", "!=", "solid")).alias("z")), "sample_id", "x", "y", "z")
    assert got == {("1", False, True, True), ("2", True, False, True), ("3", False, True, False)}


def brute(p, samples):
    """(matched, witnesses) of a predicate over the samples of a scope, sorted by id."""
    def row(p, s):
        match p:
            case P.Compare():
                v = s[{"metric_kind": 4, "scope_kind": 5, "pack": 6, "source": 7, "value": 8, "degraded": 9}[p.field]]
                return v is not None and v != "" and P.COMPARE[p.op](v, p.value)
            case P.Threshold():
                return s[4] == p.metric_kind and s[5] == p.scope_kind and s[8] is not None and P.COMPARE[p.op](s[8], p.value)
            case P.Every():
                return all(row(c, s) for c in p.children)
            case P.Some():
                return any(row(c, s) for c in p.children)
            case P.Negate():
                return not row(p.child, s)
            case P.Always():
                return p.value

    match p:
        case P.Every():
            for s in samples:
                if all(row(c, s) for c in p.children):
                    return True, {s[3]}
            if not p.children or not all(isinstance(c, P.Threshold) for c in p.children):
                return False, set()
            parts = [brute(c, samples) for c in p.children]
            return (True, set().union(*[w for _, w in parts])) if all(m for m, _ in parts) else (False, set())
        case P.Some():
            parts = [x for x in (brute(c, samples) for c in p.children) if x[0]]
            return bool(parts), set().union(*[w for _, w in parts]) if parts else set()
        case P.Negate():
            return not brute(p.child, samples)[0], set()
        case P.Always():
            return p.value, set()
        case _:
            found = {s[3] for s in samples if row(p, s)}
            return bool(found), found


def test_scope_evaluation_equals_brute_force(spark):
    rng = random.Random(4)

    def atom():
        return rng.choice([P.Compare("metric_kind", "==", rng.choice(["cyclo", "fan_in"])), P.Compare("value", rng.choice([">", "<="]), rng.choice([1.0, 5.0, 8.0])), P.Compare("degraded", "==", True), P.Compare("pack", "!=", "solid"), P.Threshold("cyclo", "method", ">", 5.0), P.Threshold("fan_in", "method", "<=", 5.0), P.Always(rng.random() < 0.5)])

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            return atom()
        return rng.choice([lambda: P.Every((tree(depth - 1), tree(depth - 1))), lambda: P.Some((tree(depth - 1), tree(depth - 1))), lambda: P.Negate(tree(depth - 1)), lambda: P.Every((P.Threshold("cyclo", "method", ">", 5.0), P.Threshold("fan_in", "method", ">", 1.0)))])()

    rules = [P.Rule(f"r{i:02d}", tree(2)) for i in range(20)]
    samples = [sample(f"s{i % 12}", f"{i:03d}", rng.choice(["cyclo", "fan_in"]), rng.choice([None, 0.0, 3.0, 6.0, 9.0]), rng.random() < 0.2, rng.choice(["base", "solid", ""])) for i in range(40)]
    scopes = defaultdict(list)
    for s in samples:
        scopes[s[2]].append(s)
    want_fired, want_seen = set(), set()
    for scope, own in scopes.items():
        for r in rules:
            matched, seen = brute(r.predicate, own)
            if matched:
                want_fired.add((scope, r.rule_id))
                want_seen |= {(scope, r.rule_id, x) for x in seen}
    fired, seen = P.evaluate(table(spark, samples, SAMPLE), rules)
    assert as_set(fired, "scope_id", "rule_id") == want_fired
    assert as_set(seen, "scope_id", "rule_id", "sample_id") == want_seen


def test_predicates_are_checked():
    for bad in (lambda: P.Compare("nope", "==", "x"), lambda: P.Compare("value", "==", "x"), lambda: P.Compare("pack", "<", "x"), lambda: P.Compare("degraded", "==", 1.0), lambda: P.Threshold("a", "b", "!=", 1)):
        with pytest.raises((ValueError, TypeError)):
            bad()


def test_deltas_and_resolved(spark):
    fields = "scope_id string, rule_id string, severity string"
    current = table(spark, [("a", "r", "block"), ("b", "r", "block"), ("c", "r", "block"), ("d", "r", "warn"), ("e", "r", "warn"), ("f", "r", "block")], fields)
    prior = table(spark, [("a", "r", "block", "new"), ("b", "r", "warn", "new"), ("d", "r", "block", "new"), ("e", "r", "warn", "new"), ("f", "r", "block", "resolved"), ("g", "r", "block", "unchanged"), ("h", "r", "block", "resolved")], f"{fields}, delta string")
    assert as_set(P.deltas(current, prior), "scope_id", "delta") == {("a", "unchanged"), ("b", "newly_failing"), ("c", "new"), ("d", "new"), ("e", "new"), ("f", "newly_failing")}
    assert as_set(P.resolved(current, prior), "scope_id", "severity", "delta") == {("d", "info", "resolved"), ("g", "info", "resolved")}


def test_hot_spots_absent_dimension(spark):
    metrics = table(spark, [("a", 1.0, None, None, None, None), ("b", None, 9.0, 2.0, None, None), ("c", 5.0, 1.0, 4.0, 3.0, None)], "scope_id string, cyclo double, cognitive_complexity double, modification_count double, coupling double, fan_out double")
    got = {r.scope_id: r for r in P.hot_spots(metrics, table(spark, [("c", 2), ("z", 3)], "scope_id string, finding_count long")).collect()}
    assert set(got) == {"a", "b", "c", "z"}
    assert got["a"].churn_z == 0.0 and got["z"].score == 3.0 and got["b"].complexity == 9.0 and got["c"].complexity == 6.0


# --- graphs


def closure(edges):
    reach = defaultdict(set)
    for a, _ in edges:
        todo, seen = [a], set()
        while todo:
            for x, y in edges:
                if x == todo[-1] and y not in seen:
                    seen.add(y)
                    todo.insert(0, y)
            todo.pop()
        reach[a] = seen
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_depth(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(20)} | {("n1", "n1"), ("x", "y"), ("y", "x")}
    df = table(spark, sorted(edges), "src string, dst string")
    reach = closure(edges)
    nodes = {n for e in edges for n in e}
    group = {n: frozenset({n} | {m for m in nodes if m in reach[n] and n in reach[m]}) for n in nodes}
    got = defaultdict(set)
    for r in G.strong_components(df).collect():
        got[r.root].add(r.node)
    assert {frozenset(g) for g in got.values()} == {g for g in group.values() if len(g) > 1}

    def depth(g):
        return max((1 + depth(group[b]) for a, b in edges if a in g and b not in g), default=0)

    found = G.dependency_depth(table(spark, [(n,) for n in sorted(nodes)], "node string"), df)
    assert as_set(found, "node", "depth") == {(n, depth(group[n])) for n in nodes}
    radius = G.blast_radius(df, df.select(F.col("src").alias("node")))
    assert as_set(radius, "node", "blast_radius") == {(a, len(reach[a] - {a})) for a, _ in edges}


def test_components_and_empty_graphs(spark):
    df = table(spark, [("b", "a"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert as_set(G.components(df), "node", "root") == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    empty = table(spark, [], "src string, dst string")
    assert G.strong_components(empty).count() == 0
    assert G.reachable(empty, table(spark, [("q",)], "node string")).count() == 1


def test_expand_budgets(spark):
    edges = table(spark, [(f"e{i:02d}", "static_calls", "a", f"b{i:02d}") for i in range(6)] + [("f", "static_calls", "b00", "c"), ("g", "imports", "a", "q"), ("h", "observed_calls", "c", "a")], "edge_id string, kind string, src_node_id string, dst_node_id string")
    found, nodes, cut = G.expand(edges, ["a"], 2)
    assert len(found) == 7 and nodes["c"] == 2 and cut  # c goes on, beyond the depth
    found, nodes, cut = G.expand(edges, ["a"], 3)
    assert len(found) == 8 and not cut and "q" not in nodes
    found, _, cut = G.expand(edges, ["a"], 3, max_edges=3)
    assert [e["edge_id"] for e in found] == ["h", "e00", "e01"][1:] + ["e02"] and cut
    _, nodes, cut = G.expand(edges, ["a"], 3, max_nodes=2)
    assert len(nodes) == 3 and cut
    found, _, _ = G.expand(edges, ["a"], 1, callers=True)
    assert [e["edge_id"] for e in found] == ["h"]


def test_ancestry_of_a_long_chain(spark):
    chain = table(spark, [(i, i - 1 if i else None) for i in range(300)], "id long, parent long")
    got = G.ancestry(chain, chain.where("id IN (0, 7, 299)").select("id"))
    assert as_set(got.groupBy("target").agg(F.count("*").alias("n"), F.max("distance").alias("d")), "target", "n", "d") == {(0, 1, 0), (7, 8, 7), (299, 300, 299)}


def test_narrowest(spark):
    spans = table(spark, [(1, "f", 5), (2, "f", 100), (3, "f", 900), (4, "g", 5)], "id int, file string, line int")
    intervals = table(spark, [("f", "outer", 1, 500), ("f", "inner", 4, 6), ("f", "same", 4, 6), ("f", "bad", 9, 2)], "file string, node_id string, start_line int, end_line int")
    assert as_set(O.narrowest(spans, "id", intervals, ["file"]), "id", "node_id") == {(1, "inner"), (2, "outer")}


def test_edge_builders(spark):
    methods = table(spark, [("f", "A.run", "1"), ("f", "B.run", "2"), ("f", "A.go", "3"), ("g", "C.run", "4")], "file string, name string, node string")
    calls = table(spark, [("f", "3", "run", None), ("f", "3", "run", "A"), ("f", "1", "go", None), ("g", "9", "run", None), ("g", "9", "go", None), ("f", "1", "gone", "A")], "file string, caller string, callee string, enclosing string")
    assert as_set(G.call_edges(methods, calls), "src", "dst") == {("3", "1"), ("1", "3"), ("9", "4")}
    imports = table(spark, [("f", "os", "b"), ("f", "os", "a"), ("f", ".x", "a")], "file string, target string, symbol string")
    assert [(r.src, r.dst, r.symbols) for r in G.import_edges(imports).collect()] == [("f", "package:os", ["a", "b"])]
    access = table(spark, [("m", "C", "reads", "y", 1), ("m", "C", "reads", "x", 2), ("m", "C", "reads", "y", 3), ("m", "C", "writes", "x", 4)], "method string, class string, direction string, member string, position int")
    assert {(r.kind, tuple(r.members)) for r in G.access_edges(access).collect()} == {("reads", ("y", "x")), ("writes", ("x",))}
    bodies = table(spark, [("long", "\n".join(["x = 1", "# note", ""] * 3), 10, 0), ("short", "x", 1, 1)], "node_id string, body string, start_line int, end_line int")
    assert as_set(G.method_blocks(bodies, 2), "node_id", "kind", "start_line", "end_line") == {("long", "entry", 10, 13), ("long", "exit", 14, 18)}


def test_rename_pairs(spark):
    fields = "parent_signature string, kind string, node_id string"
    gone = table(spark, [("p", "method", "1"), ("q", "method", "2"), ("q", "method", "3"), (None, "method", "4"), ("s", "class", "5")], fields)
    new = table(spark, [("p", "method", "a"), ("q", "method", "b"), ("s", "method", "c"), (None, "method", "d")], fields)
    assert as_set(G.rename_pairs(gone, new), "old_node_id", "new_node_id") == {("1", "a")}


# --- code metrics

SCOPE = "file string, scope_id string, parent_scope_id string, kind string, decision string, start_line int, end_line int, degraded_reason string"


def test_complexity_skips_nested_methods(spark):
    rows = [("f", "F", None, "file", None), ("f", "M", "F", "method", None), ("f", "b1", "M", "block", "if"), ("f", "b2", "b1", "block", "for"), ("f", "b3", "b2", "block", "else"), ("f", "N", "b2", "method", None), ("f", "b4", "N", "block", "while"), ("f", "b5", "b4", "block", "ternary"), ("f", "b6", "F", "block", "if"), ("g", "G", None, "file", None)]
    got = as_set(K.complexity(table(spark, [(*r, 1, 1, None) for r in rows], SCOPE)), "scope_id", "cyclo", "cognitive")
    assert got == {("M", 3, 1 + 2 + 1), ("N", 3, 1 + 2), ("F", 6, 7), ("G", 0, 0)}


def test_fan_counts_edges_that_cross(spark):
    rows = [("f", "F", None, "file"), ("f", "C", "F", "class"), ("f", "M", "C", "method"), ("f", "b", "M", "block"), ("f", "N", "C", "method"), ("g", "G", None, "file")]
    scopes = table(spark, [(*r, None, 1, 1, None) for r in rows], SCOPE)
    calls = table(spark, [("1", "b", "N"), ("2", "b", "N"), ("3", "G", "M"), ("4", None, "N"), ("5", "M", None), ("6", "b", "b")], "edge_id string, from_scope string, to_scope string")
    assert as_set(K.fan(scopes, calls), "scope_id", "n") == {("F", 2), ("C", 2), ("M", 1), ("N", 3), ("G", 0)}
    assert as_set(K.fan(scopes, calls, incoming=False), "scope_id", "n") == {("F", 1), ("C", 1), ("M", 3), ("N", 0), ("G", 1)}


def test_duplication_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefg") + str(rng.randrange(40)) for _ in range(120)]
    texts = {"once": base, "twice": base + ["z"] + base[:70], "loop": ["x"] * 130, "short": base[:49], "none": [], "tail": base[60:] + ["q"] * 20}
    df = table(spark, [(k, "p1" if k != "loop" else "p2", " ".join(v)) for k, v in texts.items()], "file string, package string, text string")

    def want(names):
        seen = defaultdict(list)
        for n in names:
            for i in range(len(texts[n]) - 49):
                seen[tuple(texts[n][i : i + 50])].append((n, i))
        return len({(n, i + j) for at in seen.values() if len(at) > 1 for n, i in at for j in range(50)})

    assert as_set(K.duplication(df), "file", "tokens", "covered") == {(k, len(v), want([k])) for k, v in texts.items()}
    assert as_set(K.duplication(df, ["package"]), "package", "covered") == {("p1", want([k for k in texts if k != "loop"])), ("p2", want(["loop"]))}


def test_lcom4_and_cycles(spark):
    members = table(spark, [("A", m) for m in ("A1", "A2", "A3", "A4")] + [("B", "B1")], "class string, method string")
    uses = table(spark, [("A", "A1", "x"), ("A", "A2", "x")], "class string, method string, field string")
    calls = table(spark, [("A", "A3", "A2"), ("A", "A4", "B1")], "class string, caller string, callee string")
    assert as_set(K.lcom4(members, uses, calls), "class", "lcom4") == {("A", 2), ("B", 1)}
    packages = table(spark, [("r", p) for p in "abcd"] + [("q", "a")], "repo string, package string")
    edges = table(spark, [("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("r", "d", "d"), ("q", "a", "b")], "repo string, src string, dst string")
    assert as_set(K.cycle_members(packages, edges), "repo", "package", "cycle_member", "cycle_id") == {("r", "a", 1.0, "scc:a,b"), ("r", "b", 1.0, "scc:a,b"), ("r", "c", 0.0, None), ("r", "d", 1.0, "scc:d"), ("q", "a", 0.0, None)}


# --- memory


def test_train_linear_equals_a_plain_loop(spark):
    import numpy as np

    rng = random.Random(7)
    rows = [(f"ep{i}", rng.choice([1.0, -1.0]), 1.0, *[rng.random() for _ in range(4)]) for i in range(60)]
    got = R.train_linear(table(spark, rows, f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}"), epochs=5).first()
    held = {r.episode_id for r in table(spark, rows, f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}").where(S.hold_out("episode_id", 0.1)).collect()}
    w, b, loss = np.zeros(5), 0.0, 0.0
    for _ in range(5):
        loss = 0.0
        for row in sorted(r for r in rows if r[0] not in held):
            y, x = row[1], np.array(row[2:])
            m = y * (w @ x + b)
            loss += np.log1p(np.exp(-m))
            g = -y / (1 + np.exp(m))
            w, b = w - 0.1 * g * x, b - 0.1 * g
    assert held and got.weights == pytest.approx(w.tolist()) and got.intercept == pytest.approx(b) and got.train_loss == pytest.approx(loss / (60 - len(held)))
    none = R.train_linear(table(spark, [], f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}")).first()
    assert none.weights == [0.0] * 5


def test_train_linear_refuses_what_one_task_should_not_hold(spark):
    rows = [(f"ep{i}", 1.0, *[0.5] * 5) for i in range(20)]
    df = table(spark, rows, f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}")
    with pytest.raises(ValueError, match="train_batch"):
        R.train_linear(df, fraction=0.0, most=19)
    assert R.train_linear(df, epochs=1, fraction=0.0, most=20).first().train_loss > 0


def test_windows_of_a_file_are_not_shuffled(spark):
    """A key that is one row is counted within the row; a file of two rows, or of no name, still counts over its rows, whose places it takes as one text's (as the SQL does)."""
    rng = random.Random(9)
    texts = [(f"f{i}", " ".join(rng.choices("ab", k=n) if i % 2 else ["w"] * n)) for i, n in enumerate([0, 49, 50, 51, 75, 100, 170])]
    df = table(spark, texts, "file string, text string")
    got = {r["file"]: (r["tokens"], r["covered"]) for r in K.duplication(df).collect()}
    plan = K.duplication(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and got["f6"] == (170, 170) and got["f2"] == (50, 0) and got["f0"] == (0, 0)
    half = " ".join(f"t{i}" for i in range(60))
    both = {r["file"]: (r["tokens"], r["covered"]) for r in K.duplication(table(spark, [*texts, ("two", half), ("two", half), (None, half), (None, half), ("one", half)], "file string, text string")).collect()}
    assert both == {**got, "two": (120, 60), None: (120, 60), "one": (60, 0)}


def test_windows_of_a_key_meet_by_their_runs(spark):
    """Shifted, edited and repetitive copies against a count of all windows; what is shuffled are runs, a small part of the windows."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(900)]
    edited = [w if i % 97 else "edit" for i, w in enumerate(base)]
    texts = [(i, t) for i, t in enumerate([base, base[200:], ["x"] * 3 + base[:333] + ["y"] + base[333:], edited, ["a"] * 400, ["a", "b"] * 90, list("abc") * 40, base[:50], base[:49], [], [f"u{j}" for j in range(3000)]])]
    texts += [(None, base[100:300]), (None, base[500:560]), (0, edited[60:260])]  # rows of one name: their places are taken as one text's
    df = table(spark, [(i, f"k{(i or 0) % 2}", " ".join(t)) for i, t in texts], "file long, package string, text string")
    want = defaultdict(set)
    for package in ("k0", "k1"):
        seen = defaultdict(list)
        for i, t in texts:
            if f"k{(i or 0) % 2}" == package:
                for at in range(len(t) - 49):
                    seen[tuple(t[at : at + 50])].append((i, at))
        want[package] = {(i, at + j) for places in seen.values() if len(places) > 1 for i, at in places for j in range(50)}
    assert as_set(K.duplication(df, ["package"]), "package", "covered") == {(k, len(v)) for k, v in want.items()}
    rows = table(spark, [(1, 7, [rng.getrandbits(62) for _ in range(20000)])], "file long, _key long, _tokens array<long>")
    runs = K._runs(rows, ["file"])
    assert runs.count() < 19951 / 12 and runs.agg({"n": "sum"}).first()[0] == 19951


def test_fan_counts_edges_by_their_ends(spark):
    """Random trees and edges, some repeated, unresolved or to scopes that are not there, against a walk of each edge."""
    rng = random.Random(5)
    up = {f"s{i}": (None if i % 9 == 0 else f"s{rng.randrange(i - i % 9, i)}") for i in range(45)}
    edges = [(str(i), rng.choice([None, "gone", *up]), rng.choice([None, "gone", *up])) for i in range(400)] + [(f"again{i}", "s3", "s8") for i in range(5)]

    def line(x):
        while x in up:
            yield x
            x = up[x]

    scopes = table(spark, [("f", s, p, "method") for s, p in up.items()], "file string, scope_id string, parent_scope_id string, kind string")
    for incoming in (True, False):
        near, far = (2, 1) if incoming else (1, 2)
        want = dict.fromkeys(up, 0)
        for e in edges:
            for s in set(line(e[near])) - set(line(e[far])):
                want[s] += 1
        assert as_set(K.fan(scopes, table(spark, edges, "edge_id string, from_scope string, to_scope string"), incoming), "scope_id", "n") == set(want.items())


def test_train_linear_hands_weights_from_range_to_range(spark):
    """More rows than a task is to hold at a time: the same steps in the same order, none refused."""
    rng = random.Random(11)
    rows = [(f"ep{i:03d}", rng.choice([1.0, -1.0]), 1.0, *[rng.random() for _ in range(4)]) for i in range(90)]
    df = table(spark, rows, f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}").repartition(5)
    whole, ranged = R.train_linear(df, epochs=3).first(), R.train_linear(df, epochs=3, block=25).first()
    assert ranged.weights == whole.weights and ranged.intercept == whole.intercept and ranged.train_loss == pytest.approx(whole.train_loss)


def test_train_batch_equals_a_plain_loop(spark):
    import numpy as np

    rng = random.Random(8)
    kind = f"episode_id string, label double, {', '.join(f'{c} double' for c in R.FEATURES)}"
    rows = [(f"ep{i}", rng.choice([1.0, -1.0]), 1.0, *[float(rng.randrange(3)) for _ in range(4)]) for i in range(80)]
    held = {r.episode_id for r in table(spark, rows, kind).where(S.hold_out("episode_id", 0.1)).collect()}
    kept = [r for r in rows if r[0] not in held]
    x, y = np.array([r[2:] for r in kept]), np.array([r[1] for r in kept])
    w, b, loss = np.zeros(5), 0.0, 0.0
    for _ in range(4):
        m = y * (x @ w + b)
        loss, pull = np.log1p(np.exp(-m)).mean(), y / (1 + np.exp(m))
        w, b = w + 0.1 * (pull[:, None] * x).mean(axis=0), b + 0.1 * pull.mean()
    got = R.train_batch(table(spark, rows, kind), epochs=4).first()
    assert held and got.weights == pytest.approx(w.tolist()) and got.intercept == pytest.approx(b) and got.train_loss == pytest.approx(loss)
    assert R.train_batch(table(spark, [], kind)).first().weights == [0.0] * 5


def test_effective_outcome_and_versions(spark):
    episodes = table(spark, [("a", "success", "2024-01-02"), ("b", "failure", "2024-01-02")], "episode_id string, outcome string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    updates = table(spark, [(1, "a", "x", "2024-01-01"), (2, "a", "y", "2024-01-03"), (3, "a", "z", "2024-01-03"), (4, "b", "w", "2024-01-01")], "update_id long, episode_id string, outcome string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    assert as_set(R.effective_outcome(episodes, updates), "episode_id", "effective_outcome") == {("a", "z"), ("b", "failure")}
    current = table(spark, [("c", 1, 2, 1), ("d", 1, 1, 1)], "concept_id string, version_index int, positive long, negative long")
    supports = table(spark, [("c", "e1", "positive"), ("c", "e2", "negative"), ("d", "e3", "positive")], "concept_id string, episode_id string, side string")
    seen = table(spark, [("c", "e1"), ("d", "e3")], "concept_id string, episode_id string")
    assert as_set(R.next_versions(current, supports, seen), "concept_id", "version_index", "positive", "negative", "confidence") == {("c", 2, 2, 2, 0.5)}


def test_duplication_over_parts_of_a_long_text_and_by_null_keys(spark):
    """A text of more windows than are hashed at a time, with a repeat across the edge; equal texts under other keys stay apart."""
    words = [str(i) for i in range(K.STEP + 200)]
    words[K.STEP - 30 : K.STEP + 30] = words[:60]
    again = " ".join(f"w{i}" for i in range(70))
    rows = [("long", "x", None, " ".join(words)), ("a", "p", None, again), ("b", None, "p", again), ("c", "p", "q", again), ("d", "p", "q", "v " + again), ("e", "p", "q", None)]
    df = spark.createDataFrame(rows, "file string, k1 string, k2 string, text string")
    assert {r["file"]: r["covered"] for r in K.duplication(df).collect()} == {"long": 120, "a": 0, "b": 0, "c": 0, "d": 0, "e": 0}
    got = {(r["k1"], r["k2"]): r["covered"] for r in K.duplication(df, ["k1", "k2"]).collect()}
    assert got == {("x", None): 120, ("p", None): 0, (None, "p"): 0, ("p", "q"): 140}


def test_portfolio_sorts_the_pooled_values_only(spark, monkeypatch):
    """Means of repositories come from the counts; one sort by ranges, of the pooled values."""
    from cairn.operators import ordered, samples

    names, held = [], ordered.cut
    monkeypatch.setattr(ordered, "cut", lambda df, name: (names.append(name), held(df, name))[1])
    rows = table(spark, [("r1", "k", "file", 1.0), ("r1", "k", "file", 1.0), ("r1", "k", "file", 4.0), ("r2", "k", "file", 8.0), ("r2", "k", "file", None)], "repo_id string, metric_kind string, scope_kind string, value double")
    got = samples.portfolio(rows).collect()
    assert [(r.total_observations, r.repo_count, r.weighted_mean, r.unweighted_mean, r.p50) for r in got] == [(4, 2, 3.5, 5.0, 2.5)]
    assert names == ["ranks"]
