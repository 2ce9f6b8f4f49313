"""Linked edges from pages, structural tokens, and faults of rule texts, on small tables."""

from pyspark.sql import functions as F

from cairn.operators import code_metrics as K
from cairn.operators import graph as G
from cairn.operators import predicate_text as T
from cairn.sources import linked


def test_linked_edges(spark, tmp_path):
    path = str(tmp_path / "pages")
    own = spark.createDataFrame([("a", "b")], "src string, dst string")
    found, reason = linked.with_linked(own, path)
    assert reason == linked.ABSENT and found.count() == 1
    edges = [("r", "s1", f"n{i}", f"n{i + 1}", "calls") for i in range(25)] + [("r", "s1", "b", "n0", "calls"), ("q", "s1", "x", "y", "imports"), ("r", "s1", "z", None, "calls")]
    frame = spark.createDataFrame(edges, "repo_id string, sha string, src string, dst string, kind string")
    for _ in range(2):  # pages that come twice change nothing
        linked.export(frame, path, 10)
    pages = spark.read.schema(linked.PAGE).json(path)
    assert pages.where("repo_id = 'r'").select("cursor").distinct().count() > 1
    assert {tuple(r) for r in linked.read(spark, path, ["calls"]).select("src", "dst").collect()} == {(s, d) for _, _, s, d, k in edges if k == "calls" and d}
    found, reason = linked.with_linked(own, path, ["calls"])
    radius = {r.node: r.blast_radius for r in G.blast_radius(found, spark.createDataFrame([("a",), ("none",)], "node string")).collect()}
    assert reason is None and radius == {"a": 27, "none": 0}


def test_structural_tokens(spark):
    scopes = [("f", "file", "f", "f", 1, 0), ("f", "class", "A", "p.A", 1, 0), ("f", "method", "", "p.A.m", 2, 7), ("f", "interface", None, None, 2, 3), ("f", "weird", "w", "w", 9, 0), ("g", "file", "g", "g", 1, 0)]
    symbols = [("f", "field", "x", 2, 5), ("h", "field", "y", 1, 1)]
    got = K.structural_tokens(spark.createDataFrame(scopes, "file string, kind string, name string, qualified_name string, start_line int, start_byte int"), spark.createDataFrame(symbols, "file string, kind string, name string, start_line int, start_byte int"))
    assert {r.file: r.tokens for r in got.collect()} == {"f": ["class:A", "iface:", "sym:field:x", "method:p.A.m", "unk:w"], "g": [], "h": ["sym:field:y"]}
    ratio = {r.file: (r.tokens, r.duplication_ratio) for r in K.duplicated_tokens(spark.createDataFrame([("f", ["a", "b"] * 60), ("g", [])], "file string, tokens array<string>"), "tokens").collect()}
    assert ratio == {"f": (120, 1.0), "g": (0, 0.0)}


def test_faults_of_rule_texts(spark):
    texts = [(1, "value > 5"), (2, "value = 5"), (3, None), (4, "true AND\n loc > 1"), (5, "")]
    got = {r.n: r.fault and (r.fault.kind, r.fault.line, r.fault.col) for r in T.faults(spark.createDataFrame(texts, "n int, text string")).collect()}
    assert got[1] is None and got[2] == ("lex", 1, 7) and got[4] == ("semantic", 2, 2) and got[3] == got[5] and got[3][0] == "parse"
    assert T.faults(spark.createDataFrame([], "n int, text string")).where(F.col("fault").isNotNull()).count() == 0
