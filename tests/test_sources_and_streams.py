import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import reports, sinks
from cairn.streaming import spans as T


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


XML = """<?xml version="1.0"?><coverage><packages><package name="p"><classes>
<class name="A" filename="src/a.py"><lines><line number="1" hits="0"/><line number="2" hits="3" branch="true" condition-coverage="50% (1/2)"/></lines></class>
<class name="B" filename="src\\a.py"><lines><line number="1" hits="2"/><line number="2" hits="0" branch="TRUE" condition-coverage="25% (1/4)"/></lines></class>
<class name="C" filename="./src/b.py"><lines><line number="7" hits="0"/></lines></class></classes></package></packages></coverage>"""


def test_coverage(spark, tmp_path):
    (tmp_path / "c.xml").write_text(XML)
    got = as_set(reports.coverage(spark, str(tmp_path / "c.xml")), "file_path", "lines_covered", "lines_valid", "branches_covered", "branches_valid")
    assert got == {("src/a.py", 2, 2, 1, 4), ("src/b.py", 0, 1, 0, 0)}
    (tmp_path / "bad.xml").write_text(XML.replace("(1/2)", "1 of 2"))
    with pytest.raises(Exception, match="malformed"):
        reports.coverage(spark, str(tmp_path / "bad.xml")).collect()


def test_payloads(spark, tmp_path):
    sha = "0123456789abcdef0123456789ABCDEF01234567"
    (tmp_path / "churn.json").write_text(json.dumps({"repo_id": "r", "rows": [{"sha": sha, "file_path": "a", "modified_at": "2024-01-01T00:00:00Z", "author": "x"}, {"sha": "12", "file_path": "a", "modified_at": "2024-01-01T00:00:00Z"}, {"sha": sha, "file_path": " ", "modified_at": "2024-01-01T00:00:00Z"}, {"sha": sha, "file_path": "a"}]}))
    assert as_set(reports.churn(spark, str(tmp_path / "churn.json")), "payload_row_index", "fault") == {(0, None), (1, "invalid_sha"), (2, "empty_file_path"), (3, "no_modified_at")}
    (tmp_path / "tests.json").write_text(json.dumps({"repo_id": "r", "rows": [{"scope_id": "s", "attempt_count": 4, "pass_count": 3}, {"scope_id": "t", "attempt_count": -1, "pass_count": 0}]}))
    assert as_set(reports.test_balance(spark, str(tmp_path / "tests.json")), "scope_id", "fault") == {("s", None), ("t", "negative_attempts")}
    (tmp_path / "defects.json").write_text(json.dumps({"repo_id": "r", "rows": [{"sha": sha, "file_path": "a", "defect_id": "d"}, {"sha": sha, "file_path": "a"}]}))
    assert as_set(reports.defects(spark, str(tmp_path / "defects.json")), "payload_row_index", "fault") == {(0, None), (1, "empty_defect_id")}


def test_trace_exports(spark, tmp_path):
    span = {"traceId": "ABCD", "spanId": "0F", "parentSpanId": "", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000000002500000", "attributes": [{"key": "n", "value": {"intValue": "7"}}, {"key": "service", "value": {"stringValue": "own"}}]}
    export = {"resourceSpans": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": "res"}}, {"key": "b", "value": {"boolValue": True}}]}, "scopeSpans": [{"spans": [span, {**span, "spanId": "10", "parentSpanId": "0F", "attributes": None}]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(export))
    rows = {r.span_id: r for r in reports.spans(spark.read.schema(reports.EXPORT).json(str(tmp_path / "t.json"))).collect()}
    assert rows["0f"].trace_id == "abcd" and rows["0f"].parent_span_id is None and rows["0f"].duration_ms == 2.5
    assert rows["0f"].attributes == {"n": "7", "service": "own", "b": "true"} and rows["10"].parent_span_id == "0f" and rows["10"].attributes["service"] == "res"


def test_tree_diff(spark, tmp_path):
    for version, files in (("v1", {"a": "1", "b": "2", "c/d": "3", "x": "same", "y": "same"}), ("v2", {"a": "1", "b": "9", "c/e": "3", "n": "new", "z": "same"})):
        for name, text in files.items():
            path = tmp_path / version / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    got = reports.tree_diff(*[reports.file_tree(spark, str(tmp_path / v)) for v in ("v1", "v2")])
    assert as_set(got, "path", "change", "old_path") == {("b", "modified", None), ("c/e", "renamed", "c/d"), ("n", "added", None), ("x", "deleted", None), ("y", "deleted", None), ("z", "added", None)}


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-05"), (2, "2024-02-05")], "id int, d string").select("id", F.col("d").cast("timestamp").alias("created_at"))
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "facts"), ["id"])
    stored = spark.read.parquet(str(tmp_path / "facts"))
    assert sorted(r.id for r in stored.collect()) == [1, 2] and stored.select("month").distinct().count() == 2


SPAN = "span_id int, repo_id string, namespace string, function string, signature string, filepath string, lineno string"


def test_resolution(spark):
    methods = spark.createDataFrame(
        [("r", "m1", "A", "f", "(int a)", "x.py", 1, 50), ("r", "m2", "A", "f", "(str a)", "x.py", 60, 90), ("r", "m3", "A", "g", "", "x.py", 10, 20), ("r", "m4", "B", "h", "(int)", "y.py", 1, 9), ("r", "m5", "C", "k", "(a)", "z.py", 1, 9), ("r", "m6", "C", "k", "", "z.py", 1, 9)],
        "repo_id string, node_id string, namespace string, function string, params string, file string, start_line int, end_line int",
    )
    blocks = spark.createDataFrame([("m1", "m1#0", 1, 25), ("m1", "m1#1", 26, 50)], "node_id string, block_id string, start_line int, end_line int")
    spans = spark.createDataFrame(
        [
            (1, "r", "A", "f", "f( int a )", "", "30"),  # signature decides, second block
            (2, "r", "A", "f", "", "", ""),  # ambiguous
            (3, "r", "A", "f", "(x)", "", ""),  # no signature fits
            (4, "r", "A", "g", "(whatever)", "", "15"),  # the only one, its parameters unknown
            (5, "r", "B", "h", "(str)", "", ""),  # the only one, another signature
            (6, "r", "A", "nope", "", "x.py", "15"),  # by line: the narrowest
            (7, "r", "", "", "", "./x.py", "500"),
            (8, "r", "", "", "", "", ""),
            (9, "r", "A", "nope", "", "", "x"),
            (10, "r", "C", "k", "(b)", "", ""),  # the one whose parameters are unknown
            (11, "r", "A", "f", "", "x.py", "70"),  # ambiguous by name, found by line
        ],
        SPAN,
    )
    got = {r.span_id: (r.status, r.node_id, r.block_id, r.reason) for r in T.resolve(spans, methods, blocks).collect()}
    assert got == {
        1: ("block", "m1", "m1#1", "name_matched"),
        2: ("unresolved", None, None, "ambiguous_name"),
        3: ("unresolved", None, None, "signature_mismatch"),
        4: ("method", "m3", None, "name_matched"),
        5: ("unresolved", None, None, "signature_mismatch"),
        6: ("method", "m3", None, "location_matched"),
        7: ("unresolved", None, None, "no_filepath_match"),
        8: ("unresolved", None, None, "missing_all_attributes"),
        9: ("unresolved", None, None, "no_name_match"),
        10: ("method", "m6", None, "name_matched"),
        11: ("method", "m2", None, "location_matched"),
    }


def test_spans_of_a_name_that_many_methods_share(spark):
    """Spans meet counts of methods and not the methods: a name of 500 methods gives no 500 rows a span."""
    methods = spark.range(500).selectExpr("'r' AS repo_id", "concat('n', id) AS node_id", "'C' AS namespace", "'m' AS function", "IF(id = 7, 'int a', '') AS params", "CAST(NULL AS STRING) AS file", "1 AS start_line", "2 AS end_line")
    blocks = methods.selectExpr("node_id", "concat(node_id, '#0') AS block_id", "start_line", "end_line")
    spans = spark.range(300).selectExpr("id AS span_id", "'r' AS repo_id", "'C' AS namespace", "'m' AS function", "IF(id % 2 = 0, 'int a', '') AS signature", "'' AS filepath", "'' AS lineno")
    out = T.resolve(spans, methods, blocks)
    assert {(r.node_id, r.reason, r["count"]) for r in out.groupBy("node_id", "reason").count().collect()} == {("n7", "name_matched", 150), (None, "ambiguous_name", 150)}
    assert "_params" in out._jdf.queryExecution().optimizedPlan().toString()
