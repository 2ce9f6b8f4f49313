"""Readers of external reports: coverage XML, change, defect and test payloads, trace exports, file trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S

LINE = "STRUCT<_number: INT, _hits: INT, _branch: STRING, `_condition-coverage`: STRING>"
CLASS = f"_filename STRING, lines STRUCT<line: ARRAY<{LINE}>>"
SHA = r"^[0-9a-fA-F]{40}$"


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage reports: file_path, lines_covered, lines_valid, branches_covered, branches_valid.

    A row of the XML reader is a class element, so a report of any size is read in rows. A line that several
    classes report has its largest number of hits, covered and valid branches. Malformed lines (number below
    1, negative hits, a branch without a condition share) raise an error.
    """
    classes = spark.read.format("xml").option("rowTag", "class").schema(CLASS).load(path)
    lines = classes.select(S.normalise_path("_filename").alias("file_path"), F.explode("lines.line").alias("l"))
    share = lambda n: F.regexp_extract(F.coalesce(F.col("l._condition-coverage"), F.lit("")), r"\((\d+)/(\d+)\)", n).try_cast("int")
    branch = F.lower(F.trim(F.coalesce(F.col("l._branch"), F.lit("")))) == "true"
    wrong = (F.col("l._number") < 1) | (F.col("l._hits") < 0) | (branch & F.coalesce(share(2) <= 0, F.lit(True))) | (branch & (share(1) > share(2)))
    sound = lines.select("file_path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"), F.when(branch, share(1)).alias("covered"), F.when(branch, share(2)).alias("valid"), F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("malformed coverage line in "), "file_path"))).alias("_wrong")).where("_wrong IS NULL")
    merged = sound.groupBy("file_path", "line").agg(*[F.max(c).alias(c) for c in ("hits", "covered", "valid")])
    return merged.groupBy("file_path").agg(
        F.count(F.when(F.col("hits") > 0, 1)).alias("lines_covered"), F.count("*").alias("lines_valid"), F.coalesce(F.sum("covered"), F.lit(0)).alias("branches_covered"), F.coalesce(F.sum("valid"), F.lit(0)).alias("branches_valid")
    )


def _payload(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of JSON payloads (one a line) with their index."""
    read = spark.read.schema(f"repo_id STRING, rows ARRAY<STRUCT<{row}>>").json(path)
    return read.select("repo_id", F.posexplode("rows").alias("payload_row_index", "r")).select("repo_id", "payload_row_index", "r.*")


def _fault(*cases: tuple[Column, str]) -> Column:
    out = F
    for wrong, name in cases:
        out = out.when(F.coalesce(wrong, F.lit(True)), name)
    return out


def churn(spark: SparkSession, path: str) -> DataFrame:
    """Change rows with fault (null for valid rows): the caller keeps one side or the other."""
    rows = _payload(spark, path, "sha: STRING, file_path: STRING, modified_at: TIMESTAMP, author: STRING")
    fault = _fault((F.trim("repo_id") == "", "empty_repo_id"), (F.trim("sha") == "", "empty_sha"), (~F.rlike("sha", F.lit(SHA)), "invalid_sha"), (F.trim("file_path") == "", "empty_file_path"), (F.col("modified_at").isNull(), "no_modified_at"))
    return rows.withColumn("fault", fault)


def defects(spark: SparkSession, path: str) -> DataFrame:
    """Defect rows with fault; they are stored and feed no metric."""
    rows = _payload(spark, path, "sha: STRING, file_path: STRING, defect_id: STRING, severity: STRING")
    return rows.withColumn("fault", _fault((~F.rlike("sha", F.lit(SHA)), "invalid_sha"), (F.trim("file_path") == "", "empty_file_path"), (F.trim("defect_id") == "", "empty_defect_id")))


def test_balance(spark: SparkSession, path: str) -> DataFrame:
    """scope_id, attempt_count, pass_count, fault."""
    rows = _payload(spark, path, "scope_id: STRING, attempt_count: BIGINT, pass_count: BIGINT")
    return rows.withColumn("fault", _fault((F.trim("scope_id") == "", "empty_scope_id"), (F.col("attempt_count") < 0, "negative_attempts"), (F.col("pass_count") < 0, "negative_passes")))


#: The JSON form of a trace export.
ANY_VALUE = "STRUCT<stringValue: STRING, intValue: STRING, doubleValue: DOUBLE, boolValue: BOOLEAN>"
ATTRIBUTES = f"ARRAY<STRUCT<key: STRING, value: {ANY_VALUE}>>"
SPAN = f"STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {ATTRIBUTES}>"
EXPORT = f"resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: {ATTRIBUTES}>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<{SPAN}>>>>>"


def _attributes(column: str) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), F.lit(""))
    pairs = F.transform(F.filter(F.coalesce(F.col(column), F.array().cast(ATTRIBUTES)), lambda a: a["key"].isNotNull()), lambda a: F.struct(a["key"].alias("key"), text(a["value"]).alias("value")))
    return F.map_from_entries(F.array_distinct(pairs))


def spans(exports: DataFrame) -> DataFrame:
    """Spans of trace exports (column resourceSpans, batch or stream): trace_id, span_id, parent_span_id, started_at, duration_ms, attributes.

    Attribute values become text, ids lower-case hexadecimal; an empty parent is null.
    """
    each = exports.select(F.explode("resourceSpans").alias("r")).select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("p"))
    nanos = lambda c: F.col(f"p.{c}").cast("decimal(20,0)")
    own = F.map_filter(_attributes("resource.attributes"), lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(_attributes("p.attributes")), k), F.lit(False)))
    return each.select(
        F.lower("p.traceId").alias("trace_id"),
        F.lower("p.spanId").alias("span_id"),
        F.when(F.col("p.parentSpanId") != "", F.lower("p.parentSpanId")).alias("parent_span_id"),
        F.timestamp_micros((nanos("startTimeUnixNano") / 1000).cast("long")).alias("started_at"),
        ((nanos("endTimeUnixNano") - nanos("startTimeUnixNano")).cast("double") / 1e6).alias("duration_ms"),
        F.map_concat(own, _attributes("p.attributes")).alias("attributes"),
    )


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), length, digest, content of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^.*?" + folder.strip("/").replace(".", r"\.") + "/", "").alias("path"), "length", F.sha2("content", 256).alias("digest"), "content")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, old_path: added, modified, deleted, or renamed where one deleted and one added file alone share a digest. Both: path, digest."""
    both = before.select("path", F.col("digest").alias("_old")).join(after.select("path", F.col("digest").alias("_new")), "path", "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    changes = both.withColumn("change", kind).where("change IS NOT NULL")
    side = lambda change, digest, name: changes.where(F.col("change") == change).groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("_n"), F.min("path").alias(name)).where("_n = 1").drop("_n")
    renamed = side("deleted", "_old", "old_path").join(side("added", "_new", "path"), "digest").select("path", F.lit("renamed").alias("change"), "old_path")
    rest = changes.join(renamed.select("path"), "path", "left_anti").join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.select("path", "change", F.lit(None).cast("string").alias("old_path")).unionByName(renamed)
