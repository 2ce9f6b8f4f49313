"""WARC archives: a writer with revisit records and a salvage reader.

Archives are runs of gzip members, one record each, in files of a bounded size in a folder that all
executors see. A file is written under a name of the task's attempt and renamed when complete, so a lost
or repeated task leaves no half file behind.

The salvage reader takes members (or uncompressed records) one after another. A record counts if its
version line, header, length and, where it has one, block digest hold. After a failed check it searches
for the next gzip magic or version line that starts a valid record, goes on there, and logs the bytes
between as quarantined. The round trip counts what it read against the manifest and fails if a record is
missing.

What is a response is decided on ids, lengths and digests; payloads are then joined to responses only.

Defined cases: null content is an empty payload; equal payloads of any length, empty ones too, become one
response and revisits to it; of rows that share the largest id (equal rows too), the one with the largest
address is the response and the others revisit it; a null id ranks below all others and is null again when
read; an empty table gives no archive and an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.common import cut, shared_dir

VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
ARCHIVE_BYTES = 8 << 20  # an archive is closed once it has so many bytes
RUN = 1000  # copies of a row that are written together

RECORDS = T.StructType().add("archive", "string").add("offset", "long").add("target_uri", "string").add("record_type", "string").add("record_id", "string").add("refers_to_id", "string").add("page_id", "long").add("refers_to_page", "long").add("payload_digest", "string").add("payload_length", "long").add("payload", "binary").add("gap_bytes", "long").add("reason", "string")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(digest: str, number: int) -> str:
    """The name of copy ``number`` of what has this hexadecimal digest of 128 bits."""
    return f"<urn:uuid:{uuid.UUID(int=(int(digest, 16) + number) % 2**128)}>"


def record(kind: str, name: str, page: int | None, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None, refers_page: int | None = None) -> bytes:
    """One gzip member with one record. payload is the block: empty for a revisit. page: the row's id, kept in a header of its own."""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {length}",
        *([f"X-Page-ID: {page}"] if page is not None else []),
        *([f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        *([f"X-Refers-To-Page-ID: {refers_page}"] if refers_page is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(VERSION + "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + payload + b"\r\n\r\n") + coder.flush()


class Ahead:
    """Where marks are next in data. For places that only grow each mark's search reads the data once."""

    def __init__(self, data: bytes):
        self.data, self.seen = data, {}

    def find(self, mark: bytes, at: int) -> int:
        start, found = self.seen.get(mark, (-1, -1))
        if not start <= at <= found:
            found = self.data.find(mark, at)
            found = len(self.data) if found < 0 else found
            self.seen[mark] = (at, found)
        return found


def parse_plain(data: bytes, at: int, ahead: Ahead | None = None) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record whose version line is at this place; ValueError if a check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    first = data.find(b"\r\n", at, at + 16)
    stop = (ahead or Ahead(data)).find(b"\r\n\r\n", at)
    if first < 0 or stop == len(data):
        raise ValueError("header without end")
    head = {}
    for line in data[first + 2 : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise ValueError("no length or type")
    start, end = stop + 4, stop + 4 + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record cut off or wrong length")
    block = data[start:end]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise ValueError("block digest differs")
    return head, block, end + 4


def parse_at(data: bytes, at: int, ahead: Ahead | None = None) -> tuple[dict, bytes, int]:
    """The record at this place, in a gzip member or plain."""
    if not data.startswith(GZIP, at):
        return parse_plain(data, at, ahead)
    inflate, view, parts, end = zlib.decompressobj(31), memoryview(data), [], at
    while not inflate.eof and end < len(data):  # in slices, so that what follows the member is not copied
        piece = view[end : end + (16 << 10)]
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error as error:
            raise ValueError(f"bad member: {error}") from None
        end += len(piece)
    if not inflate.eof:
        raise ValueError("member cut off")
    end -= len(inflate.unused_data)
    plain = b"".join(parts)
    head, block, used = parse_plain(plain, 0)
    if used != len(plain):
        raise ValueError("member holds more than a record")
    return head, block, end


def salvage(data: bytes) -> Iterator[tuple[int, dict | None, bytes, int, str]]:
    """(offset, headers, block, 0, '') for each record; (offset, None, b'', bytes, reason) for each quarantined gap."""
    at, size, ahead = 0, len(data), Ahead(data)
    while at < size:
        try:
            head, block, end = parse_at(data, at, ahead)
        except ValueError as error:
            reason, found = str(error), at
            while True:
                found = min(ahead.find(GZIP, found + 1), ahead.find(b"WARC/1.", found + 1))
                if found == size:
                    break
                try:
                    parse_at(data, found, ahead)
                    break
                except ValueError:
                    pass
            yield at, None, b"", found - at, reason
            at = found
        else:
            yield at, head, block, 0, ""
            at = end


def plan_records(df: DataFrame, id_col: str, uri_col: str, content_col: str, min_bytes: int) -> DataFrame:
    """name, first, number, id, uri, payload, length, hash, refers_to, refers_page: records ``first`` to ``first + number - 1`` of a row (refers_to null for a response)."""
    payload = F.coalesce(F.col(content_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("hash"))
    rows = rows.withColumn("name", F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "length", "hash", "uri").cast("binary")))
    each = rows.groupBy("name", "id", "uri", "length", "hash").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("id").isNotNull().alias("has"), "id", "uri", "name")
    latest = each.where(F.col("length") >= min_bytes).groupBy("hash", "length").agg(F.max(rank).alias("latest"))
    decided = each.join(latest, ["hash", "length"], "left")
    alone = F.col("latest").isNull()
    refers = F.when(~alone, F.col("latest.name")).alias("refers_to"), F.when(~alone, F.col("latest.id")).alias("refers_page")
    responses = F.when(alone, F.col("copies")).when(F.col("latest.name") == F.col("name"), 1).otherwise(0)
    decided = decided.select("name", "id", "uri", "length", "hash", "copies", responses.alias("responses"), *refers)
    run = lambda start, count: F.explode(F.sequence(start, start + count - 1, F.lit(RUN).cast("long"))).alias("first")
    number = lambda end: F.least(F.lit(RUN), end - F.col("first")).cast("int").alias("number")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    shown = ["name", "first", "number", "id", "uri", "payload", "length", "hash", "refers_to", "refers_page"]
    whole = rows.groupBy("name").agg(F.first("payload").alias("payload"))  # equal rows become one before they are shuffled
    first = decided.where("responses > 0").select("name", "id", "uri", "length", "hash", "responses", run(zero, F.col("responses")), none.cast("string").alias("refers_to"), none.cast("long").alias("refers_page"))
    first = first.withColumn("number", number(F.col("responses"))).join(whole, "name").select(*shown)
    again = decided.where("copies > responses").select("*", run(F.col("responses").cast("long"), F.col("copies") - F.col("responses")))
    again = again.withColumn("number", number(F.col("copies"))).withColumn("payload", none.cast("binary")).select(*shown)
    return first.unionByName(again.repartition("name", "first"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", content_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write one record a row into archives under folder; the manifest (archive, records, bytes), as written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        out, name, size, count, part = None, "", 0, 0, []
        mark = uuid.uuid4().hex  # an archive of a repeated task differs in name; the manifest names the ones that count

        def close():
            out.close()
            files.move(f"{base}/{name}.open", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, first, number, page, uri, payload, length, digest, refers, refers_page = (batch.column(k)[i].as_py() for k in range(10))
                kind, digest = "response" if refers is None else "revisit", base64.b32encode(bytes.fromhex(digest)).decode()
                for copy in range(first, first + number):
                    if out is None:
                        name, size, count = f"{mark}-{len(part):05d}.warc.gz", 0, 0
                        out = files.open_output_stream(f"{base}/{name}.open")
                        part.append(name)
                    member = record(kind, record_id(own, copy), page, uri, payload or b"", digest, length, record_id(refers, 0) if refers else None, refers_page)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    manifest = f"{folder}/manifest"
    plan_records(df, id_col, uri_col, content_col, min_bytes).mapInArrow(work, "archive string, records long, bytes long").write.parquet(manifest)
    return df.sparkSession.read.parquet(manifest)


def read(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """Records and quarantined gaps (record_type null) of the archives under folder; with a manifest, of those it names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data, rows, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [], 0
                for offset, head, block, gap, reason in salvage(data):
                    if head is None:
                        rows.append((name, offset, *[None] * 9, gap, reason))
                    else:
                        length = head.get("x-payload-length", str(len(block)))
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        pages = (int(x) if x.lstrip("-").isdigit() else None for x in (head.get("x-page-id", ""), head.get("x-refers-to-page-id", "")))
                        rows.append((name, offset, head.get("warc-target-uri"), head["warc-type"], head.get("warc-record-id"), head.get("warc-refers-to"), *pages, digest, int(length) if length.isdigit() else None, block, 0, None))
                        held += len(block)
                    if held > 8 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names=RECORDS.names)

    if archives is not None and not archives.take(1):
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("archive"), "content")
    if archives is not None:
        files = files.join(archives.select("archive"), "archive", "left_semi")
    return files.mapInArrow(work, RECORDS)


def round_trip(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", content_col: str = "html") -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, checked.

    Length and digest of a response are taken from the block that was read; those of a revisit are what its
    header says of the full payload. checked: the response's digest is the one in its header. An error if a
    record that was written is not read.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write(df, folder, id_col, uri_col, content_col)
    found = cut(digests(read(spark, folder, manifest)), "warc-records")
    written, there = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], found.count()
    if written != there:
        raise RuntimeError(f"{written} records were written and {there} read; read() tells the quarantined gaps")
    return found


def digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, checked of the records of read()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, kind, refers, digest, length, block = (batch.column(k)[i].as_py() for k in range(6))
                own = sha1_base32(block)
                is_response = kind == "response"
                rows.append((page, len(block) if is_response else length, own if is_response else digest, kind, None if is_response else refers, not is_response or own == digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "checked"]
    narrow = records.where(F.col("record_type").isNotNull()).select("page_id", "record_type", "refers_to_page", "payload_digest", "payload_length", "payload")
    return narrow.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, checked boolean")
