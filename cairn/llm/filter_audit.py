"""Filter interaction audit: what each filter removes in every order of the filters, by part of the corpus.

A document's failures are a mask of five bits. With five filters there are 32 masks and 120 orders, so the step
at which an order removes a document is a look-up in a table of 32 by 120. Tasks add up documents by part,
order, step and label with one bincount a batch; their arrays are summed level by level.

Filters (word: a maximal run without space, tab, LF, VT, FF, CR; case matters). A document fails
A: with fewer than 50 words; B: if 100 * distinct words < 65 * words; C: if 100 * letters A-Z > 5 * code
points; D: if it has one of # $ % & * |; E: if a document with a smaller id, removed or not, has the same text.

Defined cases: a null text is the empty text (fails A; equal to other empty texts); a null source is the part
''; a null id is never smaller and never larger, so such a row does not fail E and makes nobody fail it;
repeated rows (same id) count each, and do not fail E by each other; labels of an id are joined over its rows
(any quality of 1 is good, any toxic of 1 is toxic), ids without labels are neither; an empty table gives no
rows; further columns are ignored, whatever their names. Texts with the same SHA-256 count as the same.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
MASKS, STEPS, LABELS = 1 << len(FILTERS), len(FILTERS) + 1, 4  # the last step: removed by none; labels: good + 2 * toxic
CELLS = LABELS * len(ORDERS) * STEPS
WIDTH = CELLS + LABELS * MASKS  # removals, then documents by label and mask
FAN = 64  # arrays of a part that one row of the next level sums
PARTS = 500  # parts that a task holds before it lets go of their arrays

_SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def first_failures() -> np.ndarray:
    """The step (from 0) at which each of the 120 orders removes a document with each of the 32 masks; 5: none does."""
    fails = (np.arange(MASKS)[:, None, None] >> np.array(ORDERS)[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), len(FILTERS))


def own_failures(text: bytes) -> int:
    """The bits of filters A to D for a text in UTF-8."""
    words = text.split()  # splits bytes at exactly the six characters
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * capitals > 5 * points) << 2 | (_SIGNS.search(text) is not None) << 3


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [x.as_py() for x in part.column(2)]
            masks, digests = [own_failures(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (five bits, A lowest), label (good + 2 * toxic), n: documents in groups; a part's groups may repeat.

    Rows are counted before each shuffle, so that copies and repeated rows travel once for each task. Of a
    group of equal texts there is one row for each part and label; the smallest id of all is a window over those.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bare = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = bare.mapInArrow(_read, f"doc_id {kind}, part string, mask int, digest binary").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("doc_id")).agg((F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")) + 2 * F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int"))).alias("label"))
    rows = rows.join(marks.where("doc_id IS NOT NULL"), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    same = rows.groupBy("digest", "part", "mask", "label").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts"))
    least = F.min("first").over(Window.partitionBy("digest"))
    same = same.withColumn("stays", F.col("nameless") + F.when(F.col("first") == least, F.col("firsts")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    return same.select("part", "label", F.explode(both).alias("x")).select("part", "x.mask", "label", "x.n").where("n > 0")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of the task: its array of counts (WIDTH); the task's number."""
    table = (np.arange(len(ORDERS)) * STEPS)[None] + first_failures()
    held: dict[str, np.ndarray] = {}
    task = TaskContext.get().partitionId()

    def release() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([task] * len(held), pa.int64()), pa.array([list(x) for x in held.values()], pa.list_(pa.int64()))], names=["part", "task", "counts"])
        held.clear()
        return out

    for batch in batches:
        part = batch.column(0).dictionary_encode()
        names, codes = part.dictionary.to_pylist(), part.indices.to_numpy(zero_copy_only=False)
        mask, label, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        for low in range(0, len(names), 64):  # 64 parts at once, so that the counters stay small
            here = (codes >= low) & (codes < low + 64)
            code, some = codes[here] - low, min(64, len(names) - low)
            cell = (code * LABELS + label[here])[:, None] * (len(ORDERS) * STEPS) + table[mask[here]]
            removed = np.bincount(cell.ravel(), np.repeat(n[here], len(ORDERS)), some * CELLS).reshape(some, CELLS)
            masks = np.bincount((code * LABELS + label[here]) * MASKS + mask[here], n[here], some * LABELS * MASKS).reshape(some, LABELS * MASKS)
            for name, counts in zip(names[low : low + 64], np.hstack([removed, masks]).astype(np.int64), strict=True):
                held[name] = held[name] + counts if name in held else counts
        if len(held) >= PARTS:
            yield release()
    if held:
        yield release()


def _sum(arrays: DataFrame, *keys: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    return arrays.groupBy(*keys).agg(F.aggregate(F.collect_list("counts"), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("counts"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = np.array(ORDERS)
    letters = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    bits = (np.arange(MASKS)[:, None] >> np.arange(len(FILTERS))[None]) & 1
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = counts.values.to_numpy()
            by_label = counts[:CELLS].reshape(LABELS, len(ORDERS), STEPS)
            masks = counts[CELLS:].reshape(LABELS, MASKS).sum(axis=0)
            removed = by_label.sum(axis=0)[:, :-1]
            failing, alone = masks @ bits, masks[1 << np.arange(len(FILTERS))]
            shapley = np.zeros(len(FILTERS), np.int64)
            np.add.at(shapley, orders, removed)
            columns = {
                "kept": masks.sum() - removed.cumsum(axis=1),
                "removed": removed,
                "redundant": failing[orders] - removed,
                "unique_fails": alone[orders],
                "good_lost": (by_label[1] + by_label[3])[:, :-1],
                "toxic_lost": (by_label[2] + by_label[3])[:, :-1],
                "shapley": shapley[orders],
            }
            rows = orders.size
            fixed = [pa.array([part] * rows), pa.array(np.repeat(letters, len(FILTERS))), pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(c.ravel().astype(np.int64)) for c in columns.values()]], names=["part", "filter_order", "step", *columns])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step (1 to 5), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    found = failures(docs, labels, id_col, text_col, part_col)
    arrays = found.select("part", "mask", "label", "n").mapInArrow(_partial, "part string, task long, counts array<long>")
    arrays = _sum(arrays.withColumn("task", F.expr(f"task div {FAN}")), "part", "task")
    return _sum(arrays, "part").mapInArrow(_report, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
