"""Building blocks: the newest row of a key, counts of values, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it. Only a local session has a default."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "/tmp/cairn-checkpoints"
    return f"{where.rstrip('/')}/cairn"


_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scratch scopes", default=())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of an iteration: write df to the shared folder and read it back."""
    return _written(df, name, _scopes.get())


def _written(df: DataFrame, name: str, scopes: tuple[set[str], ...]) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for scope in scopes:  # before it is written, so that what a failed query leaves goes too
        scope.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end what is cut inside by this thread, but for what the function that this gives has cut: the results.

    Results belong to the scope around this one, if there is one. Scopes are the context's own: what another
    thread cuts meanwhile is not theirs.
    """
    outer, mine = _scopes.get(), set()
    token = _scopes.set((*outer, mine))
    try:
        yield lambda df, name: _written(df, name, outer)
    finally:
        _scopes.reset(token)
        delete(spark, mine)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders of any store that Spark writes; those that are not there do not matter."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row of each key that is largest by order, nulls least.

    A row number cut to the first: each task keeps one row of a key before the shuffle, so that a hot key moves
    one row a task. (max_by of a row with strings would be an aggregate by sorting.)
    """
    largest = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    return df.withColumn("_latest", F.row_number().over(Window.partitionBy(*keys).orderBy(*largest))).where("_latest = 1").drop("_latest")


def without(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone."""
    return df.join(tombstones.select(key), key, "left_anti")


PAIR_ROWS = PAIR_DST = 256  # about so many rows of the left, of the right in a block; a task holds the pairs of two blocks before it writes them
PAIR_TILES = 128  # about so many blocks of the right with the same keys are held at a time


def pairs_once(left: DataFrame, right: DataFrame, keys: Sequence[str], dst: str = "dst") -> DataFrame:
    """left's columns and dst of rows that share the keys, each (left's other columns, dst) once. left: keys, others; right: keys, dst.

    Where a dst has one key only, pairs of distinct rows are distinct already, so they are written as they are
    met; only the pairs of a dst with several keys are compared with each other.
    """
    left, right = left.distinct(), right.distinct()
    others = [c for c in left.columns if c not in keys]
    many = right.where(F.col(dst).isNotNull()).groupBy(dst).agg(F.count("*").alias("_keys")).where("_keys > 1").select(dst)
    plain = _pairs(left, right.join(many, dst, "left_anti").where(F.col(dst).isNotNull()), keys, others, dst)
    several = left.join(right.join(many, dst, "left_semi").unionByName(right.where(F.col(dst).isNull())), list(keys)).select(*others, dst).distinct()
    return plain.unionByName(several)


def _pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], others: Sequence[str], dst: str) -> DataFrame:
    """others, dst of distinct rows that share the keys, block against block.

    What is shuffled and sorted is pairs of blocks, dealt by ranges of keys and blocks, so that a key is no
    task's alone. A block's pairs come together: a row of the left with all dst, then the next with the same,
    which a columnar file keeps as runs and repeats.
    """

    def blocks(rows: DataFrame, each: Column, size: int, name: str) -> DataFrame:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        dealt = rows.join(counts, list(keys)).withColumn(name, F.pmod(F.xxhash64(each), F.ceil(F.col("_n") / size)))
        return dealt.groupBy(*keys, name).agg(F.collect_list(each).alias(f"{name}s"), F.first("_n").alias("_n"))

    groups = F.ceil(F.col("_n") / (PAIR_DST * PAIR_TILES)).cast("int")
    tiles = blocks(right, F.col(dst), PAIR_DST, "_dst").withColumn("_group", F.pmod("_dst", groups)).drop("_n")
    held = right.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.explode(F.sequence(F.lit(0), groups - 1)).alias("_group"))
    rows = blocks(left, F.struct(*others), PAIR_ROWS, "_row").drop("_n").join(held, list(keys))
    met = rows.join(tiles, [*keys, "_group"])
    order, parts = [*keys, "_dst", "_row"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select(F.inline("_rows"), "_dsts").select(*others, F.explode("_dsts").alias(dst))


def likely(rows: DataFrame, chosen: DataFrame, named: Sequence[str]) -> DataFrame:
    """Rows whose names may be among the chosen, by 2^24 bits (a broadcast of fixed size); so the other texts are not shuffled."""
    slot = F.xxhash64(*[part for c in named for part in (F.col(c).isNull(), F.col(c))]).bitwiseAND(F.lit((1 << 24) - 1))
    word, bit = F.shiftright(slot, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = chosen.groupBy(word).agg(F.bit_or(bit).alias("_set"))
    return rows.withColumn("_word", word).join(F.broadcast(words), "_word").where(F.col("_set").bitwiseAND(bit) != 0).drop("_word", "_set")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, _v, _n: how often each value occurs; nulls do not count."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def keyset_after(keys: Sequence[str], last: Sequence) -> Column:
    """Row-value comparison (keys) > (last), spelled out so that the first key can be pushed to the scan."""
    out = None
    for k in range(len(keys)):
        step = F.col(keys[k]) > F.lit(last[k])
        for same in range(k):
            step = (F.col(keys[same]) == F.lit(last[same])) & step
        out = step if out is None else out | step
    return out


def any_of_or_all(column: str, values: Sequence | None) -> Column:
    """Membership; an empty or absent list means every row."""
    return F.col(column).isin(*values) if values else F.lit(True)


def hydrate(ids: DataFrame, key: str, array: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """One row for each element of an array of ids, in its order and with ids that have no fact."""
    each = ids.select(key, F.posexplode(array).alias("position", fact_key))
    return each.join(facts, fact_key, "left")


def insert_new(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that an idempotent insert adds: one for each key that the target lacks."""
    return rows.join(target.select(*key).distinct(), list(key), "left_anti").dropDuplicates(list(key))
