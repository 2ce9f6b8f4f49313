"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a linear schedule of it over the training time 0..1. Its target is its share
of the words to be taken, stopped at ``most`` times what it holds; what is above goes to the others by
weight until nobody is above. The integral of the schedule, scaled to the target, is the source's
cumulative demand of words. Its documents are lined up in a fixed hashed order, pass after pass, and the
demand is inverted at the middle of each pass of a document: that instant is its training position. A
range sort by position gives the training order.

The mixed corpus has a document's text once for each pass; of the pass at which a source reaches its
target (one a source) it has only the words that are taken, the first ones.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, ordered
last; a source without words has target 0; rows equal in id, source and size stand next to each other in
an order that does not change any output; an empty table gives an empty result; the input may have columns
of any names, which come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import digits_for, hex_bucket, word_count

#: The weights in turn, and the schedule (at time 0, at time 1) that goes with each weight.
WEIGHTS = (3, 1, 2)
SCHEDULES = ((0.5, 1.5), (1.5, 0.5), (1.0, 1.0))
BUCKET = 1000  # rows of a source's bucket, about, were all rows of one source


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES) -> DataFrame:
    """From (source, words): source, source_size, weight, from_w, to_w, target. One row per source.

    Where sources stop is found in one pass: in the order of room per weight, those before a source stop
    exactly if the level at that source would exceed its own room.
    """
    by_source = sizes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("turn") + 1)
    by_source = by_source.withColumn("turn", turn).select("source", "source_size", pick(weights).alias("weight"), pick([float(a) for a, _ in schedules]).alias("from_w"), pick([float(b) for _, b in schedules]).alias("to_w"))
    room = F.col("source_size") * most
    order = Window.orderBy((room / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = by_source.withColumn("room", room).select(
        "*",
        F.coalesce(F.sum("room").over(earlier), F.lit(0)).alias("room_before"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("weight_left"),
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("total"),
    )
    # The first source that is not full sets the level for itself and for all after it.
    full = F.col("weight") * (F.col("total") - F.col("room_before")) >= F.col("room") * F.col("weight_left")
    level = level.withColumn("open", F.when(~full, F.struct("room_before", "weight_left")))
    first_open = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = level.withColumn("at", first_open)
    target = F.when(F.col("at").isNull(), F.col("room").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("at.room_before")) / F.col("at.weight_left"))
    return level.select("source", "source_size", "weight", "from_w", "to_w", target.alias("target"))


def invert(fraction: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule from start to end has delivered this fraction of its integral."""
    need = fraction * (start + end) / 2
    slope = end - start
    return F.when(slope == 0, fraction).otherwise(2 * need / (start + F.sqrt(start * start + 2 * slope * need)))


def positions(df: DataFrame, size: Column, share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """in (a struct of df's columns), id and mix: size, source_size, target, taken, and passes: array of (pass_no, words, position).

    A bucket of a source is one key, that of the window and of the join after it, so df's columns are shuffled once.
    """
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("in"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("words"))
    keyed = keyed.withColumn("order", F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("words")).cast("binary")))
    keyed = keyed.withColumn("bucket", hex_bucket(F.col("order"), digits_for(df.count(), BUCKET)))
    held = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    goal = targets(held, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    info = F.struct("start", "source_size", "from_w", "to_w", "target").alias("info")
    lane = F.struct("source", "bucket").alias("lane")  # structs are equal where a null source is on both sides
    starts = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.struct("s.source", "s.bucket").alias("lane"), info)
    inside = Window.partitionBy("lane").orderBy("order", "id", "words").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.select("in", "id", "words", "order", lane).withColumn("earlier", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = placed.join(starts, "lane").withColumn("start", F.col("info.start") + F.col("earlier"))
    info = F.col("info")
    goal_words = F.floor(info["target"])

    def one(number: int):
        start = F.col("start") + info["source_size"] * number
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), goal_words - start))
        when = invert(F.least(F.lit(1.0), (start + words / 2) / info["target"]), info["from_w"], info["to_w"])
        return F.when(words > 0, F.struct(F.lit(number).alias("pass_no"), words.alias("words"), F.round(when, 9).alias("position")))

    placed = placed.withColumn("passes", F.filter(F.array(*[one(k) for k in range(most)]), lambda x: x.isNotNull()))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    mix = F.struct(F.col("words").alias("size"), info["source_size"].alias("source_size"), info["target"].alias("target"), taken.alias("taken"), F.col("passes").alias("passes"))
    return placed.select("in", "id", mix.alias("mix"))


def report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, first_position (null if nothing)."""
    narrow = docs.select("doc_id", "source", word_count(text_col).alias("size"))
    mixed = positions(narrow, F.col("size"))
    return mixed.select(F.col("id").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", "mix.taken", F.try_element_at("mix.passes", F.lit(1))["position"].alias("first_position"))


def first_words(text: Column, words: Column) -> Column:
    """text up to the end of its word of this number. A possessive loop: no recursion, however many words."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def ordered(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The mixed corpus in training order: position, pass_no, words and in (a struct of docs' columns), a row for each pass that takes words of a document."""
    mixed = positions(docs, word_count(text_col))
    each = mixed.select("in", "id", "mix.size", F.explode("mix.passes").alias("pass"))
    part = F.when(F.col("pass.words") < F.col("size"), first_words(F.col(f"in.`{text_col}`"), F.col("pass.words")))
    each = each.withColumn("part", part)
    columns = []
    for c in docs.columns:
        own = F.col(f"in.`{c}`")
        if c == text_col:
            own = F.coalesce("part", own)
        elif c == length_col:
            own = F.when(F.col("part").isNotNull(), F.length("part").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    each = each.select("pass.position", "pass.pass_no", "pass.words", "id", F.struct(*columns).alias("in"))
    return each.repartitionByRange("position", "id", "pass_no").sortWithinPartitions("position", "id", "pass_no").drop("id")


def mix(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The mixed corpus in training order with the columns of docs; written out, part files are in this order."""
    return ordered(docs, text_col, length_col).select("in.*")
