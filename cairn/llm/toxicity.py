"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a weighted lexicon (words and word beginnings that labelled toxic texts
have far more often, learned from the training rows), hits near second-person words, capitals,
punctuation, obfuscated spellings, elongations and length. Lexicon features of a training row come from
the half of the rows it is not in, so that the trees see them as they will be on new texts. The trees are
fitted on seven tenths of the training rows, the isotonic map from their probability to the observed rate
on the rest.

Bounds: at most TRAIN_ROWS labelled rows (those with the smallest hashed ids) and LEXICON entries.

Defined cases: a null or empty text has the score of its features, which are zeros; without labels of both
kinds every score is the rate of toxic labels (0 without labels); equal texts get equal scores; labels of
documents that aren't there and null labels are ignored; a document with several labels counts with the
largest; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.common import cut, scratch

TRAIN_ROWS, LEXICON = 20_000, 4_000
LEAST_G, SURE = 12.0, 25.0  # evidence that an entry needs, and that gives it its full weight
SHORTEST, LONGEST = 3, 8  # word beginnings of so many letters
FEATURES = ("density", "strong_share", "strong_count", "top_mean", "mass", "address", "address_hits", "capitals", "punctuation", "obfuscated", "elongated", "size", "peak")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros".split())
_fold = str.maketrans("013457@$!|", "oieastasil")
_word = re.compile(r"[^\W\d_]+")
OTHER, LETTER, ODD, SPACE = range(4)
_CODES = 0x110000


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its kind, its lower case (a space for all but letters), whether it is upper case."""
    kind, low, upper = np.full(_CODES, OTHER, np.uint8), np.full(_CODES, 32, np.uint32), np.zeros(_CODES, bool)
    for code in (*range(0x40000), *range(0xE0000, 0xE0200)):  # what lies between and above is unassigned or private
        c = chr(code)
        if c.isdecimal() or c in "@$!|*._-":
            kind[code] = ODD
        elif c.isalnum():
            kind[code], low[code], upper[code] = LETTER, ord(c.lower()[0]), c.isupper()
        elif c.isspace():
            kind[code] = SPACE
    return kind, low, upper


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def words(text: str, codes: np.ndarray | None = None) -> tuple[list[str], int]:
    """Lower-case words, obfuscated ones as plain letters too, and how many were obfuscated: signs or digits between letters."""
    codes = code_points(text) if codes is None else codes
    kind, low, _ = _tables()
    kinds = kind[codes]
    flat = low[codes].tobytes().decode("utf-32-le", "surrogatepass")
    starts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1 if len(kinds) else np.zeros(0, np.int64)
    runs = kinds[np.concatenate(([0], starts))] if len(kinds) else kinds
    marks = starts[:-1][(runs[1:-1] == ODD) & (runs[:-2] == LETTER) & (runs[2:] == LETTER)] if len(runs) > 2 else starts[:0]
    if not len(marks):
        return flat.split(), 0
    spaces = np.flatnonzero(kinds == SPACE)
    out, odd, done = [], 0, 0
    for k in np.unique(np.searchsorted(spaces, marks)).tolist():
        start = int(spaces[k - 1]) + 1 if k else 0
        end = int(spaces[k]) if k < len(spaces) else len(text)
        out.extend(flat[done:start].split())
        token = text[start:end].lower()
        if not token.startswith(("http", "www.")):
            plain = "".join(_word.findall(re.sub(r"[*._-]", "", token).translate(_fold)))
            if plain:
                odd += 1
                out.append(plain)
        out.extend(flat[start:end].split())
        done = end
    out.extend(flat[done:].split())
    return out, odd


def parts(word: str) -> Iterator[str]:
    """What the lexicon may hold of a word: the word (marked) and its beginnings."""
    yield f"{word}$"
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]


class _Parts(dict):
    """Words to their parts."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = self[word] = tuple(parts(word))
        return found


class Lexicon:
    """Weights of words, with a bounded memory of words seen; heavy holds those of them with a weight."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memory, self.heavy = weights, {}, {}

    def hits(self, counts: Counter) -> dict[str, float]:
        """The words that have a weight, in alphabetical order."""
        if len(self.memory) > 300_000:
            self.memory.clear()
            self.heavy.clear()
        for word in set(counts).difference(self.memory):
            self.memory[word] = weight = max((self.weights.get(p, 0.0) for p in parts(word)), default=0.0)
            if weight > 0:
                self.heavy[word] = weight
        return {word: self.heavy[word] for word in sorted(counts.keys() & self.heavy.keys())}


def elongated(codes: np.ndarray) -> int:
    """Runs of three or more equal letters."""
    same = codes[1:] == codes[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    at = at[_tables()[0][codes[at]] == LETTER]
    return int(len(at) - (np.diff(at) == 1).sum())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    codes = code_points(text)
    found, odd = words(text, codes)
    n = max(1, len(found))
    counts = Counter(found)
    hits = lexicon.hits(counts)
    mass = sum(v * counts[w] for w, v in hits.items())
    strong = sum(counts[w] for w, v in hits.items() if v >= 1.5)
    near = peak = 0.0
    close = 0
    if strong:
        marks = [i for i, w in enumerate(found) if hits.get(w, 0) >= 1.5]
        if not counts.keys().isdisjoint(SECOND_PERSON):
            persons = [i for i, w in enumerate(found) if w in SECOND_PERSON]
            j = 0
            for i in marks:
                while j + 1 < len(persons) and abs(persons[j + 1] - i) <= abs(persons[j] - i):
                    j += 1
                distance = abs(persons[j] - i)
                near += 1 / (1 + distance)
                close += distance <= 8
        start = total = 0
        for end, i in enumerate(marks):  # the heaviest stretch of 50 words
            total += hits[found[i]]
            while marks[end] - marks[start] >= 50:
                total -= hits[found[marks[start]]]
                start += 1
            peak = max(peak, total)
    top = sorted(hits.values(), reverse=True)[:3]
    letters = max(1, sum(map(len, found)))
    return [mass / n, strong / n, math.log1p(strong), sum(top) / 3, math.log1p(mass), near / n, math.log1p(close), int(_tables()[2][codes].sum()) / letters, (text.count("!") + text.count("?")) / n, odd / n, elongated(codes) / n, math.log1p(len(found)), peak]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic, fold (0 or 1), calibrate: the training rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.md5(F.concat(F.lit("train"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = there.withColumn("_order", order).orderBy("_order", "doc_id").limit(rows)
    part = F.conv(F.substring("_order", 1, 6), 16, 10).cast("int")
    chosen = chosen.select("doc_id", "toxic", (part % 2).alias("fold"), ((part / 2).cast("int") % 10 >= 7).alias("calibrate"))
    return cut(docs.select("doc_id", "text").join(chosen, "doc_id"), "toxicity-train")


def learn_lexicon(sample: DataFrame, entries: int = LEXICON) -> list[dict[str, float]]:
    """Three lexicons: from all rows, and for fold 0 and 1 from the rows of the other fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, uses = defaultdict(Counter), defaultdict(Counter)  # by label and fold: texts with a part, and its uses
        split = _Parts()
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = words(text or "")[0]
                texts[toxic, fold].update({"", *chain.from_iterable(map(split.__getitem__, set(found)))})
                uses[toxic, fold].update(chain.from_iterable(map(split.__getitem__, found)))
                uses[toxic, fold][""] += len(found)
                if len(split) > 50_000:
                    split.clear()
                if sum(map(len, uses.values())) > 250_000:
                    yield from flush(texts, uses)
        yield from flush(texts, uses)

    def flush(*tables: dict[tuple[int, int], Counter]) -> Iterator[pa.RecordBatch]:
        for what, table in enumerate(tables):
            for (toxic, fold), seen in table.items():
                same = [pa.array([v] * len(seen), pa.int32()) for v in (toxic, fold, what)]
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *same, pa.array(list(seen.values()), pa.int64())], names=["part", "toxic", "fold", "what", "n"])
            table.clear()

    counts = sample.select("text", "toxic", "fold").mapInArrow(count, "part string, toxic int, fold int, what int, n long")
    cell = lambda toxic, fold, what: F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold) & (F.col("what") == what), F.col("n")).otherwise(0))
    table = counts.groupBy("part").agg(*[cell(t, f, w).alias(f"{('n', 't')[t]}{f}{('d', 'w')[w]}") for t in (0, 1) for f in (0, 1) for w in (0, 1)])
    table = cut(table, "toxicity-counts")
    totals = table.where("part = ''").first()
    if totals is None:
        return [{}, {}, {}]
    out = []
    for folds in ((0, 1), (1,), (0,)):  # what fold 0 is scored with comes from fold 1, and the other way round
        total = {c: sum(totals[f"{c[0]}{f}{c[1]}"] for f in folds) for c in ("td", "tw", "nd", "nw")}
        add = lambda c: sum((F.col(f"{c[0]}{f}{c[1]}") for f in folds), F.lit(0))  # noqa: B023, E731
        td, nd = add("td"), add("nd")
        ratio = F.log((td + 0.5) / (total["td"] + 1)) - F.log((nd + 0.5) / (total["nd"] + 1))
        rate = F.log((add("tw") + 0.5) / (total["tw"] + 1)) - F.log((add("nw") + 0.5) / (total["nw"] + 1))
        # G statistic of the two-by-two table of texts: how sure it is that the share of toxic texts is higher.
        share = total["td"] / max(1, total["td"] + total["nd"])
        g = 2 * (td * F.log(F.greatest(td, F.lit(1e-9)) / ((td + nd) * share)) + nd * F.log(F.greatest(nd, F.lit(1e-9)) / ((td + nd) * (1 - share))))
        rows = table.where("part <> ''").where(td >= 3).select("part", (F.greatest(ratio, rate) * F.least(F.lit(1.0), g / SURE)).alias("weight"), g.alias("g"), ratio.alias("ratio")).where((F.col("g") >= LEAST_G) & (F.col("ratio") >= 0.7))
        out.append({r["part"]: r["weight"] for r in rows.orderBy(F.desc("g"), "part").limit(entries).collect()})
    return out


def _with_features(df: DataFrame, lexicons: list[dict[str, float]], keep: list[str], which: str | None = None) -> DataFrame:
    """keep columns and the features; which: the column that tells the lexicon (else the first)."""
    shared = df.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = [Lexicon(w) for w in shared.value]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                number = part.column(1).to_pylist()
                rows = [features(text, lexicon[k]) for text, k in zip(part.column(0).to_pylist(), number, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(c, pa.float64()) for c in zip(*rows, strict=True))], names=[*keep, *FEATURES])

    narrow = df.select("text", (F.col(which) + 1 if which else F.lit(0)).cast("int").alias("_which"), *keep)
    return narrow.mapInArrow(work, T.StructType([*(narrow.schema[c] for c in keep), *(T.StructField(c, T.DoubleType()) for c in FEATURES)]))


class Model(NamedTuple):
    """What was learned: a rate where there are too few labels, else lexicon, trees and isotonic map."""

    rate: float
    lexicon: dict[str, float] | None = None
    trees: object = None
    isotonic: object = None

    def chance(self, df: DataFrame) -> DataFrame:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df)
        return self.trees.transform(ready).withColumn("_p", vector_to_array("probability")[1])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    with scratch(docs.sparkSession):
        sample = _sample(docs, labels, train_rows)
        sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        model = Model(sizes.get(1, 0) / max(1, sum(sizes.values())))
        if len(sizes) < 2 or min(sizes.values()) < 5:
            return model
        lexicons = learn_lexicon(sample)
        train = cut(_with_features(sample, lexicons, ["doc_id", "toxic", "calibrate"], "fold").orderBy("doc_id"), "toxicity-features")
        train = train.withColumn("toxic", F.col("toxic").cast("double"))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(train.where("not calibrate"))
        model = model._replace(lexicon=lexicons[0], trees=GBTClassifier(labelCol="toxic", featuresCol="_features", maxIter=20, maxDepth=3, stepSize=0.2, seed=7).fit(rows))
        steps = model.chance(train.where("calibrate")).select("toxic", "_p")
        return model._replace(isotonic=IsotonicRegression(labelCol="toxic", featuresCol="_p", predictionCol="_rate").fit(steps))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], cutoff: float, train_rows: int) -> DataFrame:
    """in (a struct of the columns keep), held_out, score, predicted."""
    model = learn(docs, labels, train_rows)
    named = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("in"), held_out().alias("held_out"))
    if model.trees is None:
        scored = named.withColumn("raw", F.lit(float(model.rate)))
    else:
        ready = model.chance(_with_features(named, [model.lexicon], ["in", "held_out"]))
        # A little of the raw probability keeps the order within a step of the isotonic map.
        scored = model.isotonic.transform(ready).withColumn("raw", 0.98 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_rate"))) + 0.02 * F.col("_p"))
    score_col = F.round("raw", 6)
    return scored.select("in", "held_out", score_col.alias("score"), (score_col >= cutoff).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return judged(docs, labels, ["doc_id"], cutoff, train_rows).select("in.doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with their columns, whatever their names."""
    return judged(docs, labels, docs.columns, cutoff, train_rows).where("predicted = 0").select("in.*")
