"""Personal data: base spans by pattern, and terms that reveal them by information content.

Protected entities are the values of the base spans (e-mail and IP addresses, card and phone numbers, however
written). A term is a run of at least SHORTEST letters and digits outside base spans, in lower case. With N
rows, n(c) rows that hold entity c, n(t) that hold term t and n(c, t) in which t stands within NEAR terms of
c, the pointwise mutual information log2(N n(c, t) / (n(c) n(t))) is what t tells of c, and log2(N / n(c))
what there is to tell. A term whose share of that reaches DISCLOSURE for some entity, in at least CONTEXTS
different surroundings (the same passage copied is one), reveals it, and is a span of kind term wherever it
stands. It is generalised to its beginning (``abcd*``) where that form, counted in the same way, stays below
DISCLOSURE for all these entities, and removed otherwise.

Everything is counted over all rows, in three passes over the texts: base spans and surroundings, rows of
candidate terms, places of revealing terms. A filter of FILTER_BITS bits, which is all that is broadcast, keeps
most other words from leaving a task; what passes by chance falls out in a join.

Patterns find the leftmost matches that do not overlap, in time linear in the text. Defined cases: a null text
is empty; a null id is a value like others; repeated rows count each; an entity in every row tells nothing and
is not revealed by any term; an empty table gives no rows; further columns are ignored by ``inspect`` and kept
by ``sanitise``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.common import cut, scratch

KINDS = ("email", "ip", "card", "phone", "term")
SHORTEST = 3
NEAR = 8
CONTEXTS = 3
DISCLOSURE = 0.8
FORM = 4  # code points that a generalised term keeps; shorter terms have no form
FILTER_BITS = 1 << 26
MEMORY = 1 << 18  # words of which a task remembers whether the filter has them
SALT = 16

_TERM = re.compile(rf"[^\W_]{{{SHORTEST},}}")
# The contract's patterns; runs start where they can and are never given back, which changes no match.
_EMAIL_AT = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_EMAIL_AT.pattern}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")  # what every address has; a plain character at its start is found fast
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[re.Match]:
    at = 0
    while found := (_EMAIL_AT.match(text, at) if at else None) or _EMAIL.search(text, at):
        yield found
        at = found.end()


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of personal data in the text, sorted; places are code points."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end(), m.group().lower()) for m in _emails(text)]
    for m in _IP.finditer(text) if _DOTTED.search(text) else ():
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end(), m.group()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NO_DIGIT.sub("", m.group())
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def masked(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with blanks in place of base spans."""
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end, _ in spans:
        if end > at:
            parts += [text[at:start], " " * (end - max(start, at))]
            at = end
    return "".join([*parts, text[at:]])


def form_of(term: str) -> str | None:
    """What a term is generalised to; a star is no part of any term."""
    return f"{term[:FORM]}*" if len(term) > FORM else None


def _with_forms(terms: Iterable[str]) -> set[str]:
    out = set(terms)
    return out | {f"{t[:FORM]}*" for t in out if len(t) > FORM}


def _terms(text: str, spans: list) -> set[str]:
    text = masked(text, spans)
    if "\u0130" in text or "\u03a3" in text:  # of these the lower case has two characters, or depends on what is around
        return {t.lower() for t in _TERM.findall(text)}
    return set(_TERM.findall(text.lower()))


def surroundings(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[bytes, int, list[str]]]:
    """For each base span: its entity, a hash of the terms around it, and those terms with their forms."""
    if not spans:
        return []
    places = [(m.start(), m.group().lower()) for m in _TERM.finditer(masked(text, spans))]
    starts, out = [p for p, _ in places], []
    for start, kind, _, value in spans:
        at = bisect_left(starts, start)
        around = [t for _, t in places[max(0, at - NEAR) : at + NEAR]]
        entity = hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=16).digest()
        out.append((entity, xxhash.xxh64_intdigest(" ".join(around), 0) >> 1, sorted(_with_forms(around))))
    return out


# --- passes over the texts


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_FOUND = "key string, doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, near array<struct<entity: binary, context: long, fresh: int, term: string>>, entities array<binary>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near_kind = pa.list_(pa.struct([("entity", pa.binary()), ("context", pa.int64()), ("fresh", pa.int32()), ("term", pa.string())]))
    base_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for part in _slices(batches):
        counts, digests, bases, nears, entities = ([], [], [], []), [], [], [], []
        for text in part.column(2).to_pylist():
            spans = base_spans(text)
            for kind, of in enumerate(counts):
                of.append(sum(s[1] == kind for s in spans))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans).encode()).hexdigest())
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b, _ in spans])
            seen, near, around = set(), [], surroundings(text, spans)
            for entity, context, terms in around:
                for term in terms:
                    near.append({"entity": entity, "context": context, "fresh": int((entity, term) not in seen), "term": term})
                    seen.add((entity, term))
            nears.append(near)
            entities.append(sorted({e for e, _, _ in around}))
        columns = [part.column(0), part.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(bases, base_kind), pa.array(nears, near_kind), pa.array(entities, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "entities"])


def _bits(word: str) -> tuple[int, int]:
    whole = xxhash.xxh64_intdigest(word, 7)
    return whole % FILTER_BITS, (whole >> 32) % FILTER_BITS


def _filter(words: DataFrame):
    """A broadcast filter of fixed size that has all the words (a column term): the words of it that are not zero."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b for w in batch.column(0).to_pylist() for b in _bits(w)], pa.int64())], names=["bit"])

    set_bits = words.select("term").mapInArrow(places, "bit long").groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("word"))
    return words.sparkSession.sparkContext.broadcast([c.to_numpy() for c in set_bits.toArrow().combine_chunks().columns])


def _holds(shared) -> Callable[[str], bool]:
    """Whether the filter has a word; remembers the last words."""
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[shared.value[0]] = shared.value[1]
    memory: dict[str, bool] = {}

    def holds(word: str) -> bool:
        known = memory.get(word)
        if known is None:
            if len(memory) >= MEMORY:
                memory.clear()
            known = memory[word] = all(words[b >> 6] >> np.int64(b & 63) & 1 for b in _bits(word))
        return known

    return holds


def _row_counts(texts: DataFrame, shared) -> DataFrame:
    """term, n: rows that hold each term or form which the filter has; counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds, found = _holds(shared), Counter()

        def release() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["term", "n"])
            found.clear()
            return out

        for part in _slices(batches):
            for text in part.column(0).to_pylist():
                found.update(filter(holds, _with_forms(_terms(text, base_spans(text)))))
            if len(found) >= MEMORY:
                yield release()
        if found:
            yield release()

    return texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def _places(texts: DataFrame, shared) -> DataFrame:
    """key, term, start, end of each place of a term that the filter has."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = _holds(shared)
        for part in _slices(batches):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                spans = base_spans(text)
                known = {t for t in _terms(text, spans) if holds(t)}
                if known:
                    rows += [(key, term, m.start(), m.end()) for m in _TERM.finditer(masked(text, spans)) if (term := m.group().lower()) in known]
            for low in range(0, len(rows), 4096):
                columns = zip(zip(*rows[low : low + 4096], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["key", "term", "start", "end"])

    return texts.select("key", "text").mapInArrow(find, "key string, term string, start long, end long")


# --- what terms disclose


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _found(texts: DataFrame) -> DataFrame:
    return cut(texts.mapInArrow(_find, _FOUND.format(id=texts.schema["doc_id"].dataType.simpleString())), "pii-found")


def disclosures(texts: DataFrame, found: DataFrame) -> DataFrame:
    """term, form (null: none is left or it still reveals), disclosure (largest), for each term that reveals an entity."""
    near = found.select(F.explode("near").alias("x")).select("x.*")
    pairs = near.groupBy("entity", "term", "context").agg(F.sum("fresh").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("contexts"))
    is_form = F.col("term").endswith("*")
    pairs = cut(pairs.where(is_form | (F.col("contexts") >= CONTEXTS)), "pii-pairs")
    plain = pairs.where(~is_form).select("term").distinct()
    form = F.when(F.length("term") > FORM, F.concat(F.substring("term", 1, FORM), F.lit("*")))
    words = plain.unionByName(plain.select(form.alias("term")).where("term IS NOT NULL")).distinct()
    rows = _row_counts(texts, _filter(words))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = F.broadcast(found.agg(F.count("*").alias("n_all")))  # one row
    log2 = lambda a, b: F.log2(F.col(a).cast("double") / F.col(b))
    told = (log2("n_all", "n_entity") - log2("n_term", "n_pair")) / log2("n_all", "n_entity")
    scored = pairs.join(rows, "term").join(entities, "entity").crossJoin(total).where("n_entity < n_all").select("entity", "term", told.alias("told"))
    scored = cut(scored, "pii-scored")
    revealing = scored.where(~F.col("term").endswith("*") & (F.col("told") >= DISCLOSURE)).withColumn("form", form)
    general = scored.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("form"), F.col("told").alias("form_told"))
    both = revealing.join(general, ["entity", "form"], "left").groupBy("term").agg(F.max("told").alias("disclosure"), F.first("form").alias("form"), F.max("form_told").alias("form_told"))
    return both.select("term", F.when(F.col("form_told") < DISCLOSURE, F.col("form")).alias("form"), "disclosure")


def _spans(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as found, and by key the places of revealing terms (start, kind, end, form)."""
    found = _found(texts)
    revealing = cut(disclosures(texts, found), "pii-revealing")
    places = _places(texts, _filter(revealing)).withColumn("salt", F.expr(f"pmod(hash(key), {SALT})"))
    kept = revealing.select("term", "form").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    span = F.struct("start", F.lit(4).alias("kind"), "end", "form")
    return found, places.join(kept, ["term", "salt"]).groupBy("key").agg(F.collect_set(span).alias("revealed"))


def inspect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: kind:start:end of base spans and revealing terms, by start and kind."""
    with scratch(docs.sparkSession) as keep:
        found, revealed = _spans(_texts(docs, id_col, text_col))
        base = F.transform("base", lambda x: F.struct(x["start"], x["kind"], x["end"]))
        more = F.transform(F.coalesce("revealed", F.array()), lambda x: F.struct(x["start"], x["kind"], x["end"]))
        name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
        spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), name), ",")
        return keep(found.join(revealed, "key", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans")), "pii")


def _rewrite(text: str, spans: list[tuple[int, int, int, str | None]]) -> str:
    parts, at = [], 0
    for start, kind, end, form in sorted(spans, key=lambda s: s[:3]):
        if start >= at:  # of overlapping spans the first names the replacement; what sticks out goes too
            parts += [text[at:start], form or ("[removed]" if kind == 4 else f"[{KINDS[kind]}]")]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with base spans replaced by their kind, and revealing terms by their form or ``[removed]``; a null text stays null."""
    texts = _texts(docs, id_col, text_col)
    with scratch(docs.sparkSession) as keep:
        found, revealed = _spans(texts)
        none = F.lit(None).cast("string")
        base = found.select("key", F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), none.alias("form"))).alias("base")).where("size(base) > 0").dropDuplicates(["key"])
        spans = keep(base.join(revealed, "key", "full").select("key", F.concat(F.coalesce("base", F.array()), F.coalesce("revealed", F.array())).alias("spans")), "pii-spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("in"), _key(id_col, text_col).alias("key")).join(spans, "key", "left")

    @F.pandas_udf("string")
    def rewrite(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else _rewrite(t, [(int(x["start"]), int(x["kind"]), int(x["end"]), x["form"]) for x in s]) for t, s in zip(text, spans, strict=True)])

    new = F.when(F.col("spans").isNull(), F.col(f"in.`{text_col}`")).otherwise(rewrite(F.col(f"in.`{text_col}`"), F.col("spans")))
    return rows.select(*[(new if c == text_col else F.col(f"in.`{c}`")).alias(c) for c in docs.columns])

