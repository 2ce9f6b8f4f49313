"""Scalar functions of the analytic domain, as column expressions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Punctuation beside which a canonical signature has no space.
PUNCTUATION = ",()[]{}<>:;"
#: What a decision block adds: kind, cyclomatic, cognitive, bonus for nesting, nests what is below.
DECISIONS = (
    ("if", 1, 1, True, True),
    ("else_if", 1, 1, False, False),
    ("else", 0, 1, False, False),
    ("for", 1, 1, True, True),
    ("while", 1, 1, True, True),
    ("do_while", 1, 1, True, True),
    ("case", 1, 1, True, True),
    ("catch", 1, 1, True, True),
    ("ternary", 1, 1, True, False),
    ("logical_and", 1, 1, False, False),
    ("logical_or", 1, 1, False, False),
    ("break_label", 0, 1, False, False),
    ("continue_label", 0, 1, False, False),
    ("goto", 0, 1, False, False),
    ("recursion", 0, 1, False, False),
)
#: Beginnings of rule names and the kind of work they ask for; the first that fits counts.
TASK_KINDS = (
    ("solid.srp", "split_class"),
    ("solid.isp", "split_class"),
    ("solid.ocp", "extract_method"),
    ("solid.lsp", "extract_method"),
    ("solid.dip", "invert_dependency"),
    ("decoupling.cycle", "break_cycle"),
    ("decoupling.duplication", "consolidate_duplication"),
    ("decoupling.coupling", "invert_dependency"),
    ("decoupling.cbo", "invert_dependency"),
    ("decoupling.fan_in", "invert_dependency"),
    ("decoupling.fan_out", "invert_dependency"),
)
#: Hours that a kind of work takes at score 0, and the most that is ever estimated.
BASE_HOURS = {"split_class": 8.0, "extract_method": 2.0, "invert_dependency": 4.0, "break_cycle": 6.0, "consolidate_duplication": 3.0}
MOST_HOURS = 40.0
#: Which reason of degraded service is shown first.
REASON_RANK = {"episodic_log_unavailable": 100, "graph_store_unavailable": 90, "embedding_index_unavailable": 85, "reranker_model_stale": 50, "span_ingestor_backpressure": 30, "consolidator_backpressure": 20}
DSL_OPS = {"gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__", "eq": "__eq__", "ne": "__ne__"}


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _utf8(x: ColumnOrName) -> Column:
    return _c(x).cast("binary")



def node_fingerprint(repo_id: ColumnOrName, kind: ColumnOrName, signature: ColumnOrName, sha: ColumnOrName) -> Column:
    """SHA-256 over the 16 bytes of the repository, kind, NUL, signature, NUL, commit (hexadecimal)."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(F.unhex(F.replace(_c(repo_id), F.lit("-"), F.lit(""))), _utf8(kind), zero, _utf8(signature), zero, _utf8(sha)), 256)


def edge_fingerprint(repo_id: ColumnOrName, kind: ColumnOrName, src: ColumnOrName, dst: ColumnOrName, sha: ColumnOrName) -> Column:
    """SHA-256 over repository, kind, NUL, both node fingerprints (32 bytes each) and commit (hexadecimal)."""
    return F.sha2(F.concat(F.unhex(F.replace(_c(repo_id), F.lit("-"), F.lit(""))), _utf8(kind), F.unhex(F.lit("00")), F.unhex(_c(src)), F.unhex(_c(dst)), _utf8(sha)), 256)


def set_signature(members: Column) -> Column:
    """Digest of a set of ``role:fingerprint`` members, whatever their order; null for an empty set."""
    return F.when(F.size(members) > 0, F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\n").cast("binary"), 256))


def scope_id(namespace: uuid.UUID, repo_id: ColumnOrName, kind: ColumnOrName, signature: ColumnOrName, sha: ColumnOrName) -> Column:
    """Version 5 UUID of repository, kind, signature and first commit, joined by NUL."""
    zero = F.unhex(F.lit("00"))
    name = F.concat(_utf8(repo_id), zero, _utf8(kind), zero, _utf8(signature), zero, _utf8(sha))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def normalise_signature(text: ColumnOrName) -> Column:
    """A signature without comments, with single spaces, and none beside punctuation."""
    bare = F.regexp_replace(_c(text), r"/\*[\s\S]*?(?:\*/|\z)|(?://|#)[^\n]*(?:\n|\z)", " ")
    single = F.regexp_replace(bare, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(single, r" ?([,()\[\]{}<>:;]) ?", "$1"))


def signature(kind: str, repo: ColumnOrName, path: ColumnOrName | None = None, name: ColumnOrName | None = None, params: Column | None = None) -> Column:
    """Canonical signature of a scope. params: array of strings, for methods."""
    if kind == "repo":
        return _c(repo)
    label = {"package": "pkg", "file": "file", "class": "class", "interface": "class", "method": "method"}[kind]
    head = F.concat(_c(repo), F.lit(f"::{label}::"), _c(path))
    if kind in ("package", "file"):
        return head
    full = F.concat(head, F.lit("#"), normalise_signature(name))
    return full if kind != "method" else F.concat(full, F.lit("("), normalise_signature(F.array_join(params, ",")), F.lit(")"))


def block_signature(method: ColumnOrName, ordinal: ColumnOrName, kind: ColumnOrName) -> Column:
    return F.concat(_c(method), F.lit("#block_"), _c(ordinal).cast("string"), F.lit("_"), _c(kind))


def normalise_params(text: ColumnOrName) -> Column:
    """The parameter list at the end of a signature, normalised: what stands in its last balanced parentheses."""
    s = F.trim(_c(text))
    back = F.split(F.reverse(s), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("open"))

    def step(state: Column, ch: Column) -> Column:
        depth = state["depth"] + F.when(ch == ")", 1).when(ch == "(", -1).otherwise(0)
        closes = (state["open"] < 0) & (ch == "(") & (depth == 0)
        return F.struct(depth.alias("depth"), (state["at"] + 1).alias("at"), F.when(closes, state["at"]).otherwise(state["open"]).alias("open"))

    place = F.aggregate(back, start, step)["open"]
    balanced = F.substring(s, F.length(s) - place + 1, place - 1)
    tail = F.regexp_replace(F.substring_index(s, "(", -1), r"\)[^)]*$", "")
    return normalise_signature(F.when(s.endswith(")") & (place >= 0), balanced).when(F.contains(s, F.lit("(")), tail).otherwise(s))


def normalise_path(path: ColumnOrName) -> Column:
    """Forward slashes, no empty or ``.`` segments, ``..`` resolved, no trailing slash; null and ``.`` give an empty path."""
    s = F.replace(F.trim(F.coalesce(_c(path), F.lit(""))), F.lit("\\"), F.lit("/"))
    rooted = s.startswith("/")
    parts = F.filter(F.split(s, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        lost = (part == "..") & (F.size(done) == 0) & rooted
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(lost, done).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def dirname(path: ColumnOrName) -> Column:
    """The directory of a path, ``.`` if it has none."""
    cut = F.regexp_replace(_c(path), r"/?[^/]*$", "")
    return F.when(cut == "", F.when(_c(path).startswith("/"), F.lit("/")).otherwise(F.lit("."))).otherwise(cut)


def positive_int(text: ColumnOrName) -> Column:
    """A positive integer, else null."""
    n = F.trim(_c(text)).try_cast("int")
    return F.when(n > 0, n)


def like_escape(text: ColumnOrName) -> Column:
    """Text for use in LIKE ... ESCAPE '\\'."""
    return F.regexp_replace(_c(text), r"([\\%_])", r"\\$1")


def glob_regex(glob: ColumnOrName) -> Column:
    """Anchored regular expression of a glob: ``*`` any run, ``?`` any character, the rest literal."""
    quoted = F.regexp_replace(_c(glob), r"([\\.\[\]{}()^$+|*?])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit(r"\*"), F.lit(".*")), F.lit(r"\?"), F.lit(".")), F.lit("$"))


def tokens(text: ColumnOrName) -> Column:
    """Lexical tokens: runs of word characters, else single characters that are no space."""
    return F.regexp_extract_all(_c(text), F.lit(r"[A-Za-z0-9_]+|[^ \t\r\n]"), F.lit(0))


def fnv64a(values: pd.Series) -> np.ndarray:
    """FNV-1a of UTF-8 strings or bytes, unsigned 64 bits."""
    out = np.empty(len(values), np.uint64)
    for i, v in enumerate(values):
        h = 0xCBF29CE484222325
        for byte in v if isinstance(v, bytes) else str(v).encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


WINDOWS_AT_A_TIME = 1 << 13  # their state stays in the processor's cache


def fnv64a_windows_of_all(lists: list[list[str]], width: int) -> list[np.ndarray]:
    """FNV-1a of each run of ``width`` tokens of each list, a zero byte after each token.

    The bytes of a run lie side by side, so a step is the next byte of all runs that are not at their end: those are
    the first ones, as runs are sorted by length.
    """
    counts = np.array([max(len(tokens) - width + 1, 0) for tokens in lists], np.int64)
    out = np.full(int(counts.sum()), 0xCBF29CE484222325, np.uint64)
    coded = [t.encode() for tokens in lists for t in tokens]
    if not len(out):
        return [out[:0] for _ in lists]
    ends = np.cumsum([len(t) + 1 for t in coded])
    whole = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8).astype(np.uint64)
    first = np.cumsum([0, *[len(tokens) for tokens in lists]])[:-1]
    token = np.concatenate([np.arange(f, f + n) for f, n in zip(first, counts, strict=True)])
    begin = np.concatenate([[0], ends[:-1]])[token]
    sizes = ends[token + width - 1] - begin
    order = np.argsort(-sizes, kind="stable")
    for low in range(0, len(order), WINDOWS_AT_A_TIME):
        mine = order[low : low + WINDOWS_AT_A_TIME]
        at, left, state = begin[mine], sizes[mine], out[mine]
        live = len(mine) - np.searchsorted(left[::-1], np.arange(int(left[0])), side="right")  # runs longer than so many bytes
        for n in live.tolist():
            now = state[:n]
            now ^= whole[at[:n]]
            now *= np.uint64(0x100000001B3)
            at[:n] += 1
        out[mine] = state
    return np.split(out, np.cumsum(counts)[:-1])


def fnv64a_windows_of(tokens: list[str], width: int) -> np.ndarray:
    """FNV-1a of each run of ``width`` tokens, a zero byte after each token."""
    return fnv64a_windows_of_all([tokens], width)[0]


def fnv64a_windows(tokens: str | Column, width: int) -> Column:
    """The hashes of fnv64a_windows_of as an array of longs (two's complement)."""

    @F.pandas_udf("array<long>")
    def of(lists: pd.Series) -> pd.Series:
        out, group, held = [], [], 0
        for x in lists:
            group.append([] if x is None else list(x))
            held += len(group[-1])
            if held >= 1 << 17:  # lists go together until they have so many tokens
                out, group, held = [*out, *fnv64a_windows_of_all(group, width)], [], 0
        out += fnv64a_windows_of_all(group, width)
        return pd.Series([None if x is None else h.view(np.int64) for x, h in zip(lists, out, strict=True)], dtype=object)

    return of(tokens)


def hold_out(key: ColumnOrName, fraction: float) -> Column:
    """Whether a key falls into the fraction that is held out: its 64-bit FNV-1a, low 53 bits, against the fraction."""

    @F.pandas_udf("boolean")
    def held(keys: pd.Series) -> pd.Series:
        return pd.Series((fnv64a(keys) & np.uint64((1 << 53) - 1)).astype(np.float64) / float(1 << 53) < fraction)

    return held(_c(key).cast("string"))


def clamp(x: ColumnOrName, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _c(x)))


def sigmoid(z: ColumnOrName) -> Column:
    z = _c(z)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softplus(z: ColumnOrName) -> Column:
    z = _c(z)
    return F.when(z > 30, z).when(z < -30, F.lit(0.0)).otherwise(F.log1p(F.exp(z)))


def confidence(positive: ColumnOrName, negative: ColumnOrName) -> Column:
    """Share of positives, one half without any."""
    n = _c(positive) + _c(negative)
    return F.when(n > 0, _c(positive) / n).otherwise(F.lit(0.5))


def band(x: ColumnOrName) -> Column:
    return F.when(_c(x) < 0.3, "low").when(_c(x) < 0.7, "medium").otherwise("high")


def polarity(kind: ColumnOrName, outcome: ColumnOrName) -> Column:
    """Null for outcomes that say neither."""
    good = (_c(kind) == "synthetic_positive") | (_c(outcome) == "success")
    return F.when(good, "positive").when(_c(outcome).isin("failure", "refused", "degraded", "human_corrected"), "negative")


def month(ts: ColumnOrName) -> Column:
    """First day of the month in UTC: the partition of a fact."""
    return F.trunc(_c(ts).cast("date"), "MM")


def age_days(since: ColumnOrName, now: Column) -> Column:
    """Whole days."""
    return F.floor((now.cast("timestamp").cast("double") - _c(since).cast("timestamp").cast("double")) / 86400).cast("long")


def task_kind(rule_id: ColumnOrName) -> Column:
    """Null for rules that ask for no work."""
    rule, out = _c(rule_id), None
    for start, kind in TASK_KINDS:
        out = (F if out is None else out).when(rule.startswith(start), kind)
    return out


def base_hours(kind: ColumnOrName) -> Column:
    out = None
    for name, hours in BASE_HOURS.items():
        out = (F if out is None else out).when(_c(kind) == name, hours)
    return out.otherwise(1.0)


def finite_score(score: ColumnOrName) -> Column:
    s = F.coalesce(_c(score), F.lit(0.0))
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), 0.0).otherwise(clamp(s, 0.0, 10.0))


def effort(kind: ColumnOrName, score: ColumnOrName) -> Column:
    """Hours: the base of the kind, times one and the score, at most MOST_HOURS."""
    return F.least(F.lit(MOST_HOURS), base_hours(kind) * (1 + finite_score(score)))


def blended_effort(kind: ColumnOrName, score: ColumnOrName, scope_uuid: ColumnOrName, rule_id: ColumnOrName, version: str, artefact: int, most: float = MOST_HOURS) -> Column:
    """Hours between the base and ``most``, by a hash of the model and the task."""
    zero = F.unhex(F.lit("00"))
    shown = F.format_string("%.6f", finite_score(score))
    key = F.concat(_utf8(F.lit(version)), zero, _utf8(F.lit(f"{artefact:016x}")), zero, F.unhex(F.replace(_c(scope_uuid), F.lit("-"), F.lit(""))), zero, _utf8(rule_id), zero, _utf8(kind), zero, _utf8(shown))

    @F.pandas_udf("double")
    def share(keys: pd.Series) -> pd.Series:
        return pd.Series((fnv64a(keys.map(bytes)) % np.uint64(10001)).astype(np.float64) / 10000)

    base = base_hours(kind)
    return clamp(base + (most - base) * share(key), 0.0, most)


def hop_discount(score: ColumnOrName, hop: ColumnOrName) -> Column:
    return _c(score) * F.pow(F.lit(0.5), _c(hop))


def reason_rank(reason: ColumnOrName) -> Column:
    out = None
    for name, rank in REASON_RANK.items():
        out = (F if out is None else out).when(_c(reason) == name, rank)
    return out.otherwise(0)


def severity_rank(severity: ColumnOrName) -> Column:
    return F.when(_c(severity) == "block", 2).when(_c(severity) == "warn", 1).otherwise(0)
