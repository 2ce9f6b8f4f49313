"""Policy: predicates over metric samples, findings and their deltas, gates, hot spots, plans.

A predicate is a value built from Compare, Holds, Threshold, Every, Some, Negate and Always, or read from a
text (``predicate_text``). On a row an absent
operand makes a comparison false, also below a negation. On a scope (a group of samples) a comparison
holds if a sample meets it; Some holds if a child does; Negate turns the group's result; Every holds if one
sample meets all children, or, where all children are thresholds, if each is met by some sample.
Evaluation is one aggregate over the samples for all rules; witnesses come as rows, so that a scope with
very many samples makes no large array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.common import cut, latest
from cairn.operators.stats import robust_z

FIELDS = {"metric_kind": str, "scope_kind": str, "pack": str, "source": str, "value": float, "degraded": bool}
#: The operators of comparisons.
COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
#: What the string fields may hold.
CANONICAL = {
    "metric_kind": (
        "cyclo",
        "cognitive_complexity",
        "loc",
        "cycle_member",
        "duplication_ratio",
        "modification_count_in_window",
        "lcom4",
        "fan_in",
        "fan_out",
        "depth_of_inheritance",
        "interface_width",
        "coupling_between_objects",
        "lsp_violation",
        "xrepo_dep_depth",
        "arch_debt_ratio",
        "velocity_trend",
        "arch_fitness",
        "blast_radius",
        "xservice_test_reliability",
        "knowledge_index",
        "coverage_line_ratio",
        "coverage_branch_ratio",
        "pass_first_try_ratio",
    ),
    "scope_kind": ("repo", "package", "file", "class", "interface", "method", "block"),
    "pack": ("base", "solid", "system", "ingested"),
    "source": ("computed", "derived", "ingested"),
}
QUALIFYING = ("new", "newly_failing")


@dataclass(frozen=True)
class Field:
    """The other field of a comparison of two."""

    name: str


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | float | bool | Field

    def __post_init__(self):
        kind = FIELDS.get(self.field)
        if kind is None or self.op not in COMPARE:
            raise ValueError(f"unknown field or operator: {self.field} {self.op}")
        if isinstance(self.value, Field):
            if FIELDS.get(self.value.name) is not kind:
                raise TypeError(f"{self.field} needs another field of {kind.__name__}, not {self.value.name}")
        elif not isinstance(self.value, (int, float) if kind is float else kind) or (kind is float and isinstance(self.value, bool)):
            raise TypeError(f"{self.field} needs {kind.__name__}, not {self.value!r}")
        elif kind is str and self.value not in CANONICAL[self.field]:
            raise ValueError(f"unknown {self.field}: {self.value!r}")
        if kind is not float and self.op not in ("==", "!="):
            raise TypeError(f"{self.field} has no order")


@dataclass(frozen=True)
class Threshold:
    metric_kind: str
    scope_kind: str
    op: str
    value: float

    def __post_init__(self):
        if self.op not in COMPARE or self.op == "!=":
            raise ValueError(f"unknown threshold operator: {self.op}")


@dataclass(frozen=True)
class Every:
    children: tuple


@dataclass(frozen=True)
class Some:
    children: tuple


@dataclass(frozen=True)
class Negate:
    child: object


@dataclass(frozen=True)
class Always:
    value: bool


@dataclass(frozen=True)
class Holds:
    """A comparison of two constants: on a scope it has every sample as a witness, or none."""

    value: bool


@dataclass(frozen=True)
class Rule:
    rule_id: str
    predicate: object
    severity: str = "warn"


def _there(name: str) -> Column:
    field = F.col(name)
    return field.isNotNull() & (field != "") if FIELDS[name] is str else field.isNotNull()


def on_row(p) -> Column:
    """The predicate on one sample; never null."""
    if isinstance(p, Compare):
        there = _there(p.field)
        if isinstance(p.value, Field):
            there, other = there & _there(p.value.name), F.col(p.value.name)
        else:
            other = F.lit(p.value)
        return F.coalesce(there & COMPARE[p.op](F.col(p.field), other), F.lit(False))
    if isinstance(p, Threshold):
        same = (F.col("metric_kind") == p.metric_kind) & (F.col("scope_kind") == p.scope_kind)
        return F.coalesce(same & COMPARE[p.op](F.col("value"), F.lit(float(p.value))), F.lit(False))
    if isinstance(p, (Always, Holds)):
        return F.lit(p.value)
    if isinstance(p, Negate):
        return ~on_row(p.child)
    out = None
    for child in p.children:
        c = on_row(child)
        out = c if out is None else (out & c if isinstance(p, Every) else out | c)
    return out if out is not None else F.lit(isinstance(p, Every))


class _Plan:
    """Aggregates that a set of predicates needs, each once."""

    def __init__(self):
        self.aggregates: dict[object, tuple[str, Column]] = {}

    def need(self, key, make: Column) -> Column:
        name, _ = self.aggregates.setdefault(key, (f"_a{len(self.aggregates)}", make))
        return F.col(name)

    def matched(self, p) -> Column:
        if isinstance(p, Always):
            return F.lit(p.value)
        if isinstance(p, (Compare, Threshold, Holds)):
            return F.coalesce(self.need(("any", p), F.bool_or(on_row(p))), F.lit(False))
        if isinstance(p, Negate):
            return ~self.matched(p.child)
        if isinstance(p, Some):
            out = F.lit(False)
            for child in p.children:
                out = out | self.matched(child)
            return out
        out = self.first(p).isNotNull()
        if self.loose(p):
            together = F.lit(True)
            for child in p.children:
                together = together & self.matched(child)
            out = out | together
        return out

    def first(self, p) -> Column:
        """The smallest sample_id that meets all children."""
        return self.need(("first", p), F.min(F.when(on_row(p), F.col("sample_id"))))

    @staticmethod
    def loose(p) -> bool:
        return bool(p.children) and all(isinstance(c, Threshold) for c in p.children)

    def witness(self, p) -> Column:
        """Whether a sample is a witness, beside its scope's aggregates; only asked where the predicate holds."""
        if isinstance(p, (Compare, Threshold, Holds)):
            return on_row(p)
        if isinstance(p, (Always, Negate)):
            return F.lit(False)
        if isinstance(p, Some):
            out = F.lit(False)
            for child in p.children:
                out = out | (self.matched(child) & self.witness(child))
            return out
        first = self.first(p)
        rest = F.lit(False)
        if self.loose(p):
            for child in p.children:
                rest = rest | on_row(child)
        return F.when(first.isNotNull(), F.col("sample_id") == first).otherwise(rest)


def evaluate(samples: DataFrame, rules: Sequence[Rule], scope: Sequence[str] = ("repo_id", "sha", "scope_id")) -> tuple[DataFrame, DataFrame]:
    """(firings, witnesses): scope, rule_id, severity of each rule that holds, and scope, rule_id, sample_id of its witnesses."""
    plan = _Plan()
    holds = {r.rule_id: plan.matched(r.predicate) for r in rules}
    seen = {r.rule_id: plan.witness(r.predicate) for r in rules}
    aggregates = [make.alias(name) for name, make in plan.aggregates.values()] or [F.count("*").alias("_n")]
    groups = samples.groupBy(*scope).agg(*aggregates)
    fired = F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), holds[r.rule_id].alias("_holds")) for r in rules])).alias("_r")
    firings = groups.select(*scope, fired).where("_r._holds").select(*scope, "_r.rule_id", "_r.severity")
    rows = samples.join(groups, list(scope))
    each = F.explode(F.filter(F.array(*[F.when(holds[r.rule_id] & seen[r.rule_id], F.lit(r.rule_id)) for r in rules]), lambda x: x.isNotNull())).alias("rule_id")
    return firings, rows.select(*scope, each, "sample_id").distinct()


def deciding_override(scopes: DataFrame, overrides: DataFrame) -> DataFrame:
    """scopes (rule_id, repo_id, scope_id) with the newest override whose glob fits: an equi-join, the glob as a residual."""
    patterns = overrides.select("rule_id", "repo_id", "override_id", "mute", "created_rank", S.glob_regex("scope_glob").alias("_re"))
    found = scopes.join(patterns, ["rule_id", "repo_id"]).where(F.rlike("scope_id", F.col("_re"))).drop("_re")
    return latest(found, ["rule_id", "repo_id", "scope_id"], ["created_rank", "override_id"])


def unmuted(firings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Firings that the deciding override does not mute."""
    key = ["rule_id", "repo_id", "scope_id"]
    muted = deciding_override(firings.select(*key).distinct(), overrides).where("mute").select(*key)
    return firings.join(muted, key, "left_anti")


def deltas(current: DataFrame, prior: DataFrame) -> DataFrame:
    """current (scope_id, rule_id, severity) with delta against prior, the latest finding of each (scope, rule) at the parent."""
    before = prior.select("scope_id", "rule_id", F.col("severity").alias("_sev"), F.col("delta").alias("_delta"))
    rows = current.join(before, ["scope_id", "rule_id"], "left")
    blocked = F.coalesce((F.col("_sev") == "block") & (F.col("_delta") != "resolved"), F.lit(False))
    blocks = F.col("severity") == "block"
    delta = F.when(F.col("_sev").isNull(), "new").when(blocked & blocks, "unchanged").when(blocks, "newly_failing").otherwise("new")
    return rows.withColumn("delta", delta).drop("_sev", "_delta")


def resolved(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior unresolved blocks that do not fire as blocks now, as resolved info findings."""
    open_blocks = prior.where("severity = 'block' AND delta <> 'resolved'").select("scope_id", "rule_id")
    gone = open_blocks.join(current.where("severity = 'block'"), ["scope_id", "rule_id"], "left_anti")
    return gone.select("scope_id", "rule_id", F.lit("info").alias("severity"), F.lit("resolved").alias("delta"))


def verdict(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst severity of unresolved findings by key; keys whose findings are all resolved pass."""
    worst = F.max(F.when(F.col("delta") != "resolved", S.severity_rank("severity")))
    return findings.groupBy(*keys).agg(F.coalesce(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("block")), worst + 1), F.lit("pass")).alias("verdict"))


def canonical_run(runs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The newest sound run of each (repository, commit, policy, caller, scope; null scopes are one) within the time to live."""
    recent = runs.where(~F.col("degraded") & (F.col("created_at").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - ttl_seconds))
    return latest(recent, ["repo_id", "sha", "policy", "caller", "scope"], ["created_at", "run_id"])


def catch_up(commits: DataFrame, runs: DataFrame) -> DataFrame:
    """Scanned commits without a sound run."""
    done = runs.where(~F.col("degraded")).select("repo_id", "sha").distinct()
    return commits.where("scan_status = 'scanned'").join(done, ["repo_id", "sha"], "left_anti")


def gate(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """requests (repo_id, sha, signature_ok, scan_status) with verdict, degraded and reason."""
    rows = requests.join(verdicts, ["repo_id", "sha"], "left")
    bad, unready = ~F.col("signature_ok"), F.coalesce(F.col("scan_status") != "scanned", F.lit(True))
    reason = F.when(bad, "policy_signature_invalid").when(unready, "samples_pending")
    return rows.select("repo_id", "sha", F.when(bad | unready, "warn").otherwise(F.coalesce("verdict", F.lit("pass"))).alias("verdict"), reason.isNotNull().alias("degraded"), reason.alias("reason"))


def hot_spots(metrics: DataFrame, counts: DataFrame, keys: Sequence[str] = (), weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Scores of scopes from metrics (scope_id, cyclo, cognitive_complexity, modification_count, coupling, fan_out) and counts (scope_id, finding_count).

    A dimension is absent where all its parts are; absent dimensions are outside the distribution and add 0.
    Scopes that only have findings take part.
    """
    both = lambda a, b: F.when(F.col(a).isNull() & F.col(b).isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    dims = metrics.select(*keys, "scope_id", both("cyclo", "cognitive_complexity").alias("complexity"), F.col("modification_count").alias("churn"), both("coupling", "fan_out").alias("coupling"))
    rows = cut(dims.join(counts, [*keys, "scope_id"], "full_outer").fillna(0, ["finding_count"]), "hot-rows")
    scored = robust_z(rows, keys, ["complexity", "churn", "coupling"])
    a, b, c, d = weights
    return scored.withColumn("score", a * F.col("complexity_z") + b * F.col("churn_z") + c * F.col("coupling_z") + d * F.col("finding_count"))


def top_hot_spots(spots: DataFrame, n: int) -> DataFrame:
    """The n highest scores of the latest batch; 0 means all."""
    newest = spots.agg(F.max("created_at").alias("created_at"))
    rows = spots.join(F.broadcast(newest), "created_at").orderBy(F.desc("score"), "scope_id")
    return rows.limit(n) if n else rows


def plan_tasks(spots: DataFrame, findings: DataFrame) -> DataFrame:
    """A task for each distinct qualifying rule of each hot spot, with kind and hours."""
    rules = findings.where(F.col("delta").isin(*QUALIFYING)).select("scope_id", "rule_id").distinct()
    tasks = spots.select("scope_id", "score").join(rules, "scope_id").withColumn("kind", S.task_kind("rule_id")).where("kind IS NOT NULL")
    return tasks.withColumn("hours", S.effort("kind", "score"))
