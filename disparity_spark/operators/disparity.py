"""Disparity of decisions between groups.

Everything rests on one aggregate: counts of tp, fp, fn and tn per group, made in one scan with partial sums before
the shuffle, so its result has as many rows as there are groups at any size of input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import group_label, is_binary, ratio

#: The checks with their operators and limits.
DEFAULT_THRESHOLDS = {
    "disparate_impact_ratio": {"min": 0.8},
    "demographic_parity_diff": {"max": 0.2},
    "tpr_gap": {"max": 0.15},
    "fpr_gap": {"max": 0.15},
}
METRICS = ("demographic_parity_diff", "disparate_impact_ratio", "tpr_gap", "fpr_gap")
COUNTS = ("tp", "fp", "fn", "tn")
MAX_BOOTSTRAP = 1000


@dataclass(frozen=True)
class AuditSpec:
    """Which columns play which role. Without pred the outcome itself is audited."""

    truth: str
    groups: tuple[str, ...]
    pred: str | None = None

    def __post_init__(self):
        if not self.groups:
            raise ValueError("at least one group column is needed")

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.truth, *([self.pred] if self.pred else []), *self.groups]))


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}; the table has {', '.join(df.columns)}")


def decisions(df: DataFrame, spec: AuditSpec, *by: str) -> DataFrame:
    """truth, pred, group and the columns `by`; only these and the role columns are read."""
    require_columns(df, [*spec.columns, *by])
    return df.select(F.col(spec.truth).alias("truth"), F.col(spec.pred or spec.truth).alias("pred"), group_label(*spec.groups).alias("group"), *by)


def _counts() -> list[Column]:
    t, p = F.col("truth").cast("double"), F.col("pred").cast("double")
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return [F.count("*").alias("n"), *[F.count_if((t == a) & (p == b)).alias(k) for k, (a, b) in cells.items()], F.count_if(~(is_binary(F.col("truth")) & is_binary(F.col("pred")))).alias("n_invalid")]


def confusion(df: DataFrame, spec: AuditSpec, *by: str) -> DataFrame:
    """group, n, tp, fp, fn, tn, n_invalid (rows whose truth or pred isn't 0 or 1), for each value of `by`."""
    return decisions(df, spec, *by).groupBy(*by, "group").agg(*_counts())


def cube_confusion(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """Confusion counts of every combination of the group columns in one scan: slice (its columns), group and counts."""
    require_columns(df, spec.columns)
    rows = df.select(F.col(spec.truth).alias("truth"), F.col(spec.pred or spec.truth).alias("pred"), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in spec.groups])
    cubed = rows.cube(*spec.groups).agg(F.grouping_id().alias("gid"), *_counts())
    width = len(spec.groups)
    used = [F.when(F.col("gid").bitwiseAND(1 << (width - 1 - i)) == 0, F.lit(c)) for i, c in enumerate(spec.groups)]
    label = [F.when(u.isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for u, c in zip(used, spec.groups, strict=True)]
    return cubed.select(F.concat_ws(",", *used).alias("slice"), F.concat_ws(" | ", *label).alias("group"), "n", *COUNTS, "n_invalid")


def group_rates(counts: DataFrame, outcome_only: bool = False) -> DataFrame:
    """Counts with selection_rate, tpr, fpr, precision, accuracy. Undefined rates are null; so are all but the first for an outcome audit."""
    tp, fp, fn, tn, n = (F.col(c) for c in (*COUNTS, "n"))
    void = F.lit(None).cast("double")
    rest = {"tpr": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "precision": ratio(tp, tp + fp), "accuracy": ratio(tp + tn, n)}
    return counts.withColumns({"selection_rate": ratio(tp + fp, n), **{k: void if outcome_only else v for k, v in rest.items()}})


def metric_columns() -> dict[str, Column]:
    """The four disparity metrics, as aggregates over group rates."""
    high, low = F.max("selection_rate"), F.min("selection_rate")
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    return {
        "demographic_parity_diff": high - low,
        "disparate_impact_ratio": F.when(high == 0, 1.0).otherwise(ratio(low, high)),
        "tpr_gap": gap("tpr"),
        "fpr_gap": gap("fpr"),
    }


def summary(rates: DataFrame, *by: str) -> DataFrame:
    """n_total and the four metrics: one row, or one for each value of `by`."""
    metrics = [v.alias(k) for k, v in metric_columns().items()]
    return rates.groupBy(*by).agg(F.sum("n").alias("n_total"), *metrics)


def long_summary(row: DataFrame) -> DataFrame:
    """check, value."""
    return row.unpivot(["n_total"], list(METRICS), "check", "value").select("check", "value")


def undersized(counts: DataFrame, min_group_n: int) -> DataFrame:
    """group, n of groups with fewer rows than asked for."""
    return counts.filter(F.col("n") < min_group_n).select("group", "n")


def review_reasons(counts: DataFrame, min_group_n: int | None, outcome_only: bool = False) -> DataFrame:
    """code, detail: why the evidence needs a reviewer."""
    small = F.sort_array(F.collect_list(F.when(F.col("n") < (min_group_n or 0), F.concat_ws(":", "group", F.col("n").cast("string")))))
    one = counts.agg(small.alias("small"), F.coalesce(F.sum(F.col("tp") + F.col("fp")), F.lit(0)).alias("positive"))
    reasons = F.array(
        F.when(F.size("small") > 0, F.struct(F.lit("minimum_group_size").alias("code"), F.concat_ws(",", "small").alias("detail"))),
        F.when(F.col("positive") == 0, F.struct(F.lit("no_positive_predictions").alias("code"), F.lit("").alias("detail"))),
        F.when(F.lit(outcome_only), F.struct(F.lit("prediction_column_not_provided").alias("code"), F.lit("").alias("detail"))),
    )
    return one.select(F.explode(F.array_compact(reasons)).alias("r")).select("r.*")


@dataclass
class GroupMetrics:
    group: str
    n: int
    selection_rate: float | None
    tpr: float | None = None
    fpr: float | None = None
    precision: float | None = None
    accuracy: float | None = None


@dataclass
class AuditResult:
    """One audit as a document. Fields that older documents lack load as empty."""

    groups: list[GroupMetrics]
    n_total: int
    demographic_parity_diff: float | None
    disparate_impact_ratio: float | None
    tpr_gap: float | None
    fpr_gap: float | None
    flags: list[dict] = field(default_factory=list)
    context: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    review_reasons: list[dict] = field(default_factory=list)
    confidence_intervals: dict = field(default_factory=dict)
    min_group_n: int | None = None
    bootstrap_samples: int = 0
    thresholds: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        from dataclasses import asdict

        return asdict(self)

    @classmethod
    def from_dict(cls, document: dict) -> AuditResult:
        known = {k: document[k] for k in cls.__dataclass_fields__ if k in document}
        known["groups"] = [GroupMetrics(**{k: g[k] for k in GroupMetrics.__dataclass_fields__ if k in g}) for g in document["groups"]]
        for k in (*METRICS, "n_total"):
            if k not in known:
                raise ValueError(f"the document has no {k}")
        return cls(**known)


def merged_thresholds(overrides: dict | None = None) -> dict:
    """Default limits with overrides: known checks, the same operator, finite numbers."""
    import math

    out = {k: dict(v) for k, v in DEFAULT_THRESHOLDS.items()}
    for check, rule in (overrides or {}).items():
        if check not in out:
            raise ValueError(f"unknown check {check!r}; known: {', '.join(out)}")
        if not isinstance(rule, dict) or set(rule) != set(out[check]):
            raise ValueError(f"{check} takes the operator {', '.join(out[check])}")
        (op, limit), = rule.items()
        if isinstance(limit, bool) or not isinstance(limit, (int, float)) or not math.isfinite(limit):
            raise ValueError(f"the limit of {check} must be a finite number")
        out[check] = {op: float(limit)}
    return out


def passes(value: float | None, rule: dict) -> bool | None:
    if value is None:
        return None
    (op, limit), = rule.items()
    return value >= limit if op == "min" else value <= limit


def build_flags(values: dict, thresholds: dict) -> list[dict]:
    """One flag per check; an undefined value passes."""
    return [{"check": c, "value": values.get(c), "threshold": rule, "passed": passes(values.get(c), rule) is not False} for c, rule in thresholds.items()]


def audit_disparities(df: DataFrame, spec: AuditSpec, thresholds: dict | None = None, min_group_n: int | None = None, bootstrap: int = 0, bootstrap_seed: int = 42, context: dict | None = None) -> AuditResult:
    """A whole audit: one job for the counts, which have a row per group, and a small one for the intervals."""
    from .bootstrap import bootstrap_intervals

    if min_group_n is not None and (isinstance(min_group_n, bool) or min_group_n < 1):
        raise ValueError("min_group_n must be a positive integer")
    if isinstance(bootstrap, bool) or not 0 <= bootstrap <= MAX_BOOTSTRAP:
        raise ValueError(f"bootstrap must lie in 0..{MAX_BOOTSTRAP}")
    outcome_only, limits = spec.pred is None, merged_thresholds(thresholds)
    spark = df.sparkSession
    counted = confusion(df, spec)
    rows = counted.orderBy("group").collect()
    if not rows:
        raise ValueError("the table has no rows")
    if bad := sum(r.n_invalid for r in rows):
        raise ValueError(f"{bad} rows have a truth or prediction other than 0 and 1")
    local = spark.createDataFrame(rows, counted.schema)
    rates = group_rates(local, outcome_only)
    one = summary(rates).first().asDict()
    reasons = [r.asDict() for r in review_reasons(local, min_group_n, outcome_only).collect()]
    groups = [GroupMetrics(r.group, r.n, r.selection_rate, r.tpr, r.fpr, r.precision, r.accuracy) for r in rates.orderBy("group").collect()]
    intervals = {}
    if bootstrap:
        found = bootstrap_intervals(local, bootstrap, bootstrap_seed, outcome_only).collect()
        intervals = {r.metric: {"lower": r.lower, "upper": r.upper} for r in found}
    warnings = [f"{r['code']}: {r['detail']}" if r["detail"] else r["code"] for r in reasons]
    return AuditResult(groups, one["n_total"], *[one[m] for m in METRICS], build_flags(one, limits), context or {}, warnings, reasons, intervals, min_group_n, bootstrap, limits)
