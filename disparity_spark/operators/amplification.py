"""Bias amplification: does a synthetic table widen the disparity of its source?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .disparity import METRICS, AuditSpec, audit_disparities

#: Source ratio from which it counts as fair, limits of the synthetic ratio, of the factor and of growth.
FAIR_SOURCE = 0.90
INTRODUCED, DRIFTED = 0.80, 0.88
FACTOR_FAIL, FACTOR_REVIEW, FACTOR_NOTE = 1.25, 1.10, 0.9
GROWTH_FAIL, GROWTH_REVIEW = 0.10, 0.05
#: The limits of the bias axis under the names that a configuration uses.
LIMITS = {"max_amplification": FACTOR_FAIL, "review_amplification": FACTOR_REVIEW, "max_gap_growth": GROWTH_FAIL, "review_gap_growth": GROWTH_REVIEW, "introduced_disparity_di": INTRODUCED, "review_introduced_di": DRIFTED, "source_fair_di": FAIR_SOURCE}
GAPS = ("demographic_parity_diff", "tpr_gap", "fpr_gap")


def amplification_factor(source_ratio: Column, synthetic_ratio: Column) -> Column:
    """(1 - synthetic) / (1 - source); null where the source is fair."""
    return F.when(source_ratio < FAIR_SOURCE, F.try_divide(1 - synthetic_ratio, 1 - source_ratio))


def compared(source: DataFrame, synthetic: DataFrame) -> DataFrame:
    """metric, source, synthetic, delta of two long summaries (check, value)."""
    both = source.select(F.col("check").alias("metric"), F.col("value").alias("source")).join(synthetic.select(F.col("check").alias("metric"), F.col("value").alias("synthetic")), "metric", "full")
    return both.withColumn("delta", F.col("synthetic") - F.col("source"))


def compared_sides(sides: DataFrame) -> DataFrame:
    """The same for one table of summaries with a column `side` (source or synthetic), so that both come from one aggregation."""
    long = sides.unpivot(["side"], list(METRICS), "metric", "value")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("value"))).alias(side)
    return long.groupBy("metric").agg(pick("source"), pick("synthetic")).withColumn("delta", F.col("synthetic") - F.col("source"))


def verdict_row(pairs: DataFrame) -> DataFrame:
    """One row: amplification_factor, max_gap_growth, verdict, without intervals. Undefined gaps are skipped."""
    pick = lambda name, side: F.max(F.when(F.col("metric") == name, F.col(side)))
    one = pairs.agg(pick("disparate_impact_ratio", "source").alias("s"), pick("disparate_impact_ratio", "synthetic").alias("t"), F.max(F.when(F.col("metric").isin(*GAPS), F.col("delta"))).alias("max_gap_growth"))
    one = one.withColumn("amplification_factor", amplification_factor(F.col("s"), F.col("t")))
    fair, f, g = F.col("s") >= FAIR_SOURCE, F.coalesce("amplification_factor", F.lit(0.0)), F.coalesce("max_gap_growth", F.lit(0.0))
    fail = (fair & (F.col("t") < INTRODUCED)) | (f > FACTOR_FAIL) | (g > GROWTH_FAIL)
    review = (fair & (F.col("t") < DRIFTED)) | (f > FACTOR_REVIEW) | (g > GROWTH_REVIEW)
    return one.select("amplification_factor", "max_gap_growth", F.when(fail, "fail").when(review, "review").otherwise("pass").alias("verdict"))


def _apart(source: dict, synthetic: dict, metric: str) -> bool:
    """Whether the synthetic interval lies wholly on the worse side of the source's; true where one is missing."""
    a, b = source.get(metric), synthetic.get(metric)
    if not a or not b:
        return True
    return b["upper"] < a["lower"] if metric == "disparate_impact_ratio" else b["lower"] > a["upper"]


def bias_findings(source: dict, synthetic: dict, apart: dict, limits: dict) -> tuple[str, list[dict]]:
    """(verdict, findings) of two sides' metrics. apart: whether a metric's intervals lie apart, without which nothing is found.

    One signal for the ratio (amplified against an unfair source, introduced into a fair one) and one for the gap that
    grew most; each fails, drifts or holds by its two limits. What only drifts is told once, and only if nothing fails.
    """
    s, t = source["disparate_impact_ratio"], synthetic["disparate_impact_ratio"]
    known = s is not None and t is not None
    factor = (1 - t) / (1 - s) if known and s < limits["source_fair_di"] else None
    growth = {m: synthetic[m] - source[m] for m in GAPS if source[m] is not None and synthetic[m] is not None}
    worst = max(growth, key=growth.get, default=None)  # the first in the fixed order wins ties
    level = lambda value, review, fail: 2 if value > fail else int(value > review)
    ratio_level = gap_level = 0
    if known and apart["disparate_impact_ratio"]:
        ratio_level = level(factor, limits["review_amplification"], limits["max_amplification"]) if factor is not None else level(-t, -limits["review_introduced_di"], -limits["introduced_disparity_di"])
    if worst is not None and apart[worst]:
        gap_level = level(growth[worst], limits["review_gap_growth"], limits["max_gap_growth"])
    grown, found = growth[worst] if worst else 0.0, []
    if factor is not None and ratio_level == 2:
        found.append({"code": "bias_amplified", "amplification_factor": factor})
    if factor is None and ratio_level:
        found.append({"code": "disparity_introduced" if ratio_level == 2 else "disparity_drift", "source_di": s, "synthetic_di": t})
    if gap_level == 2:
        found.append({"code": "gap_grew", "metric": worst, "max_gap_growth": grown})
    if not found and max(ratio_level, gap_level) == 1:
        found.append({"code": "bias_drift", "amplification_factor": factor, "max_gap_growth": grown})
    verdict = ("pass", "review", "fail")[max(ratio_level, gap_level)]
    if verdict == "pass" and factor is not None and factor < FACTOR_NOTE:
        found.append({"code": "bias_dampened", "amplification_factor": factor})
    return verdict, found


def audit_bias_amplification(source: DataFrame, synthetic: DataFrame, spec: AuditSpec, bootstrap: int = 200, bootstrap_seed: int = 42, limits: dict | None = None) -> dict:
    """The bias axis as a document. Every trigger also needs separated intervals, where there are intervals."""
    limits = LIMITS | (limits or {})
    a, b = (audit_disparities(df, spec, bootstrap=bootstrap, bootstrap_seed=bootstrap_seed) for df in (source, synthetic))
    sides = [{m: getattr(x, m) for m in METRICS} for x in (a, b)]
    verdict, found = bias_findings(*sides, {m: _apart(a.confidence_intervals, b.confidence_intervals, m) for m in METRICS}, limits)
    delta = {m: None if None in (sides[0][m], sides[1][m]) else sides[1][m] - sides[0][m] for m in METRICS}
    s, t = (x["disparate_impact_ratio"] for x in sides)
    fair = s is not None and s >= limits["source_fair_di"]
    factor = None if fair or s is None or t is None else (1 - t) / (1 - s)
    introduced = (None if t is None else 1 - t) if factor is None else 0.0
    metrics = {"source": sides[0], "synthetic": sides[1], "delta": delta, "gap_growth": {m: delta[m] for m in GAPS if delta[m] is not None}}
    return {"verdict": verdict, "amplification_factor": factor, "introduced_disparity": introduced, "metrics": metrics, "source_audit": a.to_dict(), "synthetic_audit": b.to_dict(), "findings": found}
