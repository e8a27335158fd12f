"""The gate: thresholds, findings, a status of pass, fail or review, and exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .disparity import METRICS, AuditResult, merged_thresholds, passes

EXIT = {"pass": 0, "fail": 1, "review": 2}


def threshold_table(spark, thresholds: dict | None = None) -> DataFrame:
    """check, op, limit: four rows."""
    rows = [(check, op, float(limit)) for check, rule in merged_thresholds(thresholds).items() for op, limit in rule.items()]
    return spark.createDataFrame(rows, "check string, op string, limit double")


def findings(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """check, value, op, limit, status for values (check, value); the thresholds have one row per check and are broadcast."""
    ok = F.when(F.col("op") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    status = F.when(F.col("value").isNull(), "skipped").when(ok, "pass").otherwise("fail")
    return values.join(F.broadcast(thresholds), "check").select("check", "value", "op", "limit", status.alias("status"))


def crossing_findings(found: DataFrame, intervals: DataFrame) -> DataFrame:
    """Passing checks whose interval crosses the limit: review findings."""
    worse = F.when(F.col("op") == "min", F.col("lower") < F.col("limit")).otherwise(F.col("upper") > F.col("limit"))
    hit = found.filter("status = 'pass'").join(intervals.withColumnRenamed("metric", "check"), "check").filter(worse)
    return hit.select(F.concat(F.lit("evidence:confidence_interval:"), "check").alias("check"), "value", "op", "limit", F.lit("review").alias("status"))


def reason_findings(reasons: DataFrame) -> DataFrame:
    void = F.lit(None)
    return reasons.select(F.concat(F.lit("evidence:"), "code").alias("check"), void.cast("double").alias("value"), void.cast("string").alias("op"), void.cast("double").alias("limit"), F.lit("review").alias("status"))


def status(found: DataFrame, *by: str) -> DataFrame:
    """status: fail before review before pass."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return found.groupBy(*by).agg(F.when(any_of("fail"), "fail").when(any_of("review"), "review").otherwise("pass").alias("status"))


def evaluate_gate_status(result: AuditResult, thresholds: dict | None = None) -> dict:
    """The status and findings of an audit document."""
    out = []
    for check, rule in merged_thresholds(thresholds or result.thresholds or None).items():
        value = getattr(result, check)
        ok = passes(value, rule)
        out.append({"check": check, "value": value, "threshold": rule, "status": "skipped" if ok is None else "pass" if ok else "fail"})
    for f in [f for f in out if f["status"] == "pass"]:
        ends = result.confidence_intervals.get(f["check"])
        (op, limit), = f["threshold"].items()
        if ends and (ends["lower"] < limit if op == "min" else ends["upper"] > limit):
            out.append({"check": f"evidence:confidence_interval:{f['check']}", "value": f["value"], "threshold": f["threshold"], "status": "review", "reason": f"the interval {ends['lower']:.4f}..{ends['upper']:.4f} crosses the limit"})
    out += [{"check": f"evidence:{r['code']}", "value": None, "threshold": None, "status": "review", "reason": r.get("detail", "")} for r in result.review_reasons]
    states = {f["status"] for f in out}
    return {"status": next((s for s in ("fail", "review") if s in states), "pass"), "findings": out}


def evaluate_gate(result: AuditResult, thresholds: dict | None = None) -> bool:
    return evaluate_gate_status(result, thresholds)["status"] == "pass"


def decide_exit(state: str, fail_mode: str = "block", review: str = "fail") -> int:
    """Exit code under a policy: advisory gates never fail; review may count as pass."""
    if fail_mode == "advisory" or state == "review" and review == "pass":
        return 0
    return EXIT[state]


__all__ = ["METRICS", "crossing_findings", "decide_exit", "evaluate_gate", "evaluate_gate_status", "findings", "reason_findings", "status", "threshold_table"]
