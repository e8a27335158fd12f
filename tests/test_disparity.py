import pytest
from pyspark.sql import functions as F

from disparity_spark import sources
from disparity_spark.operators import bootstrap, gate
from disparity_spark.operators import disparity as D

SPEC = D.AuditSpec("t", ("g",), "p")


def table(spark, truth, pred, groups):
    return spark.createDataFrame(list(zip(truth, pred, groups, strict=True)), "t int, p int, g string")


def test_worked_example(spark):
    r = D.audit_disparities(table(spark, [1, 1, 0, 0, 1, 1, 0, 0], [1, 0, 0, 0, 1, 1, 1, 0], "AAAABBBB"), SPEC)
    a, b = r.groups
    assert (a.selection_rate, a.tpr, a.fpr, a.precision, a.accuracy) == (0.25, 0.5, 0.0, 1.0, 0.75)
    assert (b.selection_rate, b.tpr, b.fpr, round(b.precision, 9), b.accuracy) == (0.75, 1.0, 0.5, round(2 / 3, 9), 0.75)
    assert (r.demographic_parity_diff, round(r.disparate_impact_ratio, 9), r.tpr_gap, r.fpr_gap) == (0.5, round(1 / 3, 9), 0.5, 0.5)
    assert gate.evaluate_gate_status(r)["status"] == "fail"
    assert D.AuditResult.from_dict(r.to_dict()) == r


@pytest.mark.parametrize(
    ("truth", "pred", "groups", "expected"),
    [([1, 0, 1, 0], [1, 0, 1, 0], "AABB", (0.0, 1.0, 0.0, 0.0)), ([1, 0], [1, 0], "AA", (0.0, 1.0, None, None)), ([1, 0, 1, 0], [0, 0, 0, 0], "AABB", (0.0, 1.0, 0.0, 0.0)), ([0, 0, 1, 1, 1, 0], [0, 1, 1, 0, 1, 0], "AABBCC", (0.0, 1.0, 0.5, 0.5))],
)
def test_edges(spark, truth, pred, groups, expected):
    r = D.audit_disparities(table(spark, truth, pred, groups), SPEC)
    assert (r.demographic_parity_diff, r.disparate_impact_ratio, r.tpr_gap, r.fpr_gap) == expected
    assert any(x["code"] == "no_positive_predictions" for x in r.review_reasons) == (sum(pred) == 0)


def test_invalid_values_and_options(spark):
    with pytest.raises(ValueError, match="other than 0 and 1"):
        D.audit_disparities(table(spark, [2, 0], [1, 0], "AB"), SPEC)
    with pytest.raises(ValueError, match="other than 0 and 1"):
        D.audit_disparities(table(spark, [None, 0], [1, 0], "AB"), SPEC)
    with pytest.raises(ValueError, match="columns not found"):
        D.audit_disparities(table(spark, [1], [1], "A"), D.AuditSpec("x", ("g",)))
    with pytest.raises(ValueError, match="bootstrap"):
        D.audit_disparities(table(spark, [1], [1], "A"), SPEC, bootstrap=1001)
    with pytest.raises(ValueError, match="no rows"):
        D.audit_disparities(table(spark, [], [], ""), SPEC)
    for bad in ({"x": {"min": 1}}, {"tpr_gap": {"min": 1}}, {"tpr_gap": {"max": True}}, {"tpr_gap": {"max": float("nan")}}):
        with pytest.raises(ValueError):
            D.merged_thresholds(bad)


def test_undersized_and_outcome_only(spark):
    df = table(spark, [1, 0, 1], [1, 0, 1], "ABB")
    r = D.audit_disparities(df, D.AuditSpec("t", ("g",)), min_group_n=2)
    assert [x["code"] for x in r.review_reasons] == ["minimum_group_size", "prediction_column_not_provided"]
    assert r.tpr_gap is None and all(g.accuracy is None for g in r.groups)
    assert gate.evaluate_gate_status(D.audit_disparities(df, SPEC, {"disparate_impact_ratio": {"min": 0.1}, "demographic_parity_diff": {"max": 0.9}}, 2))["status"] == "review"


def test_null_and_crossed_labels(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (0, 1, "A", "y")], "t int, p int, g string, h string")
    assert {r.group for r in D.confusion(df, D.AuditSpec("t", ("g", "h"), "p")).collect()} == {"g=nan | h=x", "g=A | h=y"}


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    df = sources.generate_dispatch(spark, 800, 0.5).repartition(partitions)
    r = D.audit_disparities(df, D.AuditSpec("on_time", ("group",), "priority_route"), bootstrap=20)
    assert (round(r.disparate_impact_ratio, 12), r.confidence_intervals["tpr_gap"]["upper"]) == test_results_do_not_depend_on_partitions.__dict__.setdefault("seen", (round(r.disparate_impact_ratio, 12), r.confidence_intervals["tpr_gap"]["upper"]))


def test_interval_that_crosses_the_limit():
    r = D.AuditResult([], 1, 0.1, 0.85, 0.0, 0.0, confidence_intervals={"disparate_impact_ratio": {"lower": 0.70, "upper": 0.95}})
    assert gate.evaluate_gate_status(r)["status"] == "review"
    assert [gate.decide_exit(s, m, v) for s, m, v in (("pass", "block", "block"), ("fail", "block", "block"), ("fail", "advisory", "block"), ("review", "block", "block"), ("review", "block", "pass"))] == [0, 1, 0, 2, 0]


def test_gate_frames(spark):
    counts = spark.createDataFrame([("A", 10, 8, 1, 1, 0), ("B", 10, 4, 1, 3, 2)], "group string, n long, tp long, fp long, fn long, tn long")
    one = D.long_summary(D.summary(D.group_rates(counts)))
    found = gate.findings(one, gate.threshold_table(spark))
    assert {r.check: r.status for r in found.collect()}["disparate_impact_ratio"] == "fail"
    drawn = bootstrap.bootstrap_intervals(counts, 50)
    assert {r.metric for r in drawn.collect()} >= {"demographic_parity_diff", "selection_rate:A", "selection_rate:B"}
    crossing = gate.crossing_findings(found.withColumn("status", F.lit("pass")), drawn)
    assert gate.status(found.unionByName(crossing)).first().status == "fail"


def test_cube_has_every_slice(spark):
    df = spark.createDataFrame([(1, 1, "A", "x"), (0, 0, "B", "y")], "t int, p int, g string, h string")
    assert {r.slice for r in D.cube_confusion(df, D.AuditSpec("t", ("g", "h"), "p")).collect()} == {"", "g", "h", "g,h"}
