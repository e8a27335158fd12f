import math

import duckdb
import pytest
from pyspark.sql import functions as F

from disparity_spark import sources
from disparity_spark.operators import amplification, fidelity, privacy, synthetic
from disparity_spark.operators.disparity import AuditSpec
from disparity_spark.plans import synthetics
from tests.conftest import DATA
from tests.oracle import TABLES, agree

SPEC = AuditSpec("on_time", ("group",), "priority_route")
NUMBERS, LABELS = ["packages_assigned"], ["group"]


@pytest.fixture(scope="module")
def source(spark):
    return sources.generate_dispatch(spark, 600, 0.4, 11).drop("driver_id").cache()


def test_identical_tables(spark, source):
    assert fidelity.audit_fidelity(source, source, NUMBERS, LABELS)["fidelity_score"] == 1.0
    found = privacy.audit_privacy(source, source, NUMBERS, LABELS, sample=300)
    assert found["distance_ratio_risk"] in (0.0, 1.0) and found["duplicate_rate"] == 1.0
    document = synthetic.audit_synthetic(source.withColumn("x", F.rand(1)), source.withColumn("x", F.rand(1)), synthetic.SyntheticAuditConfig("on_time", ("group",), "priority_route"), bootstrap=20)
    assert document["axes"]["privacy"]["verdict"] == "fail" == document["verdict"]


def test_shifted_numbers_and_vanished_groups(spark, source):
    moved = source.withColumn("packages_assigned", F.col("packages_assigned") + 500)
    out = fidelity.audit_fidelity(source, moved, NUMBERS, LABELS)
    assert out["fidelity_score"] < 0.9 and any(f["code"] == "low_column_fidelity" for f in out["findings"])
    gone = fidelity.audit_fidelity(source, source.filter("group <> 'C'"), NUMBERS, LABELS)
    assert any(f["code"] == "vanished_categories" for f in gone["findings"]) and gone["verdict"] != "pass"


def test_distances(spark):
    a = spark.createDataFrame([(float(x), "u") for x in (1, 2, 3)] + [(float("nan"), "u")], "x double, c string")
    b = spark.createDataFrame([(float(x), "v") for x in (7, 8)], "x double, c string")
    assert fidelity.ks_statistic(a, b, ["x"]).first().ks == 1.0
    assert fidelity.ks_statistic(a, a, ["x"]).first().ks == 0.0
    assert fidelity.total_variation(fidelity.category_shares(a, b, ["c"])).first().tvd == 1.0
    with pytest.raises(ValueError):
        fidelity.audit_fidelity(a.limit(0), b, ["x"], [])


def test_constant_columns_have_no_correlation(spark):
    a = spark.createDataFrame([(float(i), float(2 * i), 1.0) for i in range(20)], "a double, b double, k double")
    b = spark.createDataFrame([(float(i), float((i * 7) % 5), 1.0) for i in range(20)], "a double, b double, k double")
    drift = fidelity.correlation_drift(a, b, ["a", "b"]).first()
    assert drift.mean_abs_drift > 0.5 and drift.normalized == drift.mean_abs_drift / 2
    assert fidelity.correlation_drift(a, b, ["a", "k"]).first().mean_abs_drift == 0.0
    assert fidelity.correlation_drift(a, b, ["a"]).first().normalized is None


def test_jittered_copy_is_risky_and_independent_draw_is_not(spark):
    a = spark.range(300).select((F.hash("id") % 10_000).cast("double").alias("x"), (F.hash(F.col("id") + 5) % 10_000).cast("double").alias("y"))
    near = a.select((F.col("x") + 1).alias("x"), (F.col("y") - 1).alias("y"))
    free = spark.range(300).select((F.hash(F.col("id") + 9_999) % 10_000).cast("double").alias("x"), (F.hash(F.col("id") + 7_777) % 10_000).cast("double").alias("y"))
    assert privacy.privacy_summary(a, near, ["x", "y"], []).first().verdict == "fail"
    assert privacy.privacy_summary(a, free, ["x", "y"], []).first().privacy_risk < 0.25


@pytest.mark.parametrize(("a", "b", "verdict", "code"), [(0.4, 0.4, "pass", None), (0.4, 0.9, "fail", "bias_amplified"), (0.0, 0.8, "fail", "disparity_introduced")])
def test_bias(spark, a, b, verdict, code):
    out = amplification.audit_bias_amplification(sources.generate_dispatch(spark, 3000, a, 1), sources.generate_dispatch(spark, 3000, b, 2), SPEC, bootstrap=40)
    assert out["verdict"] == verdict and (code is None or code in {f["code"] for f in out["findings"]})


def test_one_group_has_no_gap_growth(spark):
    df = sources.generate_dispatch(spark, 200, 0.0).withColumn("group", F.lit("A"))
    assert amplification.audit_bias_amplification(df, df, SPEC, bootstrap=0)["verdict"] == "pass"


def test_configuration():
    c = synthetic.SyntheticAuditConfig.from_dict({"truth": "t", "groups": ["g"], "thresholds": {"fidelity": {"pass_score": 0.95}, "bias": {"max_amplification": 2, "review_gap_growth": 0.2}}})
    assert c.spec.groups == ("g",)
    for bad in ({}, {"truth": "t", "groups": ["g"], "x": 1}, {"truth": "t", "groups": ["g"], "thresholds": {"x": {}}}, {"truth": "t", "groups": ["g"], "thresholds": {"bias": {"max_gap_growth": "much"}}}):
        with pytest.raises(ValueError):
            synthetic.SyntheticAuditConfig.from_dict(bad)


def test_generators(spark):
    df = sources.generate_dispatch(spark, 4000, 0.5, 42)
    assert df.exceptAll(sources.generate_dispatch(spark, 4000, 0.5, 42).repartition(3)).isEmpty()
    one = df.agg(F.min("packages_assigned").alias("a"), F.max("packages_assigned").alias("b"), F.avg((F.col("group") == "A").cast("int")).alias("s")).first()
    assert (one.a, one.b) == (20, 119) and math.isclose(one.s, 0.5, abs_tol=0.03)
    rates = {r["group"]: r["m"] for r in df.groupBy("group").agg(F.avg("priority_route").alias("m")).collect()}
    assert math.isclose(rates["A"], 0.55, abs_tol=0.04) and math.isclose(rates["C"], 0.325, abs_tol=0.05)
    assert sources.generate_staffing(spark, 100).select(F.max("tenure_months")).first()[0] <= 59
    for n, bias in ((0, 0.1), (5, 1.5), (True, 0.0)):
        with pytest.raises(ValueError):
            sources.generate_dispatch(spark, n, bias)


def test_nearest_takes_others_of_any_size_in_blocks(spark):
    rows = [(i, [float((i * 37) % 101), float((i * 53) % 89)]) for i in range(150)]
    rows += rows[:2]  # repeated rows stay
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for same in (False, True):
        whole, blocks = (sorted(map(tuple, privacy.nearest(df, df, same, **how).collect())) for how in ({"limit": 1000}, {"limit": None, "block": 16 * 40}))
        assert blocks == whole and len(whole) == 152


def test_bias_findings():
    side = lambda ratio, gap=0.0: {"disparate_impact_ratio": ratio, "demographic_parity_diff": gap, "tpr_gap": None, "fpr_gap": 0.0}
    apart = dict.fromkeys(side(1.0), True)

    def codes(a, b, limits=amplification.LIMITS, apart=apart):
        verdict, found = amplification.bias_findings(a, b, apart, limits)
        return verdict, [f["code"] for f in found]

    assert codes(side(0.5), side(0.3)) == ("fail", ["bias_amplified"]) and codes(side(0.5), side(0.3), amplification.LIMITS | {"max_amplification": 2}) == ("review", ["bias_drift"])
    assert codes(side(0.95), side(0.85)) == ("review", ["disparity_drift"]) and codes(side(0.95), side(0.7)) == ("fail", ["disparity_introduced"])
    assert codes(side(0.5), side(0.44, 0.07)) == ("review", ["bias_drift"])  # both drift: told once
    assert codes(side(0.5), side(0.44, 0.2)) == ("fail", ["gap_grew"]) and codes(side(0.5), side(0.9)) == ("pass", ["bias_dampened"])
    assert codes(side(0.5), side(0.9, 0.2)) == ("fail", ["gap_grew"])  # dampening is told only if all is well
    assert codes(side(0.5), side(0.3, 0.2), apart=dict.fromkeys(apart, False)) == ("pass", []) and codes(side(None), side(0.3)) == ("pass", [])


def test_privacy_verdict_takes_all_rows(spark, tmp_path):
    """More rows a side than a sample holds, equal rows on one side and on both."""
    source = DATA / "sf0.1"
    if not source.exists():
        pytest.skip("the test tables aren't here")
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(source / f"{t}.parquet")
    (tmp_path / "part.parquet").unlink()
    duckdb.execute(f"""COPY (SELECT * FROM '{source}/part.parquet' WHERE p_partkey <= 4600 UNION ALL SELECT * REPLACE (p_partkey + 10000 AS p_partkey) FROM '{source}/part.parquet' WHERE p_partkey <= 200
        UNION ALL SELECT * REPLACE (p_partkey + 20001 AS p_partkey) FROM '{source}/part.parquet' WHERE p_partkey <= 100) TO '{tmp_path}/part.parquet'""")
    agree(spark, str(tmp_path), synthetics.privacy_verdict, synthetics.ORACLES["privacy_verdict"])
