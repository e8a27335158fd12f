"""Queries of the disparity audit, evidence and gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap, gate
from ..operators import disparity as D
from ..operators import regulatory as R
from . import bindings as B

COUNTS = ["group", "n", "tp", "fp", "fn", "tn"]
RATES = ["selection_rate", "tpr", "fpr", "precision", "accuracy"]


def group_confusion(spark, sf_dir):
    return D.confusion(B.labelled(spark, sf_dir), B.DOC_LANG).select(*COUNTS)


def group_rates(spark, sf_dir):
    return D.group_rates(D.confusion(B.orders(spark, sf_dir), B.ORDER)).select(*COUNTS, *RATES)


def disparity_summary(spark, sf_dir):
    return D.summary(D.group_rates(D.confusion(B.labelled(spark, sf_dir), B.DOC_LANG)))


def line_summary(spark, sf_dir):
    return D.summary(D.group_rates(D.confusion(B.lines(spark, sf_dir), B.LINE)))


def _biased_findings(spark, sf_dir):
    one = D.summary(D.group_rates(D.confusion(B.biased(spark, sf_dir), B.ORDER)))
    return gate.findings(D.long_summary(one), gate.threshold_table(spark))


def gate_findings(spark, sf_dir):
    return _biased_findings(spark, sf_dir).withColumn("value", F.round("value", 9))


def gate_status(spark, sf_dir):
    return gate.status(_biased_findings(spark, sf_dir))


def intersectional_rates(spark, sf_dir):
    return D.group_rates(D.confusion(B.labelled(spark, sf_dir), B.DOC_CROSS)).select(*COUNTS, *RATES)


def outcome_rate_audit(spark, sf_dir):
    spec = D.AuditSpec("truth", ("segment",))
    return D.group_rates(D.confusion(B.orders(spark, sf_dir), spec), outcome_only=True).select("group", "n", *RATES)


def min_group_review(spark, sf_dir):
    return D.undersized(D.confusion(B.labelled(spark, sf_dir), B.DOC_CROSS), 5)


def no_positive_review(spark, sf_dir):
    counts = D.confusion(B.lines(spark, sf_dir, 999.0), B.LINE)
    one = D.summary(D.group_rates(counts)).select("n_total", "disparate_impact_ratio")
    return one.join(F.broadcast(D.review_reasons(counts, None)))  # one summary row, at most three reasons


def cube_slices(spark, sf_dir):
    return D.group_rates(D.cube_confusion(B.orders(spark, sf_dir), B.ORDER_CROSS)).select("slice", *COUNTS, "selection_rate")


def cube_disparity(spark, sf_dir):
    return D.summary(D.group_rates(D.cube_confusion(B.orders(spark, sf_dir), B.ORDER_CROSS)).filter("slice <> ''"), "slice")


SAMPLES = 20


def bootstrap_hash_ci(spark, sf_dir):
    keyed = B.labelled(spark, sf_dir).select(F.col("quality").alias("truth"), F.col("toxic").alias("pred"), F.col("lang").alias("group"), "doc_id")
    w = Window.partitionBy("group")
    numbered = keyed.withColumn("i", F.row_number().over(w.orderBy("doc_id")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    out = bootstrap.intervals(bootstrap.hashed_replicates(numbered, SAMPLES, 42), SAMPLES)
    return out.select("metric", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


def bootstrap_multinomial_ci(spark, sf_dir):
    return bootstrap.bootstrap_intervals(D.confusion(B.orders(spark, sf_dir), B.ORDER), 200)


def risk_tier_classification(spark, sf_dir):
    """Customers as systems: their segment and nation stand for use cases, one of them unknown."""
    keys = [k for k, *_ in R.use_cases()] + ["not_a_use_case"]
    table = F.array(*map(F.lit, keys))
    nation = F.element_at(table, (F.col("c_nationkey") % len(keys) + 1).cast("int"))
    other = F.element_at(table, ((F.col("c_custkey") * 7) % len(keys) + 1).cast("int"))
    profiles = B.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("system"), F.explode(F.array(nation, other)).alias("use_case"))
    return R.classify_systems(profiles, spark)


def gate_cross_check(spark, sf_dir):
    """The verdict of every tier under the gate status of each region."""
    regions = B.biased(spark, sf_dir)
    counts = D.confusion(regions.withColumn("segment", F.concat_ws("~", "region", "segment")), B.ORDER).withColumn("region", F.substring_index("group", "~", 1))
    one = D.summary(D.group_rates(counts), "region")
    long = one.unpivot(["region"], list(D.METRICS), "check", "value")
    ok = F.when(F.col("op") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    found = long.join(F.broadcast(gate.threshold_table(spark)), "check").withColumn("status", F.when(F.col("value").isNull(), "skipped").when(ok, "pass").otherwise("fail"))
    states = gate.status(found, "region").withColumn("tier", F.explode(F.array(*map(F.lit, R.TIERS))))
    return states.select("region", "status", "tier", R.cross_check(F.col("status"), F.col("tier")).alias("verdict"))


QUERIES = {f.__name__: f for f in (group_confusion, group_rates, disparity_summary, line_summary, gate_findings, gate_status, intersectional_rates, outcome_rate_audit, min_group_review, no_positive_review, cube_slices, cube_disparity, bootstrap_hash_ci, bootstrap_multinomial_ci, risk_tier_classification, gate_cross_check)}

_c = '"group", n, tp, fp, fn, tn'
_r = 'selection_rate, tpr, fpr, "precision", accuracy'
_cross = "x AS (SELECT truth, pred, 'lang=' || g || ' | source=' || source AS g FROM l)"
_cube = """b AS (SELECT 'segment' AS slice, 'segment=' || g AS grp, truth, pred FROM o UNION ALL SELECT 'region', 'region=' || region, truth, pred FROM o
  UNION ALL SELECT 'segment,region', 'segment=' || g || ' | region=' || region, truth, pred FROM o UNION ALL SELECT '', '', truth, pred FROM o)"""
_keys = ", ".join(f"('{k}', {i}, {rank})" for i, (k, _, rank, _) in enumerate(R.use_cases()))
ORACLES = {
    "group_confusion": f"WITH {B.SQL_LABELLED}, {B.sql_counts('l')} SELECT {_c} FROM c",
    "group_rates": f"WITH {B.SQL_ORDERS}, {B.sql_counts('o')}, {B.sql_rates()} SELECT {_c}, {_r} FROM r",
    "disparity_summary": f"WITH {B.SQL_LABELLED}, {B.sql_counts('l')}, {B.sql_rates()}, {B.sql_summary()} SELECT * FROM s",
    "line_summary": f"""WITH i AS (SELECT CAST(l_linestatus = 'F' AS INT) AS truth, CAST(l_quantity > 25 AS INT) AS pred, l_returnflag AS g FROM lineitem),
{B.sql_counts('i')}, {B.sql_rates()}, {B.sql_summary()} SELECT * FROM s""",
    "gate_findings": f"""WITH {B.SQL_ORDERS}, {B.sql_counts('o', pred='biased')}, {B.sql_rates()}, {B.sql_summary()}, {B.SQL_LIMITS}, {B.SQL_LONG}, {B.SQL_FOUND}
SELECT "check", round(value, 9) AS value, op, "limit", status FROM f""",
    "gate_status": f"""WITH {B.SQL_ORDERS}, {B.sql_counts('o', pred='biased')}, {B.sql_rates()}, {B.sql_summary()}, {B.SQL_LIMITS}, {B.SQL_LONG}, {B.SQL_FOUND}
SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'review') THEN 'review' ELSE 'pass' END AS status FROM f""",
    "intersectional_rates": f"WITH {B.SQL_LABELLED}, {_cross}, {B.sql_counts('x')}, {B.sql_rates()} SELECT {_c}, {_r} FROM r",
    "outcome_rate_audit": f"""WITH {B.SQL_ORDERS} SELECT g AS "group", count(*) AS n, avg(truth::DOUBLE) AS selection_rate, NULL::DOUBLE AS tpr, NULL::DOUBLE AS fpr, NULL::DOUBLE AS "precision", NULL::DOUBLE AS accuracy FROM o GROUP BY g""",
    "min_group_review": f'WITH {B.SQL_LABELLED}, {_cross}, {B.sql_counts("x")} SELECT "group", n FROM c WHERE n < 5',
    "no_positive_review": f"""WITH i AS (SELECT CAST(l_linestatus = 'F' AS INT) AS truth, CAST(l_quantity > 999 AS INT) AS pred, l_returnflag AS g FROM lineitem),
{B.sql_counts('i')}, {B.sql_rates()}, {B.sql_summary()} SELECT n_total, disparate_impact_ratio, 'no_positive_predictions' AS code, '' AS detail FROM s""",
    "cube_slices": f"WITH {B.SQL_ORDERS}, {_cube}, {B.sql_counts('b', 'grp', extra='slice')}, {B.sql_rates()} SELECT slice, {_c}, selection_rate FROM r",
    "cube_disparity": f"WITH {B.SQL_ORDERS}, {_cube}, {B.sql_counts('b', 'grp', extra='slice')}, {B.sql_rates()}, {B.sql_summary(by='slice')} SELECT * FROM s WHERE slice <> ''",
    "bootstrap_hash_ci": f"""WITH l AS (SELECT quality AS truth, toxic AS pred, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM labels JOIN documents USING (doc_id)),
k AS (SELECT unnest(range({SAMPLES})) AS k), d AS (SELECT k, g, CAST(floor(CAST('0x' || substr(md5('42|' || k || '|' || g || '|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * m) AS BIGINT) AS i FROM l, k),
z AS (SELECT d.k, d.g, l.truth, l.pred FROM d JOIN l ON d.g = l.g AND d.i = l.i), {B.sql_counts('z', extra='k')}, {B.sql_rates()}, {B.sql_summary(by='k')},
v AS (SELECT 'demographic_parity_diff' AS metric, demographic_parity_diff AS value FROM s UNION ALL SELECT 'disparate_impact_ratio', disparate_impact_ratio FROM s UNION ALL SELECT 'tpr_gap', tpr_gap FROM s
  UNION ALL SELECT 'fpr_gap', fpr_gap FROM s UNION ALL SELECT 'selection_rate:' || "group", selection_rate FROM r)
SELECT metric, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM v GROUP BY metric HAVING count(value) = {SAMPLES}""",
    "risk_tier_classification": f"""WITH u(use_case, i, tier_rank) AS (VALUES {_keys}), p AS (SELECT c_custkey AS system, unnest([c_nationkey % 28, (c_custkey * 7) % 28]) AS i FROM customer)
SELECT system, CASE coalesce(min(tier_rank), 3) WHEN 0 THEN 'prohibited' WHEN 1 THEN 'high_risk' WHEN 2 THEN 'transparency' ELSE 'minimal' END AS tier, count(*) FILTER (use_case IS NULL) AS unknown
FROM p LEFT JOIN u USING (i) GROUP BY system""",
    "gate_cross_check": f"""WITH {B.SQL_ORDERS}, {B.sql_counts('o', pred='biased', extra='region')}, {B.sql_rates()}, {B.sql_summary(by='region')}, {B.SQL_LIMITS},
v AS (SELECT region, 'demographic_parity_diff' AS "check", demographic_parity_diff AS value FROM s UNION ALL SELECT region, 'disparate_impact_ratio', disparate_impact_ratio FROM s UNION ALL SELECT region, 'tpr_gap', tpr_gap FROM s UNION ALL SELECT region, 'fpr_gap', fpr_gap FROM s),
g AS (SELECT region, CASE WHEN bool_or(value IS NOT NULL AND NOT CASE op WHEN 'min' THEN value >= "limit" ELSE value <= "limit" END) THEN 'fail' ELSE 'pass' END AS status FROM v JOIN t USING ("check") GROUP BY region)
SELECT region, status, tier, CASE WHEN tier = 'prohibited' THEN 'hard_stop' WHEN status <> 'pass' THEN 'blocked' WHEN tier = 'high_risk' THEN 'conditional_pass' ELSE 'pass' END AS verdict
FROM g, (VALUES ('prohibited'), ('high_risk'), ('transparency'), ('minimal')) AS q(tier)""",
}
