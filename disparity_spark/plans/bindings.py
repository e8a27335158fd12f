"""Decision tables, table pairs and logs bound to the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.disparity import AuditSpec
from ..session import load

DOC_LANG, DOC_CROSS = AuditSpec("quality", ("lang",), "toxic"), AuditSpec("quality", ("lang", "source"), "toxic")
ORDER, ORDER_CROSS = AuditSpec("truth", ("segment",), "pred"), AuditSpec("truth", ("segment", "region"), "pred")
LINE = AuditSpec("truth", ("l_returnflag",), "pred")


def labelled(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def orders(spark, sf_dir) -> DataFrame:
    """truth, pred, biased, segment, region of each order."""
    joined = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    held_back = (F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderkey") % 2 == 0)
    return joined.select((F.col("o_orderstatus") == "F").cast("int").alias("truth"), urgent.cast("int").alias("pred"), (urgent & ~held_back).cast("int").alias("biased"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))


def biased(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).drop("pred").withColumnRenamed("biased", "pred")


def lines(spark, sf_dir, least: float = 25.0) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "F").cast("int").alias("truth"), (F.col("l_quantity") > least).cast("int").alias("pred"), "l_returnflag")


def halves(spark, sf_dir, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of even keys (the source) and of odd keys (the synthetic side)."""
    df = load(spark, sf_dir, name)
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 != 0)


SQL_LABELLED = "l AS (SELECT quality AS truth, toxic AS pred, lang AS g, source, n_chars FROM labels JOIN documents USING (doc_id))"
SQL_ORDERS = """o AS (SELECT CAST(o_orderstatus = 'F' AS INT) AS truth, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS pred,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (c_mktsegment = 'BUILDING' AND o_orderkey % 2 = 0) AS INT) AS biased, c_mktsegment AS g, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sql_counts(source: str, group: str = "g", pred: str = "pred", name: str = "c", extra: str = "") -> str:
    """A CTE of confusion counts."""
    by = f"{extra}, " if extra else ""
    return f"""{name} AS (SELECT {by}{group} AS "group", count(*) AS n, count(*) FILTER (truth = 1 AND {pred} = 1) AS tp, count(*) FILTER (truth = 0 AND {pred} = 1) AS fp,
  count(*) FILTER (truth = 1 AND {pred} = 0) AS fn, count(*) FILTER (truth = 0 AND {pred} = 0) AS tn FROM {source} GROUP BY ALL)"""


def sql_rates(counts: str = "c", name: str = "r") -> str:
    return f"""{name} AS (SELECT *, (tp + fp)::DOUBLE / n AS selection_rate, tp::DOUBLE / nullif(tp + fn, 0) AS tpr, fp::DOUBLE / nullif(fp + tn, 0) AS fpr,
  tp::DOUBLE / nullif(tp + fp, 0) AS "precision", (tp + tn)::DOUBLE / n AS accuracy FROM {counts})"""


def sql_summary(rates: str = "r", name: str = "s", by: str = "") -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""{name} AS (SELECT {head}CAST(sum(n) AS BIGINT) AS n_total, max(selection_rate) - min(selection_rate) AS demographic_parity_diff,
  CASE WHEN max(selection_rate) = 0 THEN 1.0::DOUBLE ELSE min(selection_rate) / max(selection_rate) END AS disparate_impact_ratio,
  CASE WHEN count(tpr) >= 2 THEN max(tpr) - min(tpr) END AS tpr_gap, CASE WHEN count(fpr) >= 2 THEN max(fpr) - min(fpr) END AS fpr_gap FROM {rates}{tail})"""


SQL_LIMITS = """t("check", op, "limit") AS (VALUES ('disparate_impact_ratio', 'min', 0.8::DOUBLE), ('demographic_parity_diff', 'max', 0.2::DOUBLE), ('tpr_gap', 'max', 0.15::DOUBLE), ('fpr_gap', 'max', 0.15::DOUBLE))"""
SQL_LONG = """v AS (SELECT 'demographic_parity_diff' AS "check", demographic_parity_diff AS value FROM s UNION ALL SELECT 'disparate_impact_ratio', disparate_impact_ratio FROM s
  UNION ALL SELECT 'tpr_gap', tpr_gap FROM s UNION ALL SELECT 'fpr_gap', fpr_gap FROM s)"""
SQL_FOUND = """f AS (SELECT v."check", value, op, "limit", CASE WHEN value IS NULL THEN 'skipped' WHEN (op = 'min' AND value >= "limit") OR (op = 'max' AND value <= "limit") THEN 'pass' ELSE 'fail' END AS status FROM v JOIN t USING ("check"))"""
