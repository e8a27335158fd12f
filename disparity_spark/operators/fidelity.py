"""Fidelity of a synthetic table: marginal distances, correlation drift, coverage, a score and a verdict.

Each distance is one plan over all columns of its kind: values are unpivoted to (column, value), counted per side, and
compared within the column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratio, usable_number

#: Score limits, source share of a vanished category that counts, similarity of a finding.
PASS, REVIEW = 0.90, 0.75
MAJOR_SHARE, LOW_SIMILARITY = 0.01, 0.5


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers; booleans are categories."""
    return isinstance(dtype, T.NumericType)


def resolve_columns(source: DataFrame, synthetic: DataFrame, numeric=None, categorical=None, exclude=()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns that both tables have, in the source's order."""
    shared = [c for c in source.columns if c in synthetic.columns and c not in set(exclude)]
    for c in (*(numeric or ()), *(categorical or ())):
        if c not in shared:
            raise ValueError(f"column {c!r} is not shared by both tables")
    both = {c: is_numeric(source.schema[c].dataType) and is_numeric(synthetic.schema[c].dataType) for c in shared}
    numbers = list(numeric) if numeric is not None else [c for c in shared if both[c] and c not in (categorical or ())]
    return numbers, list(categorical) if categorical is not None else [c for c in shared if not both[c] and c not in numbers]


def long_numbers(df: DataFrame, columns) -> DataFrame:
    """column, value of the usable numbers."""
    pairs = [F.struct(F.lit(c).alias("column"), usable_number(F.col(c)).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").filter("value is not null")


def long_labels(df: DataFrame, columns) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def sided_counts(source: DataFrame, synthetic: DataFrame) -> DataFrame:
    """column, value, a (count in the source), b (in the synthetic table): one shuffle of partial counts."""
    both = source.withColumn("side", F.lit(0)).unionByName(synthetic.withColumn("side", F.lit(1)))
    return both.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


def ks_statistic(source: DataFrame, synthetic: DataFrame, columns) -> DataFrame:
    """column, ks: the largest difference of the cumulative shares. Null where a side has no numbers.

    A first pass takes each column's counts and 63 approximate quantiles (one row a column, to the driver). Distinct
    values are then dealt to the ranges between them, so that one column's values needn't meet in one task. Within a
    range the difference is its value at the start, the same for the whole range, plus a running one; so each range
    only leaves its sums and the extremes of the running difference, and the starts are added up over ranges.
    """
    spark = source.sparkSession
    sides = [long_numbers(df, columns) for df in (source, synthetic)]
    both = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1)))
    quantiles = F.approx_percentile("value", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1000))
    totals = both.groupBy("column").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), quantiles.alias("cuts")).collect()
    known = spark.createDataFrame([(r["column"], r.na, r.nb, r.cuts) for r in totals], "column string, na long, nb long, cuts array<double>")
    counts = sided_counts(*sides).join(F.broadcast(known), "column").withColumn("range", F.size(F.filter("cuts", lambda c: F.col("value") > c)))
    inside = Window.partitionBy("column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x, n: ratio(x, F.col(n))
    steps = counts.withColumn("gap", share(F.sum("a").over(inside), "na") - share(F.sum("b").over(inside), "nb"))
    ranges = steps.groupBy("column", "range", "na", "nb").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("gap").alias("most"), F.min("gap").alias("least"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(share(F.sum("a").over(before), "na") - share(F.sum("b").over(before), "nb"), F.lit(0.0))
    placed = ranges.withColumn("start", start)
    return placed.groupBy("column").agg(F.max(F.greatest(F.abs(F.col("start") + F.col("most")), F.abs(F.col("start") + F.col("least")))).alias("ks"))


def category_shares(source: DataFrame, synthetic: DataFrame, columns) -> DataFrame:
    """column, value, p, q: shares on both sides over the union of values."""
    counts = sided_counts(long_labels(source, columns), long_labels(synthetic, columns))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return counts.join(F.broadcast(totals), "column").select("column", "value", ratio(F.col("a"), F.col("na")).alias("p"), ratio(F.col("b"), F.col("nb")).alias("q"))


def total_variation(shares: DataFrame) -> DataFrame:
    return shares.groupBy("column").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tvd"))


def vanished_categories(shares: DataFrame) -> DataFrame:
    """column, value, source_support of categories that only the source has."""
    return shares.filter("p > 0 and q = 0").select("column", "value", F.col("p").alias("source_support"))


def correlations(df: DataFrame, columns) -> DataFrame:
    """a, b, rho of all pairs of numeric columns in one aggregation; 0 where one has no variance."""
    made = []
    for a, b in combinations(columns, 2):
        x, y = usable_number(F.col(a)), usable_number(F.col(b))
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread)).otherwise(0.0).alias("rho")))
    return df.agg(F.array(*made).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def correlation_drift(source: DataFrame, synthetic: DataFrame, columns) -> DataFrame:
    """One row: mean_abs_drift, normalized; both null below two numeric columns."""
    if len(columns) < 2:
        return source.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean_abs_drift"), F.lit(None).cast("double").alias("normalized"))
    both = correlations(source, columns).join(correlations(synthetic, columns).withColumnRenamed("rho", "other"), ["a", "b"])
    return both.agg(F.avg(F.abs(F.coalesce("rho", F.lit(0.0)) - F.coalesce("other", F.lit(0.0)))).alias("mean_abs_drift")).withColumn("normalized", F.col("mean_abs_drift") / 2)


def marginal_coverage(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> DataFrame:
    """column, coverage: the share of synthetic values within the source's range, or among its categories."""
    out = None
    if numeric:
        ends = long_numbers(source, numeric).groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        out = long_numbers(synthetic, numeric).join(F.broadcast(ends), "column").groupBy("column").agg(F.avg(F.col("value").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"))
    if categorical:
        labels = category_shares(source, synthetic, categorical).groupBy("column").agg(F.sum(F.when(F.col("p") > 0, F.col("q")).otherwise(0.0)).alias("coverage"))
        out = labels if out is None else out.unionByName(labels)
    return out


def _distances(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> DataFrame:
    """column, type, distance, major: the last counts vanished categories of a major share."""
    parts = []
    if numeric:
        parts.append(ks_statistic(source, synthetic, numeric).select("column", F.lit("numeric").alias("type"), F.col("ks").alias("distance"), F.lit(0).cast("long").alias("major")))
    if categorical:
        gone = (F.col("p") >= MAJOR_SHARE) & (F.col("q") == 0)
        shares = category_shares(source, synthetic, categorical).groupBy("column").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"), F.count_if(gone).alias("major"))
        parts.append(shares.select("column", F.lit("categorical").alias("type"), "distance", "major"))
    if not parts:
        raise ValueError("no shared columns to compare")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def column_distances(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> DataFrame:
    """column, type, distance, similarity."""
    return _distances(source, synthetic, numeric, categorical).select("column", "type", "distance", (1 - F.col("distance")).alias("similarity"))


def fidelity_summary(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> DataFrame:
    """One row: fidelity_score, n_columns, major_vanished, verdict. Distances and vanished categories come from the same counts."""
    one = _distances(source, synthetic, numeric, categorical).agg(F.avg(1 - F.col("distance")).alias("fidelity_score"), F.count(F.lit(1)).alias("n_columns"), F.coalesce(F.sum("major"), F.lit(0)).alias("major_vanished"))
    verdict = F.when((F.col("fidelity_score") >= PASS) & (F.col("major_vanished") == 0), "pass").when(F.col("fidelity_score") >= REVIEW, "review").otherwise("fail")
    return one.withColumn("verdict", verdict)


def audit_fidelity(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> dict:
    """The fidelity axis as a document; one row per column is collected."""
    if source.isEmpty() or synthetic.isEmpty():
        raise ValueError("both tables need rows")
    columns = {r.column: {"type": r.type, "ks_statistic" if r.type == "numeric" else "total_variation_distance": r.distance, "similarity": r.similarity} for r in column_distances(source, synthetic, numeric, categorical).orderBy("column").collect()}
    gone = vanished_categories(category_shares(source, synthetic, categorical)).orderBy("column", "value").collect() if categorical else []
    for r in gone:
        columns[r.column].setdefault("vanished_categories", []).append(r.value)
    score = sum(c["similarity"] for c in columns.values()) / len(columns)
    major = any(r.source_support >= MAJOR_SHARE for r in gone)
    found = [{"code": "low_column_fidelity", "column": c, "similarity": v["similarity"]} for c, v in columns.items() if v["similarity"] <= LOW_SIMILARITY]
    found += [{"code": "vanished_categories", "column": r.column, "value": r.value, "source_support": r.source_support} for r in gone]
    verdict = ("review" if major else "pass") if score >= PASS else "review" if score >= REVIEW else "fail"
    drift = correlation_drift(source, synthetic, numeric).first().asDict()
    coverage = {r.column: r.coverage for r in marginal_coverage(source, synthetic, numeric, categorical).collect()}
    return {"verdict": verdict, "fidelity_score": score, "n_columns": len(columns), "columns": columns, "correlation_drift": drift, "marginal_coverage": coverage, "findings": found}
