"""Privacy of a synthetic table: nearest source rows, memorization, exact duplicates.

Distances are taken between bounded samples (a parameter of the method: `sample` rows a side, chosen by a hash of the
row, so they don't depend on partitioning) or, with `sample` None, between all rows. Equal rows are one point with a
weight; the points of one side are broadcast as matrices of known size, the others are read in batches. Duplicates are
counted over all rows.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp, usable_number

#: Rows a side, risk limits, the percentile below which a distance counts as memorized, finding limits.
SAMPLE = 2000
LOW_RISK, REVIEW_RISK = 0.20, 0.45
CUT = 0.05
HIGH_MEMORIZATION, LOW_CARDINALITY = 0.10, 0.5
#: Bytes of features that are broadcast at once.
BLOCK = 16 << 20
#: Rows of a side of a tile.
TILE = 1024


def hash_sample(df: DataFrame, columns, rows: int, seed: int = 42) -> DataFrame:
    """At most `rows` rows in the order of a seeded hash of all their features."""
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(rows)


def encoded(source: DataFrame, synthetic: DataFrame, numeric, categorical) -> DataFrame:
    """id, features (array of double), n_source, n_synthetic: equal rows as one point, with their number on each side.

    Numbers become z-scores by the source's mean and population deviation (0: 1; missing: the mean); categories become
    ranks among the sorted values of both tables. The codes and statistics are one row, broadcast. The id is of the
    values before that, since sums of doubles may end in other digits when they are taken again.
    """
    cleaned = [*[usable_number(F.col(c)).alias(f"x{i}") for i, c in enumerate(numeric)], *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(f"y{i}") for i, c in enumerate(categorical)]]
    both = source.select(F.lit(0).alias("side"), *cleaned).unionByName(synthetic.select(F.lit(1).alias("side"), *cleaned))
    numbers, labels = [f"x{i}" for i in range(len(numeric))], [f"y{i}" for i in range(len(categorical))]
    own = F.col("side") == 0
    stats = [F.struct(F.avg(F.when(own, F.col(c))).alias("mean"), F.stddev_pop(F.when(own, F.col(c))).alias("std")).alias(f"s{c}") for c in numbers]
    codes = [F.array_sort(F.collect_set(c)).alias(f"s{c}") for c in labels]
    one = both.agg(F.count("*").alias("n_rows"), *stats, *codes)
    points = both.groupBy(*numbers, *labels).agg(F.sum((F.col("side") == 0).cast("long")).alias("n_source"), F.sum((F.col("side") == 1).cast("long")).alias("n_synthetic"))
    scores = [F.coalesce((F.col(c) - F.col(f"s{c}.mean")) / F.when(F.col(f"s{c}.std") > 0, F.col(f"s{c}.std")).otherwise(1.0), F.lit(0.0)) for c in numbers]
    ranks = [(F.array_position(f"s{c}", F.col(c)) - 1).cast("double") for c in labels]
    # A hash passes over nulls, so it is told where they are. `one` has one row.
    return points.crossJoin(F.broadcast(one)).select(F.xxhash64(*numbers, *labels, *[F.col(c).isNull() for c in numbers]).alias("id"), F.array(*scores, *ranks).alias("features"), "n_source", "n_synthetic")


def nearest(queries: DataFrame, others: DataFrame, same: bool = False, limit: int | None = SAMPLE, block: int = BLOCK, carried: tuple = ()) -> DataFrame:
    """id, distance: Euclidean distance of each query (id, features) to the nearest other row; `same` leaves out the row itself.

    Columns of the queries named in `carried` are kept beside these.

    `others` is a sample of at most `limit` rows; longer input is refused. Without a limit it may have any size and is
    taken in blocks of about `block` bytes, with one pass over both tables for each; work grows with the product of both.
    """
    if limit is not None:
        if others.limit(limit + 1).count() > limit:
            raise ValueError(f"nearest() takes at most {limit} rows; sample first or raise the limit")
        return _nearest(queries, others, same, carried)
    size = others.agg(F.coalesce(F.sum(F.size("features").cast("long") * 8), F.lit(0))).first()[0]
    n = max(1, -(-size // block))
    if n == 1:
        return _nearest(queries, others, same, carried)
    of = F.pmod(F.xxhash64("id", "features"), F.lit(n))
    parts = [_nearest(queries, others.filter(of == k), same, ("features", *carried)) for k in range(n)]
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("id", "features", *carried).agg(F.min("distance").alias("distance"), F.count("*").alias("__n"))
    # Equal rows have equal distances: as many are given back as there were.
    return found.select("id", "distance", *carried, F.explode(F.expr(f"array_repeat(0, cast(__n div {n} as int))"))).select("id", "distance", *carried)


def _nearest(queries: DataFrame, others: DataFrame, same: bool, carried: tuple = ()) -> DataFrame:
    """The distances to a table that is broadcast whole; columns of the queries in `carried` stay.

    Query rows meet it in tiles: |x|^2 + |y|^2 - 2xy of centred rows finds those near the least, whose distances are
    then taken from the differences themselves, so that close rows lose no digits.
    """
    spark = queries.sparkSession
    known = others.select("id", "features").toPandas()
    sent = spark.sparkContext.broadcast((known["id"].to_numpy(), np.array(known["features"].tolist(), float)))

    def search(it):
        import pandas as pd

        ids, matrix = sent.value
        centre = matrix.mean(0) if len(ids) else None
        for pdf in it:
            out = []
            for at in range(0, len(pdf) if len(ids) else 0, TILE):
                own = pdf["id"].to_numpy()[at : at + TILE]
                out.append(least_distances(own, np.array(pdf["features"].iloc[at : at + TILE].tolist(), float), ids, matrix, centre, same))
            found = np.concatenate(out) if out else np.full(len(pdf), np.inf)
            distance = pd.array(np.where(np.isinf(found), 0.0, found), dtype="Float64")
            distance[np.isinf(found)] = pd.NA
            yield pd.DataFrame({"id": pdf["id"], "distance": distance, **{c: pdf[c] for c in carried}})

    kept = queries.select("id", "features", *[c for c in carried if c != "features"])
    return kept.mapInPandas(search, ", ".join(["id long", "distance double", *(f"{c} {kept.schema[c].dataType.simpleString()}" for c in carried)]))


def least_distances(own, x, ids, matrix, centre, same: bool) -> np.ndarray:
    """Distance of each row of x to the nearest row of matrix (inf: none); `same` leaves out rows of the query's id."""
    best = np.full(len(x), np.inf)
    a = x - centre
    for at in range(0, len(ids), TILE):
        b = matrix[at : at + TILE] - centre
        na, nb = (a * a).sum(1), (b * b).sum(1)
        squares = na[:, None] + nb[None, :] - 2 * (a @ b.T)
        if same:
            squares[own[:, None] == ids[None, at : at + TILE]] = np.inf
        slack = 1e-9 * (na + nb.max(initial=0))  # more than the products can be off
        i, j = np.nonzero((squares <= (squares.min(1) + slack)[:, None]) & (squares < np.inf))
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            np.minimum.at(best, p, ((x[p] - matrix[at + q]) ** 2).sum(1))
    return np.sqrt(best)


def distance_risks(to_synthetic: DataFrame, to_source: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: median_source_to_synthetic, median_source_to_source, distance_ratio_risk, memorization_rate.

    A row counts as often as its column `weight` says (None: once).
    """
    n = F.lit(1) if weight is None else F.col(weight)
    own = to_source.agg(F.percentile("distance", F.lit(0.5), n).alias("median_source_to_source"), F.percentile("distance", F.lit(CUT), n).alias("cut"))
    near = to_synthetic.crossJoin(F.broadcast(own))  # `own` has one row
    below = F.col("distance") < F.col("cut")
    rate = F.try_divide(F.sum(F.when(below, n).when(~below, 0)).cast("double"), F.sum(F.when(below.isNotNull(), n)).cast("double"))
    one = near.agg(F.percentile("distance", F.lit(0.5), n).alias("median_source_to_synthetic"), F.first("median_source_to_source").alias("median_source_to_source"), rate.alias("memorization_rate"))
    return one.withColumn("distance_ratio_risk", ratio_risk(F.col("median_source_to_source"), F.col("median_source_to_synthetic")))


def ratio_risk(own: Column, other: Column) -> Column:
    return F.when(own == 0, 0.0).when(other == 0, 1.0).otherwise(clamp(1 - F.try_divide(other, own)))


def duplicate_rates(source: DataFrame, synthetic: DataFrame, features) -> DataFrame:
    """One row over all rows: duplicate_rate (synthetic rows that the source has), source_self_duplicate_rate, excess_duplicate_rate.

    Both tables are counted by row in one shuffle of partial counts; missing values are equal.
    """
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t"), *features).unionByName(synthetic.select(F.lit(0).alias("s"), F.lit(1).alias("t"), *features))
    rows = both.groupBy(*features).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    hit = lambda c, of: F.try_divide(F.sum(F.when(c, F.col(of)).otherwise(0)).cast("double"), F.sum(of).cast("double"))
    one = rows.agg(hit(F.col("s") > 0, "t").alias("duplicate_rate"), hit(F.col("s") > 1, "s").alias("source_self_duplicate_rate"))
    return one.withColumn("excess_duplicate_rate", F.greatest(F.lit(0.0), F.col("duplicate_rate") - F.col("source_self_duplicate_rate")))


def verdict(risk: Column) -> Column:
    return F.when(risk <= LOW_RISK, "pass").when(risk <= REVIEW_RISK, "review").otherwise("fail")


def privacy_summary(source: DataFrame, synthetic: DataFrame, numeric, categorical, sample: int | None = SAMPLE, seed: int = 42) -> DataFrame:
    """One row: the distance and duplicate figures, privacy_risk and verdict. With `sample` None distances are taken between all rows; work grows with the product of the distinct rows of both sides."""
    features = [*numeric, *categorical]
    a, b = (df.select(*features) if sample is None else hash_sample(df.select(*features), features, sample, seed) for df in (source, synthetic))
    found = encoded(a, b, numeric, categorical)
    own, other = (found.filter(F.col(c) > 0).select("id", "features", F.col(c).alias("n")) for c in ("n_source", "n_synthetic"))
    to_own = nearest(own, own, same=True, limit=sample, carried=("n",)).withColumn("distance", F.when(F.col("n") > 1, 0.0).otherwise(F.col("distance")))
    risks = distance_risks(nearest(own, other, limit=sample, carried=("n",)), to_own, "n")
    one = risks.crossJoin(F.broadcast(duplicate_rates(source, synthetic, features)))  # one row each
    risk = F.greatest("distance_ratio_risk", "memorization_rate", "excess_duplicate_rate")
    return one.withColumn("privacy_risk", risk).withColumn("verdict", verdict(F.col("privacy_risk")))


def audit_privacy(source: DataFrame, synthetic: DataFrame, numeric, categorical, sample: int = SAMPLE, seed: int = 42) -> dict:
    out = privacy_summary(source, synthetic, numeric, categorical, sample, seed).first().asDict()
    found = []
    if out["distance_ratio_risk"] is not None and out["distance_ratio_risk"] > REVIEW_RISK:
        found.append({"code": "close_synthetic_neighbors", "value": out["distance_ratio_risk"]})
    if out["excess_duplicate_rate"] and out["excess_duplicate_rate"] > 0:
        found.append({"code": "exact_duplicates", "value": out["excess_duplicate_rate"]})
    if out["memorization_rate"] and out["memorization_rate"] > HIGH_MEMORIZATION:
        found.append({"code": "high_memorization", "value": out["memorization_rate"]})
    if out["source_self_duplicate_rate"] and out["source_self_duplicate_rate"] > LOW_CARDINALITY:
        found.append({"code": "low_feature_cardinality", "value": out["source_self_duplicate_rate"]})
    sizes = {"source": min(sample, source.count()), "synthetic": min(sample, synthetic.count())}
    return out | {"sample_n": sizes, "findings": found}
