"""Bootstrap intervals of disparity metrics, from counts alone.

Resampling rows within a group of fixed size draws its four counts from a multinomial with the observed shares, so a
replicate costs one draw per group instead of one per row. The generator of a cell is keyed by (seed, replicate,
group): results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .disparity import COUNTS, METRICS, group_rates, metric_columns

LEVELS = (0.025, 0.975)


def replicates(counts: DataFrame, samples: int, seed: int) -> DataFrame:
    """replicate, group, n, tp, fp, fn, tn: `samples` multinomial draws of every group."""
    names = list(COUNTS)

    def draw(it):
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in it:
            cells = pdf[names].to_numpy()
            drawn = [np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(f"{seed}|{k}|{g}".encode()).digest()[:16], "big"))).multinomial(c.sum(), c / c.sum()) for k, g, c in zip(pdf["replicate"], pdf["group"], cells, strict=True)]
            out = pdf[["replicate", "group", "n"]].copy()
            out[names] = np.array(drawn).reshape(len(out), 4) if drawn else pd.DataFrame(columns=names)
            yield out

    cells = counts.filter("n > 0").select("group", "n", *names).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return cells.mapInPandas(draw, "replicate int, group string, n long, tp long, fp long, fn long, tn long")


def hashed_replicates(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """The same by resampling rows, with md5 as the generator, which SQL engines share: rows (group, i, n, truth, pred), i from 0.

    Costs samples times the rows; meant for checks and small tables.
    """
    draws = rows.select("group", "i", "n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), "group", F.col("i").cast("string")))
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = draws.select("replicate", "group", "n", F.floor(unit * F.col("n")).cast("long").alias("i"))
    cell = lambda t, p, k: F.count_if((F.col("truth") == t) & (F.col("pred") == p)).alias(k)
    return drawn.join(rows.select("group", "i", "truth", "pred"), ["group", "i"]).groupBy("replicate", "group").agg(F.first("n").alias("n"), cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))


def intervals(drawn: DataFrame, samples: int, outcome_only: bool = False) -> DataFrame:
    """metric, lower, upper: the 2.5 and 97.5 percentiles of metrics that are defined in every replicate, and of each selection rate."""
    rates = group_rates(drawn, outcome_only)
    per = rates.groupBy("replicate").agg(*[v.alias(k) for k, v in metric_columns().items()])
    long = per.unpivot(["replicate"], list(METRICS), "metric", "value").select("metric", "value")
    long = long.unionByName(rates.select(F.concat(F.lit("selection_rate:"), "group").alias("metric"), F.col("selection_rate").alias("value")))
    ends = F.percentile("value", F.array(*map(F.lit, LEVELS)))
    kept = long.groupBy("metric").agg(F.count("value").alias("n"), ends.alias("ends")).filter(F.col("n") == samples)
    return kept.select("metric", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"))


def bootstrap_intervals(counts: DataFrame, samples: int, seed: int = 42, outcome_only: bool = False) -> DataFrame:
    return intervals(replicates(counts, samples, seed), samples, outcome_only)
