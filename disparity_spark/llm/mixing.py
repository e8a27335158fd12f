"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source is a queue whose documents wait in a seeded shuffled order, served up to `epochs` times over. A copy's
virtual finish time is the words of its source up to and with it, divided by the source's target. The clock at which
all sources together have served the budget is 1, because the targets sum to the budget; copies are range-sorted by
virtual finish time and truncated there, so the copy in service at that moment is cut and every source ends at its
target to the word.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never
taken; an empty table gives an empty result; repeated rows are separate documents; rows of a null doc_id are shuffled by
a hash of their text; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source -> source_id, source_size, target.

    Weights repeat over the sources in code-point order. In ascending order of cap / weight a source is capped exactly
    while its cap is below its share of what the capped ones before it leave; the first share that holds is the level.
    One row per source goes through the windows, after partial sums by source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ordered = ordered.withColumn("weight", F.element_at(table, (F.col("source_id") % len(weights) + 1).cast("int")))
    ordered = ordered.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    shared = ordered.withColumn("share", level).withColumn("capped", F.col("cap") < F.col("weight") * F.col("share"))
    found = F.max(F.when(~F.col("capped"), F.col("share"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * found)
    return shared.select("source", "source_id", "source_size", F.least(target, F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, text_key (a hash), source, size, source_size, target, taken, n_copies, virtual_finish; in order of virtual finish time.

    taken: words served before the clock stops, over all copies. n_copies: whole copies, the cut one rounded.
    virtual_finish: of the first copy. Prefix sums run over (source, hash bucket) groups, so no source meets in a task.
    """
    digits = 2 if docs.count() <= 2_000_000 else 3
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))))
    sizes = common.staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("text_key")), "mix-sizes")
    targets = common.staged(source_targets(sizes, weights, epochs), "mix-targets")
    keyed = common.join_small(sizes.withColumnRenamed("source", "own"), targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    sums = keyed.groupBy("source_id", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_id", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("served", F.sum("size").over(inside)).join(offsets, ["source_id", "bucket"])
    finish = F.col("offset") + F.col("served")
    stop = F.floor(F.col("target") + F.lit(1e-6))
    copies = [F.greatest(F.lit(0), F.least(F.col("size"), stop - (F.lit(e) * F.col("source_size") + finish - F.col("size")))) for e in range(epochs)]
    taken = sum(copies[1:], copies[0]).cast("long")
    out = placed.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"), F.try_divide(finish.cast("double"), F.col("target")).alias("virtual_finish"), "key")
    out = out.withColumn("n_copies", F.when(F.col("size") > 0, F.round(F.col("taken") / F.nullif(F.col("size"), F.lit(0)))).otherwise(0).cast("int"))
    return out.orderBy("virtual_finish", "key", "doc_id").drop("key")


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a document comes as many times as it has whole copies, with its own columns.

    Rows are told apart by doc_id, source and text, so rows of a null or repeated id keep their own numbers. Rows that
    are equal in all three come as often as they are taken together, with the columns of one of them.
    """
    rows = common.staged(mix(docs, **options).groupBy("doc_id", "source", "text_key").agg(F.sum("n_copies").cast("int").alias("n"), F.count("*").alias("rows")), "mix-rows")
    counts = rows.filter("n > 0").select(F.struct("doc_id", "source", "text_key").alias("which"), "n")
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key")).alias("which"))
    repeated = rows.filter("rows > 1 and n > 0").select(F.struct("doc_id", "source", "text_key").alias("which"))
    if not repeated.isEmpty():
        same = F.col("which").eqNullSafe(F.col("again"))
        again = repeated.withColumnRenamed("which", "again")
        once = common.join_small(held, again, same, "left_semi").dropDuplicates(["which"])
        held = common.join_small(held, again, same, "left_anti").unionByName(once)
    joined = common.join_small(held, counts.withColumnRenamed("which", "taken"), F.col("which").eqNullSafe(F.col("taken")), most=common.BROADCAST_IDS // 2)  # some 30 bytes a row
    return joined.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def query(spark, sf_dir):
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s0),
s2 AS (SELECT *, CAST(CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2),
s4 AS (SELECT *, max(CASE WHEN cap >= w * share THEN share END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, least(cap, CASE WHEN cap < w * share THEN cap ELSE w * level END) AS target FROM s4),
p AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, floor(s5.target + 1e-6) AS stop,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS a
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, stop - a)) + greatest(0, least(size, stop - source_size - a)) + greatest(0, least(size, stop - 2 * source_size - a)) AS BIGINT) AS taken
FROM p
"""
