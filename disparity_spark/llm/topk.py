"""Exact top-k search by tiled matrix products.

Candidates are read as shards where they lie. Queries are taken in blocks of bounded size; for a block every task
multiplies its shards with the block (a tile), selects the best k of each tile, and keeps a running list per query.
The lists of the tasks are merged as a tree: first by (query, a few merge slots), then by query. Scores are exact
integers: products run in float64 where 2^53 bounds them and in int64 beyond.

Edge cases: null vectors and those with null or non-finite components take no part, as queries or candidates; empty
vectors have score 0; vectors are compared with those of their own length only; equal scores go to the smaller vec_id;
a query is never its own candidate (rows of its vec_id are left out); an empty table gives no rows; repeated rows of a
vec_id are repeated candidates; further columns are ignored. Scores beyond 64 bits are not defined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 20
SCALE = 64
#: Bytes of the queries that are sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Candidates in a tile.
TILE = 4096
SLOTS = 16


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x), for whole finite vectors."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _by_length(ids, vectors):
    """(ids, matrix) per vector length, ordered by id."""
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        at = at[np.argsort(ids[at], kind="stable")]
        yield int(n), ids[at], np.array([vectors[i] for i in at], np.int64).reshape(len(at), n)


def best_of_tile(query_ids, queries, ids, matrix, k):
    """(row of the query, id, score) of the k best candidates of a tile that is ordered by id."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
    scores = (queries.astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64) if bound < 2**53 else queries @ matrix.T
    low = np.iinfo(np.int64).min
    lo, hi = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for r in np.flatnonzero(hi > lo):
        scores[r, lo[r] : hi[r]] = low
    n = len(ids)
    if n > k and bound < 2**62 / (2 * n):
        key = np.maximum(scores, -(2**62) // n) * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k] if bound < 2**62 else np.argsort(~scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(query_ids)), at.shape[1])
    at = at.ravel()
    found = scores[row, at] > low
    return row[found], ids[at[found]], scores[row[found], at[found]]


def _keep_best(rows, ids, scores, k):
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = common.sorted_runs(rows)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    keep = rank < k
    return rows[keep], ids[keep], scores[keep], rank[keep]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs as `quantized` gives them. One pass over the candidates per query block."""
    spark = candidates.sparkSession
    stats = queries.agg(F.count("*").alias("n"), F.sum(F.size("v") + 4).alias("numbers")).first()
    blocks = max(1, -(-8 * (stats.numbers or 0) // block_bytes))
    fixed = common.staged(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "topk-queries")
    schema, lists = "query_id long, vec_id long, score long, slot int", None
    for b in range(blocks):
        # A block is bounded by block_bytes, whatever the number of queries.
        block = fixed.filter(F.col("block") == b).select("vec_id", "v").toPandas()
        sent = spark.sparkContext.broadcast((block["vec_id"].to_numpy(np.int64), [np.asarray(v, np.int64) for v in block["v"]]))

        def tiles(it, sent=sent):
            import pyarrow as pa
            from pyspark import TaskContext

            query_ids, vectors = sent.value
            groups = {n: (i, m) for n, i, m in _by_length(query_ids, vectors)} if len(query_ids) else {}
            best: dict = {}
            for batch in it:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                rows = batch.column(1)
                values, ends = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, np.diff(rows.offsets.to_numpy())))
                for n, own, matrix in _by_length(ids, [values[ends[i] : ends[i + 1]] for i in range(len(ids))]):
                    if n not in groups:
                        continue
                    for at in range(0, len(own), TILE):
                        found = best_of_tile(*groups[n], own[at : at + TILE], matrix[at : at + TILE], k)
                        merged = [np.concatenate(x) for x in zip(best[n], found, strict=True)] if n in best else found
                        best[n] = _keep_best(*merged, k)[:3]
            slot = TaskContext.get().partitionId() % SLOTS
            for n, (rows, ids, scores) in best.items():
                for at in range(0, len(rows), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(groups[n][0][rows[part]]), pa.array(ids[part]), pa.array(scores[part]), pa.array(np.full(len(ids[part]), slot, np.int32))], names=["query_id", "vec_id", "score", "slot"])

        one = candidates.select("vec_id", "v").mapInArrow(tiles, schema)
        lists = one if lists is None else lists.unionByName(one)

    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k)
    for keys in (["query_id", "slot"], ["query_id"]):
        merged = lists.groupBy(*keys).agg(best.alias("best"))
        lists = merged.select(*keys, F.posexplode("best").alias("at", "x")).select(*keys, "at", (-F.col("x.less")).alias("score"), F.col("x.vec_id").alias("vec_id"))
    return lists.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    vectors = quantized(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
