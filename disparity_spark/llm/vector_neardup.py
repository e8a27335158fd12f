"""Embedding near-duplicates by an epsilon grid order join.

Equal vectors are first collapsed to one with a count. On unit vectors, cosine >= t means a distance of at most
eps = sqrt(2 - 2t). Vectors are rotated onto principal axes (fitted on a bounded sample; any rotation keeps distances,
so results don't depend on it), sorted by their eps-grid cells on the leading axes, and cut into blocks of the
sequence. The sequence joins itself recursively: two intervals whose bounding boxes lie farther apart than eps are
skipped, others are halved down to pairs of blocks, and within a task on to pairs of leaves, each one matrix product;
cosines near the limit are taken again in double precision from the vectors as given. Links are counted, not listed: a
pair of blocks returns a count and a local component per vector, and connected components of those forests follow.

How much is skipped depends on the data: where vectors spread evenly over many axes, no two boxes are distant and all
pairs of blocks are compared. Blocks are large so that a vector then moves once for every `block` others.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are
their own component; vectors of different lengths don't link; equal vectors link with each other; an empty table gives
no rows; repeated rows are separate vectors; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

LIMIT = 0.95
#: Vectors in a block and in a leaf, leading axes in the grid order, axes in a bounding box, vectors that fit the rotation.
BLOCK, LEAF, AXES, BOX, SAMPLE = 8192, 512, 6, 24, 4096


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, the widest first."""
    centred = sample - sample.mean(0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1]


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def close_pairs(low: np.ndarray, high: np.ndarray, eps: float, start: tuple | None = None, boxes: dict | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) whose boxes are within eps, by recursion over intervals of the sequence.

    From two intervals `start` = (a, b, c, d), or (i <= j) from the whole sequence with itself; `boxes` keeps the boxes
    of intervals for further calls.
    """
    if not len(low):
        return []
    boxes = {} if boxes is None else boxes

    def box(a, b):
        if (a, b) not in boxes:
            boxes[a, b] = low[a:b].min(0), high[a:b].max(0)
        return boxes[a, b]

    out, todo = [], [start or (0, len(low), 0, len(low))]
    while todo:
        a, b, c, d = todo.pop()
        (l1, h1), (l2, h2) = box(a, b), box(c, d)
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a == 1 and d - c == 1:
            out.append((a, c))
            continue
        m, k = (a + b) // 2, (c + d) // 2
        if (a, b) == (c, d):
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            todo += [(a, b, c, k), (a, b, k, d)]
    return sorted(out)


def links_between(x: np.ndarray, y: np.ndarray, limit: float, same: bool) -> np.ndarray:
    """Whether each row of x has cosine >= limit with each row of y."""
    found = (units(x).astype(np.float32) @ units(y).astype(np.float32).T) - np.float32(limit)
    linked = found >= 0
    i, j = np.nonzero(np.abs(found) < 1e-4)
    for at in range(0, len(i), 65536):
        p, q = x[i[at : at + 65536]], y[j[at : at + 65536]]
        p, q = p / np.abs(p).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
        linked[i[at : at + 65536], j[at : at + 65536]] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1))) >= limit
    if same:
        np.fill_diagonal(linked, False)
    return linked


def joined_blocks(ids, counts, x, ids2, counts2, y, limit, same):
    """(id, linked vectors, least id of its local component) of the vectors of two blocks that have links."""
    linked = links_between(x, y, limit, same)
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return [np.zeros(0, np.int64)] * 3
    linked = linked[np.ix_(rows, columns)]
    ids, ids2 = ids[rows], ids2[columns]
    top = np.iinfo(np.int64).max
    left, right = ids.copy(), ids2.copy()
    while True:
        before = left.sum(dtype=np.float64), right.sum(dtype=np.float64)
        right = np.minimum(right, np.where(linked, left[:, None], top).min(0))
        left = np.minimum(left, np.where(linked, right[None, :], top).min(1))
        if same:
            left = right = np.minimum(left, right)
        if before == (left.sum(dtype=np.float64), right.sum(dtype=np.float64)):
            break
    one = ids, linked @ counts2[columns], left
    return one if same else [np.concatenate(z) for z in zip(one, (ids2, counts[rows] @ linked, right), strict=True)]


def joined_sequences(ids, counts, x, ids2, counts2, y, limit, same, eps, axes):
    """As joined_blocks, by recursion over leaves of both blocks; a vector is told once."""
    leaf = range(0, len(x), LEAF), range(0, len(y), LEAF)
    boxes = []
    for matrix, starts in ((x, leaf[0]), (y, leaf[1])):
        places = (units(matrix) @ axes)[:, :BOX]
        boxes.append([f(places[k : k + LEAF], 0) for f in (np.min, np.max) for k in starts])
    low, high = (np.array([b for of in boxes for b in of[k * len(of) // 2 : (k + 1) * len(of) // 2]]) for k in (0, 1))
    n, found = len(leaf[0]), []
    for i, j in close_pairs(low[:n], high[:n], eps) if same else close_pairs(low, high, eps, (0, n, n, len(low))):
        a, b = i * LEAF, (j if same else j - n) * LEAF
        p, q = slice(a, a + LEAF), slice(b, b + LEAF)
        found.append(joined_blocks(ids[p], counts[p], x[p], ids2[q], counts2[q], y[q], limit, same and i == j))
    told, links, root = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    names, at = np.unique(np.concatenate([told, root]), return_inverse=True)
    own, least = at[: len(told)], at[len(told) :]
    part = np.arange(len(names))
    while True:
        before = part.copy()
        m = np.minimum(part[own], part[least])
        np.minimum.at(part, own, m)
        np.minimum.at(part, least, m)
        part = part[part]
        if (part == before).all():
            break
    linked = np.unique(own)
    return names[linked], np.bincount(own, links, minlength=len(names)).astype(np.int64)[linked], names[part[linked]]


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, x).alias("v"))
    classes = common.staged(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    fitted: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]:
        fitted.setdefault(len(r), []).append(np.asarray(r, float))
    axes = {n: rotation(units(np.array(s))) for n, s in fitted.items()}
    eps = float(np.sqrt(2 - 2 * limit)) * (1 + 1e-9) + 1e-9

    def rotated(matrix):
        n = matrix.shape[1]
        return units(matrix) @ axes.get(n, np.eye(n))

    def celled(it):
        for pdf in it:
            lengths = pdf["v"].map(len).to_numpy()
            cells = np.empty(len(pdf), object)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                grid = np.floor(rotated(np.stack(pdf["v"].iloc[at].to_numpy()).astype(float))[:, :AXES] / eps).astype(int)
                for i, g in zip(at, grid, strict=True):
                    cells[i] = [int(n), *g.tolist()]
            yield pdf.assign(cells=cells)

    def blocked(it):
        import pandas as pd
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []

        def emit(pdf):
            matrix = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            box = rotated(matrix)[:, :BOX]
            pad = lambda b: [float(matrix.shape[1]) * 1e6, *b.tolist(), *[0.0] * (BOX - len(b))]  # noqa: E731  lengths lie far apart
            return {"block": part * (1 << 32) + made, "low": pad(box.min(0)), "high": pad(box.max(0)), "width": matrix.shape[1], "ids": pdf["id"].to_numpy(np.int64).tobytes(), "counts": pdf["copies"].to_numpy(np.int64).tobytes(), "data": matrix.tobytes()}

        def ready(last):
            nonlocal held, made
            rows = pd.concat(held) if held else None
            out, held = [], []
            while rows is not None and len(rows) and (last or len(rows) >= block):
                width = len(rows["v"].iloc[0])
                head = rows.iloc[:block]
                same = (head["v"].map(len) == width).to_numpy()
                head = head.iloc[: len(head) if same.all() else int(np.argmin(same))]
                out.append(emit(head))
                made, rows = made + 1, rows.iloc[len(head) :]
            held = [rows] if rows is not None and len(rows) else []
            return out

        for pdf in it:
            held.append(pdf)
            for b in ready(False):
                yield pd.DataFrame([b])
        for b in ready(True):
            yield pd.DataFrame([b])

    n = classes.count()
    parts = max(1, -(-n // (2 * block)))
    ordered = classes.mapInPandas(celled, "v array<double>, id long, copies long, cells array<int>")
    ordered = ordered.repartitionByRange(parts, "cells", "id").sortWithinPartitions("cells", "id")
    blocks = common.staged(ordered.mapInPandas(blocked, "block long, low array<double>, high array<double>, width int, ids binary, counts binary, data binary"), "vector-blocks")
    # Bounding boxes only: some 400 bytes for every `block` vectors.
    boxes = blocks.select("block", "low", "high").orderBy("block").toPandas()
    sent = spark.sparkContext.broadcast((boxes["block"].to_numpy(np.int64), np.array(boxes["low"].tolist()), np.array(boxes["high"].tolist())))

    def near(it):
        import pyarrow as pa

        names, low, high = sent.value
        known: dict = {}
        for batch in it:
            for a in batch.column(0).to_pylist():
                pairs = np.array(close_pairs(low, high, eps, (a, a + 1, a, len(low)), known), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(names[pairs[:, k]]) for k in (0, 1)], names=["a", "b"])

    pairs = common.staged(spark.range(0, len(boxes), 1, max(1, min(len(boxes), 256))).mapInArrow(near, "a long, b long"), "vector-pairs")
    side = lambda s: blocks.select(F.col("block").alias(s), "width", *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "data")])
    tiles = pairs.repartition(max(1, min(pairs.count(), 4096)), "a", "b").join(side("a"), "a").join(side("b").drop("width"), "b")

    def join(it):
        import pyarrow as pa

        for batch in it:
            for r in batch.to_pylist():
                sides = [(np.frombuffer(r[f"ids_{s}"], np.int64), np.frombuffer(r[f"counts_{s}"], np.int64), np.frombuffer(r[f"data_{s}"], np.float64).reshape(-1, r["width"])) for s in "ab"]
                found = joined_sequences(*sides[0], *sides[1], limit, r["a"] == r["b"], eps, axes.get(r["width"], np.eye(r["width"])))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in found], names=["id", "links", "root"])

    found = common.staged(tiles.select("a", "b", "width", *[f"{c}_{s}" for s in "ab" for c in ("ids", "counts", "data")]).mapInArrow(join, "id long, links long, root long"), "vector-links")
    parts_of = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "id", "left").join(parts_of.withColumnRenamed("node", "id"), "id", "left").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark, sf_dir):
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM r WHERE r.a = e.vec_id) AS kept FROM e
"""
