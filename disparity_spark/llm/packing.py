"""Packing documents into token windows by best-fit decreasing.

Every document is tokenized once, where it is read, and ends with one end token. An overlong document is first cut
into full windows; what is left of each document is packed by best fit, longest first: a segment tree over remaining
capacities finds the tightest open window. Ids never move: only pieces (document, start, length, checksum) are
shuffled, dealt by a hash to groups of about `group_docs` documents that are packed independently, so a group fits in
a task at any corpus size.

Edge cases: a null or empty text is its end token alone; repeated rows are packed once each; rows of a null or repeated
doc_id are dealt by their ids' checksum too; an empty table gives no pieces; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import CachedEncoder, vocabulary_path

WINDOW = 2048
END = 1
#: Documents to a packing group, on average.
GROUP_DOCS = 4096


class CapacityTree:
    """A segment tree over 0..window: how many open windows have each remaining capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that an open window has."""
        i, count = need + self.leaves, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def take(self, capacity: int) -> int:
        i = capacity + self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of indexes into lengths (each 1..window); ties go to the earlier index."""
    tree, windows = CapacityTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            windows.append([i])
            which, capacity = len(windows) - 1, window
        else:
            which = tree.take(capacity)
            windows[which].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], which)
    return windows


def pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows first, then what is left."""
    paths = tokenizer or vocabulary_path("byte_bpe_50k.json"), ranks or vocabulary_path("byte_bpe_50k.tiktoken")
    end = np.array([END], "<u4").tobytes()

    def batches(it):
        import pyarrow as pa

        common.lean()
        encode = CachedEncoder(*paths)
        for batch in common.sliced(it):
            ids, starts, lengths, sums, totals = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = memoryview(encode(text or "") + end)
                for at in range(0, len(raw), 4 * window):
                    part = raw[at : at + 4 * window]
                    ids.append(doc_id), starts.append(at // 4), lengths.append(len(part) // 4), sums.append(zlib.crc32(part)), totals.append(len(raw) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, lengths, sums, totals)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))

    def packed(key, rows):
        rows = rows.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths, n = rows["length"].tolist(), len(rows)
        sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for s, members in enumerate(best_fit_decreasing(lengths, window)):
            at = 0
            for i in members:
                sequence[i], offset[i] = s, at
                at += lengths[i]
        rows["sequence_id"], rows["offset"] = sequence + (int(key[0]) << 32), offset
        return rows.drop(columns="group")

    dealt = pieces(docs, tokenizer, ranks, window).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents"))
