"""Texts of a partition in segments of bounded size, and hashes over them as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import common

#: Bytes of text that are worked on at a time, and bytes after which a segment's findings are sent on.
STEP, SEGMENT = 2 << 20, 32 << 20

_random = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit number for each byte value, and the base of the polynomial hashes.
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


class Powers:
    """Tables of powers of BASE and its inverse, grown as needed."""

    def __init__(self, least: int = STEP):
        self.least, self.up, self.down = least, *[np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> Powers:
        if len(self.up) <= n:
            size = max(n + 1, self.least + 1)
            for name, base in (("up", BASE), ("down", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end] that don't depend on where a range stands."""
        self.upto(len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return common.mixed((sums[end] - sums[start]) * self.down[start]) ^ common.mixed((end - start).astype(np.uint64))


def steps(batches, limit: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, bytes, offsets) of whole documents, about `limit` bytes at a time, from Arrow batches (doc_id, text)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = common.utf8_batch(batch.column(1))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield ids[at:to], raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def gathered(items, size, limit: int = SEGMENT) -> Iterator[list]:
    """Lists of consecutive items whose sizes come to `limit`, and the rest."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def runs_to_slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of the runs of a sorted array."""
    starts = common.sorted_runs(keys)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
        yield int(keys[a]), a, b
