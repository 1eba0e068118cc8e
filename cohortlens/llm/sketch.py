"""A count sketch of fixed size over 64-bit hashes, filled in tasks and merged in two levels.

It only steers (a token order, the splitting of hot keys): results do not depend on its values.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc

BITS = 22
BLOCK_BITS = 16
BLOCKS = 1 << (BITS - BLOCK_BITS)
ROWS = "block int, part int, counts binary"


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> tc.U(64 - BITS)).astype(np.int64)


class Counter:
    """The counts of one task."""

    def __init__(self):
        self.counts = np.zeros(1 << BITS, np.uint16)

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes):
            at, times = np.unique(cells(hashes), return_counts=True)
            self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + times, 65535)

    def rows(self) -> list[tuple[int, int, bytes]]:
        """(block, part, compressed counts) of the blocks that are not empty."""
        part = TaskContext.get().partitionId()
        return [(b, part, zlib.compress(x.tobytes(), 1)) for b, x in enumerate(self.counts.reshape(BLOCKS, -1)) if x.any()]

    def batch(self) -> pa.RecordBatch:
        rows = self.rows()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                           pa.array([r[2] for r in rows], pa.binary())], names=["block", "part", "counts"])


def _add(rows: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for z in rows["counts"].to_pylist():
        raw = zlib.decompress(z)
        total += np.frombuffer(raw, np.uint16 if len(raw) == 2 << BLOCK_BITS else np.int64)
    return pa.table({"block": rows["block"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def merged(rows: DataFrame) -> np.ndarray:
    """The sums as one byte a cell, 8 steps an octave: 4 MB whatever the input."""
    some = rows.select("block", F.floor(F.col("part") / 64).alias("part"), "counts")
    once = some.groupBy("block", "part").applyInArrow(_add, "block int, counts binary")
    done = once.groupBy("block").applyInArrow(_add, "block int, counts binary")
    out = np.zeros((BLOCKS, 1 << BLOCK_BITS), np.uint8)
    for r in done.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        out[r["block"]] = np.minimum(255, step(np.maximum(counts, 1)))
    return out.ravel()


def step(count):
    """The byte that ``merged`` has for a count."""
    return 8 * np.log2(count)
