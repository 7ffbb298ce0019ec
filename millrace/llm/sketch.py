"""Counts over all rows in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BITS, PARTS = 20, 128


def _count(cells_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for cells in cells_of(batch):
                counts += np.bincount(cells, minlength=len(counts))
        packer = zstandard.ZstdCompressor(level=1)
        parts = {i: packer.compress(p.tobytes()) for i, p in enumerate(np.split(counts, PARTS)) if p.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], names=["part", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.as_py()), np.int64)
            total[part] = total[part] + got if part in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.ZstdCompressor().compress(t.tobytes()) for t in total.values()], pa.binary())], names=["part", "counts"])


def counted(df: DataFrame, cells_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Sums over all rows; ``cells_of`` gives cell numbers below 2**BITS."""
    schema = "part int, counts binary"
    parts = df.mapInArrow(_count(cells_of), schema).repartition(PARTS, "part").mapInArrow(_add, schema)
    out = np.zeros((PARTS, (1 << BITS) // PARTS), np.int64)
    for row in parts.collect():  # at most PARTS rows, 8 MB in all
        out[row.part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.counts)), np.int64)
    return out.ravel()


def frequent(counts: np.ndarray) -> np.ndarray:
    """Cells that stand out of what evenly spread keys would give."""
    mean = counts.mean()
    return counts > mean + 8 * np.sqrt(mean) + 64
