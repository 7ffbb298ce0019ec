"""Vectorised words and hashes over Arrow string columns.

Text is handled as UTF-8 bytes in slices of bounded size, so memory does not
follow the batch. Word separators are single ASCII bytes, which never occur
inside a multi-byte character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_MASK = (1 << 64) - 1
_ROOT = 0x9E3779B97F4A7C15 | 1
_UNROOT = pow(_ROOT, -1, 1 << 64)

#: Bytes 0x09-0x0D and 0x20 part words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(root: int, n: int) -> np.ndarray:
    have = _powers.get(root)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        steps = np.full(size, root, dtype=np.uint64)
        steps[0] = 1
        have = _powers[root] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (new array)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE):
    """Yield (first row, bytes, boundaries): rows whose texts together stay
    under ``limit`` bytes, or one longer text. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1)
        yield row, data[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def words(data: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (plus one) its first word."""
    apart = blank[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    inside = ~apart
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = apart
    before |= edge
    starts = np.flatnonzero(inside & before[:-1])
    after = np.ones(len(data) + 1, dtype=bool)
    after[:-1] = apart
    after |= edge
    stops = np.flatnonzero(inside & after[1:]) + 1
    return starts, stops, np.searchsorted(starts, ends)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums that ``ranges`` turns into hashes of byte ranges."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_ROOT, len(data)), out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes anywhere."""
    raw = (prefix[stops] - prefix[starts]) * _power(_UNROOT, len(prefix))[starts]
    return mix(raw ^ ((stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(((2 * j + 1) * 0xC2B2AE3D27D4EB4F) & _MASK | 1)
    return mix(total)
