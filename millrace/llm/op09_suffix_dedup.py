"""Suffix-array dedup of 400-byte strings, whole texts as UTF-8 bytes.

Windows of 400 bytes are cut into super-k-mers (see ``superkmers``), so equal
windows meet in one bucket at the same distance from their minimiser. In a
bucket, all windows of a string that occurs twice are repeated. Strings that
share a minimiser but differ are cut into blocks of eight bytes in step with
the minimiser and their suffixes are sorted by Lyndon groups
(``suffixes``). Neighbours' common prefixes, counted in bytes, part the order
into classes of suffixes that agree long enough; a window is repeated if its
class, with the up to seven bytes before the block, has another occurrence.

Defined results: null and short texts lose nothing; a repetition within one
document counts; repeated rows repeat each other's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches
from .suffixes import suffix_order
from .superkmers import Bucket, cut_bytes, marked_runs, merged, spans, with_spans
from .textvec import mix, slices

LENGTH = 400
GRAM = 16
BLOCK = 8
#: Bytes of strings sorted together; strings with one minimiser are never parted.
TOGETHER = 1 << 19


def _common(x: np.ndarray, y: np.ndarray, value: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at blocks x and y have in common, up to ``most``."""
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    step = 0
    while len(live):
        a, b = x[live] + step, y[live] + step
        differ = value[a] ^ value[b]
        same = np.full(len(live), BLOCK)
        some = differ != 0
        # Equal leading bytes: the highest set bit lies in the first byte that differs.
        high = differ[some]
        lead = np.zeros(len(high), np.int64)
        for k in range(1, BLOCK):
            lead += high < (np.uint64(1) << np.uint64(64 - 8 * k))
        same[some] = lead
        same = np.minimum(same, np.minimum(size[a], size[b]))
        out[live] += same
        step += 1
        live = live[(same == BLOCK) & (out[live] < most)]
    return out


def repeated_windows(data: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """For all windows of all strings, string by string: whether it occurs again."""
    phase = anchor % BLOCK
    count = -(-(stop - start - phase) // BLOCK) + 1  # and an empty block at each end
    owner = np.repeat(np.arange(len(start)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = start[owner] + phase[owner] + BLOCK * number
    size = np.clip(stop[owner] - at, 0, BLOCK)
    bytes_ = np.zeros((len(at), BLOCK), np.uint8)
    for k in range(BLOCK):
        inside = size > k
        bytes_[inside, k] = data[at[inside] + k]
    value = bytes_.view(">u8").ravel().astype(np.uint64)
    by_value = np.lexsort((size, value))
    step = (np.diff(value[by_value]) != 0) | (np.diff(size[by_value]) != 0)
    symbol = np.empty(len(at), np.int64)
    symbol[by_value] = np.concatenate(([0], np.cumsum(step))) + 2
    total = np.cumsum(stop - start - length + 1)
    first = total - (stop - start - length + 1)
    out = np.zeros(total[-1], bool)
    # A window holds so many whole blocks. With a block that occurs once it can't
    # occur again, so only long runs of other blocks are sorted, each with the
    # block after it, which ends what its suffixes share.
    least = (length - BLOCK + 1) // BLOCK
    again = (size == BLOCK) & (np.bincount(symbol)[symbol] > 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))  # the empty block at each end parts strings
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    if not len(runs):
        return out
    amount = runs[:, 1] - runs[:, 0] + 2  # and the block after, and a separator
    block = np.repeat(runs[:, 0] - (np.cumsum(amount) - amount), amount) + np.arange(amount.sum())
    parting = np.cumsum(amount) - 1
    text = symbol[np.minimum(block, len(symbol) - 1)]
    text[size[np.minimum(block, len(symbol) - 1)] == 0] = 1
    text[parting] = 1
    order = suffix_order(np.append(text, 0))[1:]
    order = order[text[order] > 1]
    order = block[order]
    shared = _common(order[:-1], order[1:], value, size, length)
    offset = at - start[owner]
    before = np.zeros(len(order), np.uint64)
    for t in range(BLOCK):
        if t:
            there = offset[order] >= t
            before[there] |= data[at[order[there]] - t].astype(np.uint64) << np.uint64(8 * (t - 1))
        kind = np.concatenate(([0], np.cumsum(shared < length - t)))
        begin = offset[order] - t
        mine = np.flatnonzero((begin >= 0) & (begin + length <= (stop - start)[owner[order]]))
        if not len(mine):
            continue
        by_key = mine[np.lexsort((before[mine], kind[mine]))]
        new = np.ones(len(by_key), bool)
        new[1:] = (np.diff(kind[by_key]) != 0) | (np.diff(before[by_key]) != 0)
        edge = np.flatnonzero(new)
        times = np.add.reduceat(weight[owner[order[by_key]]], edge)
        twice = by_key[np.repeat(times >= 2, np.diff(np.append(edge, len(by_key))))]
        out[first[owner[order[twice]]] + begin[twice]] = True
    return out


def _judge(length: int, gram: int):
    def run(bucket: Bucket) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(bucket.data, np.uint8)
        weight = bucket.weight
        windows = bucket.stop - bucket.start - length + 1
        offset = np.concatenate(([0], np.cumsum(windows)))
        flags = np.repeat(weight >= 2, windows)
        # Strings by minimiser; a hash that two minimisers share only sorts more together.
        gram_at = bucket.start + bucket.anchor
        gram_hash = np.zeros(len(gram_at), np.uint64)
        for k in range(gram):
            gram_hash = mix(gram_hash * np.uint64(257) + data[gram_at + k])
        order = np.argsort(gram_hash, kind="stable")
        edge = np.flatnonzero(np.diff(gram_hash[order], prepend=~gram_hash[order[:1]]))
        sizes = np.diff(np.append(edge, len(order)))
        batch: list[np.ndarray] = []
        held = 0
        for a, n in zip(edge[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            batch.append(order[a : a + n])
            held += int((bucket.stop - bucket.start)[batch[-1]].sum())
            if held >= TOGETHER:
                _mark(flags, offset, data, bucket, np.concatenate(batch), weight, length)
                batch, held = [], 0
        if batch:
            _mark(flags, offset, data, bucket, np.concatenate(batch), weight, length)
        return marked_runs(flags, offset)

    return run


def _mark(flags: np.ndarray, offset: np.ndarray, data: np.ndarray, bucket: Bucket, strings: np.ndarray, weight: np.ndarray, length: int) -> None:
    found = repeated_windows(data, bucket.start[strings], bucket.stop[strings], bucket.anchor[strings], weight[strings], length)
    counts = np.diff(offset)[strings]
    to = np.repeat(offset[strings] - (np.cumsum(counts) - counts), counts) + np.arange(len(found))
    flags[to] |= found


def repeated(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte spans (_doc, _key, spans) that occur again somewhere."""
    small_batches(spark)
    return spans(spark, docs, cut_bytes, length, gram, _judge(length, gram))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for at, data, ends in slices(batch.column("_text")):
            raw = data.tobytes()
            for row in range(len(ends) - 1):
                text = raw[ends[row] : ends[row + 1]]
                cut = merged(batch.column("_spans"), at + row)
                sha, done = hashlib.sha256(), 0
                for lo, hi in cut:
                    sha.update(text[done:lo])
                    done = hi
                sha.update(text[done:])
                n_bytes.append(len(text))
                n_removed.append(sum(hi - lo for lo, hi in cut))
                n_spans.append(len(cut))
                digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_spans(docs, repeated(spark, docs), ["doc_id"]).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
