"""Substring dedup over windows of 50 words, partitioned by super-k-mers.

Each document's windows are cut into super-k-mers (see ``superkmers``). In a
bucket all windows are hashed and sorted, equal ones form a run, and the run's
smallest doc_id keeps its words; every other document loses the words that the
window covers. Windows are judged on the input.

Defined results: null or short texts lose nothing; a window repeated only
within one document (or among rows of one doc_id) stays; a null doc_id counts
as the largest; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches
from .superkmers import Bucket, cut_words, marked_runs, merged, spans, with_spans
from .textvec import BLANK, SLICE, ranges, slices, sums, words

WINDOW = 50
GRAM = 6


def _window_hashes(bucket: Bucket, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, string by string, and where each string's begin."""
    raw = np.frombuffer(bucket.data, np.uint8)
    found, counts = [], []
    at, n = 0, len(bucket.start)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bucket.stop, bucket.start[at] + SLICE, side="right")))
        base = bucket.start[at]
        data = raw[base : bucket.stop[to - 1]]
        starts, stops, first = words(data, np.append(bucket.start[at:to], bucket.stop[to - 1]) - base)
        amount = np.diff(first) - window + 1
        row = np.repeat(first[:-1], amount)
        a = row + np.arange(len(row)) - np.repeat(np.cumsum(amount) - amount, amount)
        found.append(ranges(sums(data), starts[a], stops[a + window - 1]))
        counts.append(amount)
        at = to
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _judge(window: int):
    def run(bucket: Bucket) -> tuple[np.ndarray, ...]:
        hashes, offset = _window_hashes(bucket, window)
        count = np.diff(offset)
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
        least = np.minimum.reduceat(np.repeat(bucket.low, count)[order], new)
        owner = np.empty(len(hashes), np.int64)
        owner[order] = np.repeat(least, np.diff(np.append(new, len(order))))
        return marked_runs(owner < np.repeat(bucket.high, count), offset, owner)

    return run


def repeated(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Word spans (_doc, _key, spans) that an earlier document holds."""
    small_batches(spark)
    return spans(spark, docs, cut_words, window, gram, _judge(window))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digest = [], [], []
        for at, data, ends in slices(batch.column("_text")):
            starts, stops, first = words(data, ends)
            apart = BLANK[data]
            keep = ~apart
            keep[1:] |= ~apart[:-1]
            raw = np.where(apart, np.uint8(32), data)
            for row in range(len(ends) - 1):
                a, b = int(first[row]), int(first[row + 1])
                cut = merged(batch.column("_spans"), at + row)
                pieces, done = [], a
                for lo, hi in [*cut, (b - a, b - a)]:
                    if a + lo > done:
                        low, high = starts[done], stops[a + lo - 1]
                        pieces.append(raw[low:high][keep[low:high]].tobytes())
                    done = a + hi
                n_words.append(b - a)
                n_removed.append(sum(hi - lo for lo, hi in cut))
                digest.append(hashlib.sha256(b" ".join(pieces)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = with_spans(docs, repeated(spark, docs), ["doc_id"])
    return found.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
