"""Super-k-mers: consecutive windows that share a minimiser, packed as one string.

A window of fixed length (words or bytes) belongs to the smallest gram hash in
it, the leftmost of equal ones. Grams of a fixed share of the hash space come
first, and among them those that are not frequent in the corpus (by counts over
all rows in a table of fixed size): a window that a common passage fills only in
part then goes to the bucket of a gram of its own, not to the passage's. The
choice depends on the window's content and that table alone, so equal windows
meet in one bucket. Consecutive windows with the same
minimiser overlap and travel as one string; equal strings of one task travel
once, with how often and in which documents they stand. What a task sends to a
bucket is one compressed block, so a bucket is read back block by block and
holds distinct strings only.

Where strings stand (their places) goes another way: dealt out evenly whatever
the string, and joined with the verdicts on strings, one row each, at the end.
So a passage that a third of all documents share is one string in its bucket,
and its places meet in no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import lean, stored
from .textvec import BLANK, mix, ranges, runs, slices, sums, words

LAST = (1 << 63) - 1
#: Text bytes that a task gathers before it sends; packed bytes meant for one
#: bucket, and for one partition of buckets.
GATHER, BUCKET, PARTITION = 12 << 20, 8 << 20, 256 << 20
_LOW = np.uint64(0xFFFFFFFF)
#: One gram hash in so many is counted and preferred, for words and for bytes.
SHARE_WORDS, SHARE_BYTES = 4, 16


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    if len(keys) < width:
        return np.zeros(0, keys.dtype)
    have, span = keys, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    extra = width - span
    return np.minimum(have[:-extra], have[extra:]) if extra else have


@dataclass
class Cut:
    """Windows of one slice, run by run. Places count units (words or bytes) in a row's text."""

    data: np.ndarray
    row: np.ndarray
    place: np.ndarray  # first window of the run
    start: np.ndarray  # its bytes in data
    stop: np.ndarray
    anchor: np.ndarray  # offset of the minimiser from start, in bytes
    gram: np.ndarray  # the minimiser's hash
    hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - sketch.BITS)).astype(np.int64)


def _runs(grams: np.ndarray, first: np.ndarray, window: int, gram: int, share: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, minimiser) of each run of windows."""
    rank = np.full(len(grams), 2, np.uint64)
    counted = np.flatnonzero(grams & np.uint64(share - 1) == 0)
    rank[counted] = hot[_cells(grams[counted])]
    keys = (rank << np.uint64(62)) | ((grams >> np.uint64(34)) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    best = (sliding_min(keys, window - gram + 1) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + window <= first[1:][row])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (best[at[1:]] != best[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return row[at[begin]], at[begin], at[end], best[at[begin]]


def word_grams(data: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the word grams of a slice, without those across rows."""
    starts, stops, first = words(data, ends)
    grams = runs(ranges(sums(data), starts, stops), gram)
    last = np.repeat(first[1:], np.diff(first))[: len(grams)]
    return grams[np.arange(len(grams)) + gram <= last]


def byte_grams(data: np.ndarray, ends: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(max(len(data) - gram + 1, 0))
    last = np.repeat(ends[1:], np.diff(ends))[: len(at)]
    return ranges(sums(data), at, at + gram)[at + gram <= last]


def cut_words(data: np.ndarray, ends: np.ndarray, window: int, gram: int, hot: np.ndarray) -> Cut:
    """Runs of word windows; strings are words joined by one space."""
    apart = BLANK[data]
    starts, stops, first = words(data, ends)
    keep = ~apart
    keep[1:] |= ~apart[:-1]
    moved = np.concatenate(([0], np.cumsum(keep)))
    joined = np.where(apart, np.uint8(32), data)[keep]
    # Neighbouring rows may touch; no window crosses rows, so their words are never joined.
    starts, stops = moved[starts], moved[starts] + (stops - starts)
    prefix = sums(joined)
    grams = runs(ranges(prefix, starts, stops), gram)
    row, a, b, best = _runs(grams, first, window, gram, SHARE_WORDS, hot)
    low, high = starts[a], stops[b + window - 1] if len(b) else b
    return Cut(joined, row, a - first[row], low, high, starts[best] - low if len(a) else a, grams[best], ranges(prefix, low, high))


def cut_bytes(data: np.ndarray, ends: np.ndarray, window: int, gram: int, hot: np.ndarray) -> Cut:
    prefix = sums(data)
    n = len(data) - gram + 1
    at = np.arange(max(n, 0))
    grams = ranges(prefix, at, at + gram)
    row, a, b, best = _runs(grams, ends, window, gram, SHARE_BYTES, hot)
    return Cut(data, row, a - ends[row], a, b + window, best - a, grams[best], ranges(prefix, a, b + window))


_STRINGS = (("anchor", "<u4"), ("hash", "<u8"), ("weight", "<i8"), ("low", "<i8"), ("high", "<i8"))
_PLACES = (("bucket", "<i8"), ("hash", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("place", "<i8"))


def _packed(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _columns(raw: bytes, kinds: list[str], at: int, n: int) -> Iterator[np.ndarray]:
    for kind in kinds:
        column = np.frombuffer(raw, kind, n, at)
        at += column.nbytes
        yield column


@dataclass
class Bucket:
    """All strings of a bucket, each once: how often they stand in the corpus,
    and the least and the largest document that holds them."""

    data: bytes
    start: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    high: np.ndarray


def read_blocks(blocks: Iterator[bytes]) -> Bucket:
    text, lengths, seen = [], [], {}
    numbers, columns = [], []
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        size, *rest = _columns(raw, ["<u4"], 8, n), *_columns(raw, [k for _, k in _STRINGS], 8 + 4 * n, n)
        sizes = next(size).tolist()
        at = 8 + n * (4 + sum(int(k[2]) for _, k in _STRINGS))
        number = np.zeros(n, np.int64)
        for i, length in enumerate(sizes):
            one = raw[at : at + length]
            at += length
            number[i] = seen.setdefault(one, len(lengths))
            if number[i] == len(lengths):
                text.append(one)
                lengths.append(length)
        numbers.append(number)
        columns.append(rest)
    seen.clear()
    number = np.concatenate(numbers)
    anchor, hashes, weight, low, high = (np.concatenate(c) for c in zip(*columns, strict=True))
    k = len(lengths)
    one = np.zeros(k, np.int64)
    one[number[::-1]] = np.arange(len(number))[::-1]
    least, most = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
    np.minimum.at(least, number, low)
    np.maximum.at(most, number, high)
    stop = np.cumsum(np.array(lengths, dtype=np.int64))
    return Bucket(b"".join(text), stop - lengths, stop, anchor[one].astype(np.int64), hashes[one], np.bincount(number, weights=weight, minlength=k).astype(np.int64), least, most)


def _send(cuts: list[tuple[Cut, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, bytes]]:
    """cuts: each with document ids and text hashes of the slice's rows. Strings
    go to buckets, places to numbers from ``buckets`` on."""
    if not cuts:
        return
    source = np.repeat(np.arange(len(cuts)), [len(c.row) for c, _, _ in cuts])
    start, stop, anchor, place, gram, hashes = (np.concatenate([getattr(c, name) for c, _, _ in cuts]) for name in ("start", "stop", "anchor", "place", "gram", "hash"))
    doc = np.concatenate([d[c.row] for c, d, _ in cuts])
    key = np.concatenate([k[c.row] for c, _, k in cuts])
    if not len(source):
        return
    _, one, number = np.unique(hashes, return_index=True, return_inverse=True)
    goal = (mix(gram[one]) % np.uint64(buckets)).astype(np.int64)
    # A row that stands twice has its places twice; one of them is enough.
    fresh = np.unique(mix(hashes + mix(key.view(np.uint64) + mix(doc.view(np.uint64) + mix(place.view(np.uint64))))), return_index=True)[1]
    columns = (goal[number[fresh]], hashes[fresh], doc[fresh], key[fresh], place[fresh])
    yield buckets + int(mix(key[:1].view(np.uint64))[0] % np.uint64(buckets)), _packed([c.astype(k).tobytes() for c, (_, k) in zip(columns, _PLACES, strict=True)])
    low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    weight = np.bincount(number, minlength=len(one))
    by_goal = np.argsort(goal, kind="stable")
    edges = np.flatnonzero(np.diff(goal[by_goal], prepend=-1, append=buckets))
    raw = [c.data.tobytes() for c, _, _ in cuts]
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = by_goal[lo:hi]
        strings = one[mine]
        texts = [raw[s][a:b] for s, a, b in zip(source[strings].tolist(), start[strings].tolist(), stop[strings].tolist(), strict=True)]
        columns = (anchor[strings], hashes[strings], weight[mine], low[mine], high[mine])
        head = [np.array([len(texts)], "<i8").tobytes(), np.array([len(t) for t in texts], "<u4").tobytes()]
        yield int(goal[mine[0]]), _packed([*head, *(c.astype(k).tobytes() for c, (_, k) in zip(columns, _STRINGS, strict=True)), *texts])


def _sample(grams_of: Callable, gram: int, share: int):
    def cells(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, ends in slices(batch.column("_text")):
            grams = grams_of(data, ends, gram)
            yield _cells(grams[grams & np.uint64(share - 1) == 0])

    return cells


def _pack(cut: Callable, window: int, gram: int, buckets: int, packed: bytes):
    def batch_of(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)).astype(np.uint64)
        cuts, held = [], 0
        for batch in batches:
            doc, key = batch.column("_doc").to_numpy(), batch.column("_key").to_numpy()
            for first, data, ends in slices(batch.column("_text")):
                found = cut(data, ends, window, gram, hot)
                cuts.append((found, doc[first : first + len(ends) - 1], key[first : first + len(ends) - 1]))
                held += len(data)
                if held >= GATHER:
                    yield batch_of(list(_send(cuts, buckets)))
                    cuts, held = [], 0
        yield batch_of(list(_send(cuts, buckets)))

    return run


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("low", pa.int64())]))
_JUDGED = "bucket long, hash long, _doc long, _key long, place long, runs array<struct<first:long,stop:long,low:long>>"


def _verdicts(number: int, bucket: Bucket, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """found: string, first window, last window and, or None, the document from
    which on the windows stay; in order of string. A row for each string."""
    string, first, last, low = found
    has, count = np.unique(string, return_counts=True)
    lows = pa.nulls(len(first), pa.int64()) if low is None else pa.array(low)
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(last), lows], names=["first", "stop", "low"]))
    none = pa.nulls(len(has), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(has), number)), pa.array(bucket.hash[has].view(np.int64)), none, none, none, runs], names=["bucket", "hash", "_doc", "_key", "place", "runs"])


def _unpack(judge: Callable[[Bucket], tuple[np.ndarray, ...]], buckets: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                yield bucket, block.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, group in groupby(blocks(batches), key=lambda x: x[0]):
            if number < buckets:
                bucket = read_blocks(block for _, block in group)
                found = judge(bucket)
                if len(found[0]):
                    yield _verdicts(number, bucket, found)
                continue
            for _, block in group:
                raw = zstandard.ZstdDecompressor().decompress(block)
                n = len(raw) // 40
                columns = [pa.array(c.view("<i8")) for c in _columns(raw, [k for _, k in _PLACES], 0, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, _RUNS)], names=["bucket", "hash", "_doc", "_key", "place", "runs"])

    return run


def marked_runs(marked: np.ndarray, offset: np.ndarray, value: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of marked windows (of one value): string, first, last, value.
    String i has the windows from offset[i] on."""
    at = np.flatnonzero(marked)
    if not len(at):
        return at, at, at, value if value is None else value[at]
    string = np.searchsorted(offset, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(string) != 0)
    if value is not None:
        new[1:] |= np.diff(value[at]) != 0
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    string = string[begin]
    return string, at[begin] - offset[string], at[end] - offset[string], value if value is None else value[at[begin]]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """_doc (null as the largest, which _null tells apart), _key (a hash of the
    text) and _text; rows that agree in _doc and _key have the same text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.col("doc_id").isNull().alias("_null"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))


def spans(spark: SparkSession, docs: DataFrame, cut: Callable, window: int, gram: int, judge: Callable[[Bucket], tuple[np.ndarray, ...]]) -> DataFrame:
    """(_doc, _key, spans): units covered by the windows that ``judge`` marks,
    a row for each place. A window with a value stays in documents up to it."""
    source = keyed(docs).select("_doc", "_key", "_text")
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // PARTITION))
    buckets = max(partitions, -(-3 * size // BUCKET))
    of_words = cut is cut_words
    counts = sketch.counted(source.select("_text"), _sample(word_grams if of_words else byte_grams, gram, SHARE_WORDS if of_words else SHARE_BYTES))
    hot = zstandard.ZstdCompressor().compress(np.packbits(sketch.frequent(counts)).tobytes())
    packed = source.mapInArrow(lean(_pack(cut, window, gram, buckets, hot)), "bucket long, block binary")
    judged = stored(spark, packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_unpack(judge, buckets)), _JUDGED))
    places = judged.where("place is not null").select("bucket", "hash", "_doc", "_key", "place")
    verdicts = judged.where("runs is not null").select("bucket", "hash", "runs")
    gone = F.filter("runs", lambda r: r["low"].isNull() | (r["low"] < F.col("_doc")))
    found = F.transform(gone, lambda r: F.struct((F.col("place") + r["first"]).alias("first"), (F.col("place") + r["stop"] + window).alias("stop")))
    return places.join(verdicts, ["bucket", "hash"]).select("_doc", "_key", found.alias("spans")).where("size(spans) > 0")


def with_spans(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of ``docs`` with its text and the marked spans. Rows that agree
    in doc_id and text have equal spans, which are gathered once."""
    per = found.groupBy("_doc", "_key").agg(F.flatten(F.collect_set("spans")).alias("_spans"))
    source = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    return source.join(per, ["_doc", "_key"], "left").select(*[F.col(f"k_{c}").alias(c) for c in keep], "_text", "_spans")


def merged(column: pa.Array, row: int) -> list[tuple[int, int]]:
    """The spans of one row, sorted, with those that touch made one."""
    found = column[row].as_py() or []
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["stop"]) for s in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
