"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are counted in one vectorised pass and stored
(a few dozen numbers a document). The trees are fitted in the driver on at most
``TRAIN_ROWS`` distinct labelled rows, those of low hashes of doc_id and
statistics among the rows that are not held out; this bound is the only sample
taken. All trees are
complete, so they flatten into three arrays that numpy walks level by level
for a whole batch.

Defined results: null and empty texts have statistics of zero and a score like
any other; without usable labels every score is 0.5; with labels of one class
the score is near that class; several labels of one doc_id count as the
lowest; null doc_ids are scored, never held out and never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import at_most, boxed, documents, lean, small_batches, stored, unboxed
from .textvec import BLANK, ranges, slices, sums, words

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAF = 80, 5, 64, 0.15, 1.0, 10
CUT = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.zeros(256, bool)
_WIDE[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, bool)  # marks that prose has
_PLAIN[[ord(c) for c in ".,;:?'\"()-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True

NAMES = (
    "log_bytes", "log_words", "upper", "digit", "wide", "mark", "odd_mark", "stop_mark", "blank", "lines_per_word", "mean_length", "spread_length", "long_words",
    "capital_words", "loud_words", "marked_words", "odd_words", "mark_only_words", "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "mean_line", "short_lines",
)


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each group, and how often its commonest occurs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(groups)
    np.maximum.at(most, g[at], np.diff(np.append(at, len(g))))
    return np.bincount(g[at], minlength=groups).astype(float), most


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of statistics (see NAMES) for each text of a slice."""
    n = len(ends) - 1
    size = np.diff(ends).astype(float)
    some = np.maximum(size, 1)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[data])))
        return np.diff(total[ends])

    starts, stops, first = words(data, ends)
    amount = np.diff(first)
    owner = np.repeat(np.arange(n), amount)
    many = np.maximum(amount, 1).astype(float)
    length = stops - starts
    per = lambda x: np.bincount(owner, weights=x, minlength=n) / many
    mean = per(length)
    inside = lambda kind: (lambda t: t[stops] - t[starts])(np.concatenate(([0], np.cumsum(kind[data]))))
    marks, odd, upper = inside(_MARK), inside(_MARK & ~_PLAIN), inside(_UPPER)
    prefix = sums(data)
    hashes = ranges(prefix, starts, stops)
    distinct, top = _distinct(owner, hashes, n)
    together = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, _ = _distinct(owner[together], hashes[together] * np.uint64(3) + hashes[together + 1], n)
    line_starts, line_stops, line_first = words(data, ends, _LINE)
    lines = np.diff(line_first)
    line_owner = np.repeat(np.arange(n), lines)
    several = np.maximum(lines, 1).astype(float)
    line_kinds, _ = _distinct(line_owner, ranges(prefix, line_starts, line_stops), n)
    out = [
        np.log1p(size), np.log1p(amount), count(_UPPER) / some, count(_DIGIT) / some, count(_WIDE) / some, count(_MARK) / some, count(_MARK & ~_PLAIN) / some, count(_STOP) / some, count(BLANK) / some,
        lines / many, mean, np.sqrt(np.maximum(per(length.astype(float) ** 2) - mean**2, 0)), per(length > 12),
        per(_UPPER[data[starts]]) if len(starts) else np.zeros(n), per((upper >= 2) & (upper >= 0.6 * length)), per(marks > 0), per(odd > 0), per(marks == length), distinct / many, top / many,
        1 - np.where(amount > 1, pairs / np.maximum(amount - 1, 1), 1), line_kinds / several, amount / several, np.bincount(line_owner, weights=(line_stops - line_starts) < 40, minlength=n) / several,
    ]
    return np.stack(out, axis=1)


@dataclass
class Trees:
    """Complete trees of one depth: node k has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go right if the value is above
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.value) and len(x):
            depth = int(np.log2(self.value.shape[1]))
            tree = np.arange(len(self.value))[None, :]
            node = np.zeros((len(x), len(self.value)), dtype=np.int64)
            row = np.arange(len(x))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            raw += self.value[tree, node - (self.value.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss on binned features."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return empty
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        empty.base = base
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            width, begin = 2**level, 2**level - 1
            local = node - begin
            gain = np.zeros(width)
            where = np.full((width, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                slot = local * BINS + binned[:, j]
                g = np.bincount(slot, weights=slope, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(slot, weights=curve, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                c = np.bincount(slot, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                rest_g, rest_h, rest_c = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gains = g**2 / (h + RIDGE) + rest_g**2 / (rest_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gains[(c < LEAF) | (rest_c < LEAF)] = 0
                gains = gains[:, : len(e)]
                at = gains.argmax(axis=1)
                high = gains[np.arange(width), at]
                better = high > gain + 1e-12
                gain[better] = high[better]
                where[better] = np.stack([np.full(width, j), at], axis=1)[better]
            chosen = where[:, 0] >= 0
            for k in np.flatnonzero(chosen):
                feature[begin + k], threshold[begin + k] = where[k, 0], edges[where[k, 0]][where[k, 1]]
            right = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=slope, minlength=leaves) / (np.bincount(leaf, weights=curve, minlength=leaves) + RIDGE)
        raw += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def _measure(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(data, ends) for _, data, ends in slices(batch.column("_text"))]
            x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=[*keep, "stats"])

    return run


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and the statistics of the text."""
    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", stats array<double>"
    return source.mapInArrow(lean(_measure(keep)), schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents outside the held-out fifth."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Repeated rows are one, so that what is collected keeps the bound.
    known = stats.where(~held_out()).join(marked, "doc_id").select("doc_id", "stats", (F.col("quality") >= 1).cast("double").alias("y")).distinct()
    labelled = stored(stats.sparkSession, known)
    sample = at_most(labelled, rows, labelled.count(), "doc_id", "stats").toPandas()
    # The fit depends on the rows alone, not on the order in which they arrive.
    sample = sample.iloc[np.lexsort((sample["stats"].map(sum), sample["doc_id"]))] if len(sample) else sample
    x = np.stack(sample["stats"].to_numpy()) if len(sample) else np.zeros((0, len(NAMES)))
    return fit(x, sample["y"].to_numpy(dtype=float))


def _score(model: Trees, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], names=[*keep, "score"])

    return run


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stats = stored(spark, measured(documents(spark, sf_dir), ["doc_id"]))
    model = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = stats.mapInArrow(_score(model, ["doc_id"]), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the classifier accepts, unchanged.

    Statistics are counted once and stored beside the rows; the second pass
    scores them. Null and empty texts are scored like any other, repeated rows
    each; other columns may have any name and type."""
    small_batches(spark)
    box = boxed(docs, doc_id=F.col("doc_id"), _text=F.col("text"))
    full = stored(spark, box.mapInArrow(lean(_measure(["row", "doc_id"])), StructType([box.schema["row"], box.schema["doc_id"], StructField("stats", ArrayType(DoubleType()))])))
    model = train(full.select("doc_id", "stats"), labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield batch.select(["row"]).filter(pa.array(model.score(x) >= CUT))

    return unboxed(full.select("row", "stats").mapInArrow(keep, StructType([box.schema["row"]])))
