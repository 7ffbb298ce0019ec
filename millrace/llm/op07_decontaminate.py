"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers) are lower-cased and cut into words; every
window of eight words becomes a pattern. Documents are normalised the same
way, scanned once, and each match is mapped back to words and to bytes of the
original text.

Every task builds the automaton from the patterns that come with it, so their
size is bounded: patterns beyond ``MAX_PATTERN_BYTES`` go to further automata,
each in a pass of its own over what the pass before stored, to which it adds
its hits. One group of patterns is in the driver at a time (and the next).

Defined results: null and wordless texts have no hits; items without words
never occur; an item_id given twice counts once; windows of an item without an
id cover words but add no item; repeated document rows each get their own row;
other columns may have any name and type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import boxed, documents, lean, small_batches, stored, unboxed
from .textvec import LOWER

WINDOW = 8
MIN_ITEMS = 2
MAX_PATTERN_BYTES = 32 << 20

# Word bytes after lower-casing: digits, a-z and everything beyond ASCII.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER.tolist())
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalise(text: str | None) -> bytes:
    """Words joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def windows(normal: bytes, size: int = WINDOW) -> list[bytes]:
    words = normal.split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _groups(items: Iterator, limit: int) -> Iterator[dict[bytes, list[str]]]:
    group: dict[bytes, list[str]] = {}
    held = 0
    for row in items:
        for pattern in set(windows(normalise(row.text))):
            fresh = pattern not in group
            owners = group.setdefault(pattern, [])
            if row.item_id is not None and str(row.item_id) not in owners:
                owners.append(str(row.item_id))
                fresh = True
            held += (len(pattern) + 16) * fresh
        if held >= limit:
            yield group
            group, held = {}, 0
    if group:
        yield group


def _automaton(group: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for pattern, owners in group.items():
        automaton.add_word(" " + pattern.decode("latin-1") + " ", (len(pattern) + 1, owners))
    if group:
        automaton.make_automaton()
    return automaton


def find(automaton: ahocorasick.Automaton, normal: bytes) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged word ranges that occurrences cover, and the items that occur."""
    if not normal or not len(automaton):
        return [], []
    found = []  # for each match, in the padded text: the space before its first word and the one after its last
    items: set[str] = set()
    for end, (length, owners) in automaton.iter(f" {normal.decode('latin-1')} "):
        found.append((end - length, end))
        items.update(owners)
    if not found:
        return [], []
    spaces = np.flatnonzero(np.frombuffer(b" " + normal, dtype=np.uint8) == 32)
    pairs = np.array(found)
    first = np.searchsorted(spaces, pairs[:, 0])
    stop = np.searchsorted(spaces, pairs[:, 1])
    merged: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), stop.tolist(), strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged], sorted(items)


_SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("stop", IntegerType())]))
_FOUND = [StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("items", ArrayType(StringType()))]


def _scan(group: dict[bytes, list[str]], keep: list[str]):
    """Hits of one group's patterns, added to those that the rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(group)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text"):
                normal = normalise(text.as_py())
                hit, which = find(automaton, normal)
                counts.append(normal.count(b" ") + 1 if normal else 0)
                spans.append([{"first": a, "stop": b} for a, b in hit])
                items.append(which)
            if "spans" in batch.schema.names:
                spans = [a + b for a, b in zip(batch.column("spans").to_pylist(), spans, strict=True)]
                items = [a + b for a, b in zip(batch.column("items").to_pylist(), items, strict=True)]
            columns = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "spans", "items"])

    return run


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` has the columns row and text. Each row, its number of words, the
    word ranges that benchmark windows cover, and the items found."""
    small_batches(spark)
    rows = benchmark.select("item_id", "text").where("text is not null").toLocalIterator()
    groups = _groups(rows, MAX_PATTERN_BYTES)
    group, following = next(groups, {}), next(groups, None)
    found = docs.select("row", "text")
    while True:
        keep = ["row"] if following is None else ["row", "text"]
        found = found.mapInArrow(lean(_scan(group, keep)), StructType([*[docs.schema[c] for c in keep], *_FOUND]))
        if following is None:
            return found
        found = stored(spark, found)
        group, following = following, next(groups, None)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, digests = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            stop = total = 0
            for a, b in sorted((s["first"], s["stop"]) for s in spans):
                total += max(0, b - max(a, stop))
                stop = max(stop, b)
            ids = sorted(set(items))
            n_hit.append(total)
            n_items.append(len(ids))
            digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests), pa.array([n >= MIN_ITEMS for n in n_items], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("row"), "text")
    found = hits(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents that hold two or more items go; from others
    the passages that windows cover are cut out. Columns stay as they are;
    null and wordless texts stay, repeated rows are judged each."""
    place = docs.columns.index("text")
    found = hits(spark, boxed(docs, text=F.col("text")), benchmark)
    kept = found.where(F.size(F.array_distinct("items")) < MIN_ITEMS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            fields = row.flatten()
            texts = fields[place].to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    data = texts[i].encode("utf-8", "surrogatepass")
                    places = [m.span() for m in _WORD.finditer(data)]
                    out, at = b"", 0
                    for a, b in sorted((s["first"], s["stop"]) for s in spans):
                        if places[b - 1][1] > at:
                            out += data[at : max(at, places[a][0])]
                            at = places[b - 1][1]
                    texts[i] = (out + data[at:]).decode("utf-8", "surrogatepass")
            fields[place] = pa.array(texts, fields[place].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["row"])

    return unboxed(kept.select("row", "spans").mapInArrow(cut, StructType([found.schema["row"]])))
