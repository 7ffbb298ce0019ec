"""Best-fit packing of tokenised documents by bin completion.

A document's ids end with id 2; documents of more than 1,024 ids are cut into
full pieces after one shorter first piece. Which piece lengths share a
sequence depends on the histogram of lengths alone, which has at most 1,024
entries whatever the input, so the branch-and-bound runs on that histogram in
the driver and covers all documents at once. Its answer is a list of fillings
with multiplicities; pieces find their place by their rank among the pieces of
equal length, counted in salted groups so that a very common length is spread.

The search fills the sequence around the largest remaining length with each
undominated filling in turn, least waste first, made one at a time as they are
tried; a filling is taken as often as it goes. Branches whose waste already
rules out fewer sequences than the incumbent are pruned, and the first
incumbent is best-fit decreasing. Only the number of search nodes is bounded
(``nodes``: so many for each distinct length), then the incumbent stands;
all pieces are packed either way.

Defined results: null and empty texts are one piece (id 2 alone); repeated
rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, lean, small_batches, stored

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Search nodes for each distinct length before the incumbent stands.
NODES = 8

# White space beyond the six ASCII bytes, controls and joiners that may be taken for it.
_ODD = "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"


class Encoder:
    """Ids of whole texts.

    The vocabulary exists as ``tokenizers`` file and as ranks; both give the
    same ids (tested). The rank coder is several times faster, so it takes all
    texts but those with added tokens of the vocabulary written out, and those
    with characters on which the libraries' ideas of white space may differ;
    these go to ``tokenizers``.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN, path
        from tokenizers import Tokenizer

        vocabulary = vocabulary or path(VOCABULARY)
        self.model = Tokenizer.from_file(vocabulary)
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = [re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD, *added]))
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids without the closing one; null as empty."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.odd.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.coder.encode_to_numpy(text, disallowed_special=())


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(vocabulary)
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(END)).astype("<u4")
                for k, (at, size) in enumerate(pieces_of(len(ids))):
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how often)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = capacity // length
                for size, times in ((fit, left // fit), (left % fit, 1)):
                    if size and times:
                        open_.setdefault(capacity - size * length, []).append(((length,) * size, times))
                break
            filling, times = open_[gap].pop()
            used = min(times, left)
            if times > used:
                open_[gap].append((filling, times - used))
            if not open_[gap]:
                del open_[gap]
            open_.setdefault(gap - length, []).append((filling + (length,), used))
            left -= used
    return [x for group in open_.values() for x in group]


def _sums(lengths: list[int], counts: dict[int, int], most: int) -> list[int]:
    """For each place in ``lengths`` the sums (as bits) that it and later ones make."""
    out, mask = [1], (1 << most + 1) - 1
    for n in reversed(lengths):
        made, left, some = out[-1], min(counts[n], most // n), 1
        while left:
            some = min(some, left)
            made |= made << n * some & mask
            left, some = left - some, some * 2
        out.append(made)
    return out[::-1]


def _exactly(total: int, lengths: list[int], counts: dict[int, int], sums: list[int]) -> Iterator[tuple[int, ...]]:
    """All ways to make ``total`` of the lengths, longer ones first."""
    if not sums[0] >> total & 1:
        return
    stack = [(0, total, ())]
    while stack:
        at, left, chosen = stack.pop()
        if not left:
            yield chosen
            continue
        # Longer lengths than what is left have no part in it.
        at = max(at, bisect_left(lengths, -left, key=lambda n: -n))
        n = lengths[at]
        for k in range(min(counts[n], left // n) + 1):
            if sums[at + 1] >> left - k * n & 1:
                stack.append((at + 1, left - k * n, chosen + (n,) * k))


def completions(gap: int, counts: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``gap``, least waste first: none in which a
    further available length fits, or a longer one could replace one of its own."""
    lengths = sorted((n for n, c in counts.items() if c and n <= gap), reverse=True)
    sums = _sums(lengths, counts, gap)
    for waste in range(gap + 1):
        # What is no longer than the waste must all be inside, or it would fit.
        inside = [n for n in lengths if n <= waste]
        rest = gap - waste - sum(n * counts[n] for n in inside)
        if rest < 0:
            return
        if not sums[0] >> gap - waste & 1:
            continue
        small = tuple(n for n in inside for _ in range(counts[n]))
        others = lengths[: len(lengths) - len(inside)]
        for chosen in _exactly(rest, others, counts, _sums(others, counts, rest) if inside else sums):
            filling = chosen + small
            if not waste or not any(counts[x] > filling.count(x) for y in set(filling) for x in lengths if y < x <= y + waste):
                yield filling


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound: for a size k, what is longer than half a sequence needs
    one each, and what is from k to a half must go into the room that those
    leave beside them, or into sequences of its own."""
    n = np.array(sorted(counts), dtype=np.int64)
    c = np.array([counts[int(x)] for x in n], dtype=np.int64)
    least = 0
    for k in range(capacity // 2 + 1):
        long, half, short = n > capacity - k, (n <= capacity - k) & (2 * n > capacity), (2 * n <= capacity) & (n >= k)
        room = int((c[half] * (capacity - n[half])).sum())
        least = max(least, int(c[long].sum() + c[half].sum()) + max(0, -(-(int((n * c)[short].sum()) - room) // capacity)))
    return least


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: fewest sequences found, as (lengths, how often)."""
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, capacity)
    fewest = sum(t for _, t in best)
    total = sum(n * c for n, c in counts.items())
    need = least_sequences(counts, capacity)
    budget = nodes * len(counts)
    # One frame for each filling chosen: what was left before it, untried fillings, waste and sequences so far.
    trail: list[tuple[tuple[int, ...], int]] = []
    frames: list[tuple[dict[int, int], Iterator[tuple[int, ...]], int, int]] = []

    def enter(left: dict[int, int], waste: int, used: int) -> None:
        top = max(left)
        frames.append((left, ((top, *f) for f in completions(capacity - top, left | {top: left[top] - 1})), waste, used))

    if counts:
        enter(counts, 0, 0)
    while frames and fewest > need and budget:
        left, options, waste, used = frames[-1]
        filling = next(options, None)
        if filling is None:
            frames.pop()
            if trail:
                trail.pop()
            continue
        budget -= 1
        times = min(left[n] // filling.count(n) for n in set(filling))
        spare = waste + times * (capacity - sum(filling))
        # With this waste at least so many sequences are needed in all; later fillings waste no less.
        if -(-(total + spare) // capacity) >= fewest:
            if times == 1:
                frames.pop()
                if trail:
                    trail.pop()
            continue
        rest = {n: c - times * filling.count(n) for n, c in left.items()}
        rest = {n: c for n, c in rest.items() if c}
        trail.append((filling, times))
        if rest:
            enter(rest, spare, used + times)
        else:
            if used + times < fewest:
                fewest, best = used + times, list(trail)
            trail.pop()
    return best


def places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, and sequence and offset that a rank counts from."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for filling, times in fillings:
        at = 0
        for n in filling:
            rows.setdefault(n, []).append((taken.get(n, 0), base, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        base += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def _place(where: dict[int, tuple[np.ndarray, ...]]):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                first, base, at = where[n]
                slot = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine] = base[slot] + rank[mine] - first[slot]
                offset[mine] = at[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    small_batches(spark)
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_cut(vocabulary)), _PIECES)
    pieces = stored(spark, cut)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most CAPACITY rows
    salts = max(8, sum(histogram.values()) // 20_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .count()
        .withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("nth") - 1 + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(_place(places(complete(histogram)))), _PIECES + ", sequence_id long, offset long")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
