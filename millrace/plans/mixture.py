"""Mixture planning: weights to quotas, quotas to chunks, chunks to lanes.

What depends on all chunks in turn (quotas, exhaustion) is a few numbers per
chunk and component and runs in the driver. What depends on rows is joins: the
rank of a row comes from counts per shard, so no window spans a dataset.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.kernels import interleave, token_draws, weighted_random
from ..schema import stable_hash
from ..sources.readers import shard_index

POLICIES = ("stop", "repeat", "redistribute")


@dataclass(frozen=True)
class MixtureSpec:
    """Positive weights by name, scaled to sum to one."""

    weights: Mapping[str, float]

    def __post_init__(self):
        for name, w in self.weights.items():
            if not w > 0:
                raise ValueError(f"the weight of {name!r} must be positive, not {w}")
        if not self.weights:
            raise ValueError("a mixture needs at least one component")
        total = sum(self.weights.values())
        object.__setattr__(self, "weights", {k: w / total for k, w in self.weights.items()})

    def ordered(self, names: Sequence[str]) -> list[float]:
        if set(names) != set(self.weights):
            raise ValueError(f"the mixture names {sorted(self.weights)}, the datasets are {sorted(names)}")
        return [self.weights[n] for n in names]


class Quotas:
    """Whole quotas of a chunk from fractional debts carried over."""

    def __init__(self, size: int):
        self.size, self.debt = size, {}

    def next(self, weights: Mapping[int, float]) -> dict[int, int]:
        if set(weights) != set(self.debt):
            self.debt = dict.fromkeys(weights, 0.0)
        quota = {}
        for k, w in weights.items():
            self.debt[k] += w * self.size
            quota[k] = int(self.debt[k])
            self.debt[k] -= quota[k]
        short = self.size - sum(quota.values())
        while short > 0:
            k = max(quota, key=lambda c: self.debt[c])  # first of equal ones
            quota[k], self.debt[k], short = quota[k] + 1, self.debt[k] - 1, short - 1
        while short < 0:
            k = min((c for c in quota if quota[c] > 0), key=lambda c: self.debt[c])
            quota[k], self.debt[k], short = quota[k] - 1, self.debt[k] + 1, short + 1
        return quota


def fixed_quotas(weights: Sequence[float], size: int) -> list[int]:
    """One slot each, then whole extras, then largest remainders: the same in every chunk."""
    if any(w * size < 1 for w in weights):
        raise ValueError("a component's share of a chunk is less than one sample")
    quota = [int(w * size) for w in weights]
    for k in sorted(range(len(weights)), key=lambda k: (quota[k] - weights[k] * size, k))[: size - sum(quota)]:
        quota[k] += 1
    return quota


@dataclass(frozen=True)
class Source:
    """What the planner knows of a component."""

    rows: int
    policy: str = "repeat"
    max_repeats: int | None = None
    cost: float = 1.0  # tokens of a sample


@dataclass
class Chunk:
    """Quotas of a chunk as (component, pass, first rank, count), in order."""

    number: int
    target: dict[int, float]
    pieces: list[tuple[int, int, int, int]] = field(default_factory=list)
    exhausted: list[int] = field(default_factory=list)

    def counts(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, _, _, n in self.pieces:
            out[k] = out.get(k, 0) + n
        return out


def schedule(sources: Sequence[Source], weights: Sequence[float], size: int, *, stop_after_passes: int | None = None, max_chunks: int | None = None, by_tokens: bool = False) -> list[Chunk]:
    """All chunks that the policies allow.

    ``stop``: the plan ends before a chunk that the dataset can't fill.
    ``repeat``: it starts anew, at most ``max_repeats`` times. ``redistribute``:
    it gives what it has, and later chunks share its weight. With
    ``stop_after_passes`` the plan ends once every dataset has had so many
    passes. Only ``redistribute`` makes short chunks."""
    for s in sources:
        if s.policy not in POLICIES:
            raise ValueError(f"policy is one of {POLICIES}, not {s.policy!r}")
    if all(s.policy == "repeat" and s.max_repeats is None for s in sources) and stop_after_passes is None and max_chunks is None:
        raise ValueError("an endless plan needs max_chunks or stop_after_passes")
    for k, s in enumerate(sources):
        if s.policy == "repeat" and s.rows < math.ceil(weights[k] * size) + 1 and s.max_repeats is None and stop_after_passes is None:
            raise ValueError(f"component {k} has {s.rows} rows, too few to repeat in chunks of {size}")
    at, done = [0] * len(sources), [0] * len(sources)
    live = {k: weights[k] for k in range(len(sources)) if sources[k].rows}
    gone = [k for k in range(len(sources)) if not sources[k].rows]
    quotas, debt = Quotas(size), None
    chunks: list[Chunk] = []
    passes = lambda k: done[k] + (at[k] == sources[k].rows)
    while live and (max_chunks is None or len(chunks) < max_chunks):
        if stop_after_passes is not None and all(passes(k) >= stop_after_passes for k in range(len(sources)) if sources[k].rows):
            break
        total = sum(live.values())
        target = {k: w / total for k, w in live.items()}
        if by_tokens:
            names = list(target)
            drawn, debt = token_draws([target[k] for k in names], [sources[k].cost for k in names], size, debt if debt is not None and len(debt) == len(names) else None)
            quota = {k: drawn.count(i) for i, k in enumerate(names)}
        else:
            quota = quotas.next(target)
        chunk, ended, halted = Chunk(len(chunks), target), [], False
        now = list(at), list(done)
        for k, want in quota.items():
            s = sources[k]
            while want:
                if at[k] == s.rows:
                    if s.policy == "repeat" and (s.max_repeats is None or done[k] < s.max_repeats):
                        at[k], done[k] = 0, done[k] + 1
                    else:
                        break
                take = min(want, s.rows - at[k])
                chunk.pieces.append((k, done[k], at[k], take))
                at[k], want = at[k] + take, want - take
            if want and s.policy == "redistribute":
                ended.append(k)
            elif want:
                halted = True
        if halted:
            at, done = now
            break
        ended += [k for k in live if k not in ended and sources[k].policy == "redistribute" and at[k] == sources[k].rows]
        if not chunk.pieces:
            break
        gone = sorted({*gone, *ended})
        chunk.exhausted = list(gone)
        for k in ended:
            del live[k]
        if ended:
            debt = None
        chunks.append(chunk)
    return chunks


def lanes(spark: SparkSession, chunks: int | DataFrame, count: int, assignment: str = "permute", seed: int = 0) -> DataFrame:
    """(g, lane_id, chunk_id): where global chunk g goes. ``permute`` deals
    each block of ``count`` chunks in an order of its own."""
    table = spark.range(chunks).select(F.col("id").alias("g")) if isinstance(chunks, int) else chunks.select("g")
    table = table.withColumn("chunk_id", F.expr(f"g div {count}"))
    if assignment == "modulo":
        return table.withColumn("lane_id", (F.col("g") % count).cast("int"))
    if assignment != "permute":
        raise ValueError(f"lane assignment is 'permute' or 'modulo', not {assignment!r}")
    # Within each block the lanes in hash order take the chunks in order.
    block = table.select("chunk_id").distinct().withColumn("lane_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    nth = F.row_number().over(W.partitionBy("chunk_id").orderBy(stable_hash(seed, F.col("chunk_id"), F.col("lane_id")), "lane_id")) - 1
    dealt = block.withColumn("slot", nth)
    return table.withColumn("slot", (F.col("g") % count).cast("int")).join(dealt, ["chunk_id", "slot"]).select("g", "lane_id", "chunk_id")


def ranked(rows: DataFrame, *, seed: int = 0, shuffle_shards: bool = True, shuffle_within_shard: bool = False, block: int | None = None, passes: int = 1, reshuffle: bool = True) -> DataFrame:
    """Rows of one dataset (_shard, local_id, ...) with shard_id, pass and rank.

    Shards are put in hash order; a rank is the rows of earlier shards plus the
    place in the shard, so only rows of a shard or of a block of ``block``
    consecutive ranks are ever ordered together."""
    index = shard_index(rows)
    repeats = F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))
    key = F.when(F.lit(reshuffle), F.col("pass")).otherwise(0)
    order = index.select("*", repeats.alias("pass"))
    turn = [stable_hash(seed, key, F.col("shard_id")), "shard_id"] if shuffle_shards else ["shard_id"]
    before = F.sum("num_rows").over(W.partitionBy("pass").orderBy(*turn).rowsBetween(W.unboundedPreceding, -1))
    order = order.select("_shard", "shard_id", "pass", F.coalesce(before, F.lit(0)).alias("first"))
    out = rows.join(F.broadcast(order), "_shard")  # a row for each shard and pass
    key = F.when(F.lit(reshuffle), F.col("pass")).otherwise(0)
    place = F.col("local_id")
    if shuffle_within_shard:
        place = F.row_number().over(W.partitionBy("pass", "shard_id").orderBy(stable_hash(seed, key, F.col("shard_id"), F.col("local_id")), "local_id")) - 1
    out = out.withColumn("rank", (F.col("first") + place).cast("long"))
    if block is not None:
        group = F.expr(f"rank div {block}")
        nth = F.row_number().over(W.partitionBy("pass", group).orderBy(stable_hash(seed, key, group, F.col("shard_id"), F.col("local_id")), "rank")) - 1
        out = out.withColumn("rank", (group * block + nth).cast("long"))
    return out.drop("first", "_shard")


READ_MODES = ("round_robin", "weighted_random")


def _slots(pdf: pd.DataFrame, mode: str = "round_robin", seed: int = 0) -> pd.DataFrame:
    """Chunk offsets of each component's samples."""
    pdf = pdf.sort_values("component_id")
    names, counts, g = pdf["component_id"].tolist(), pdf["n"].tolist(), int(pdf["g"].iloc[0])
    order = interleave(counts) if mode == "round_robin" else weighted_random(counts, (seed << 32) + g)
    nth = [0] * len(names)
    rows = []
    for offset, k in enumerate(order):
        rows.append((g, names[k], nth[k], offset))
        nth[k] += 1
    return pd.DataFrame(rows, columns=["g", "component_id", "nth", "chunk_offset"])


def plan(spark: SparkSession, ranks: Sequence[DataFrame], chunks: Sequence[Chunk], *, canonical_replicas: int = 1, lane_assignment: str = "permute", read_mode: str = "round_robin", shuffle_components: bool = False, seed: int = 0) -> DataFrame:
    """The plan: a row for each sample drawn, with its lane and place.

    ``ranks``: for each component its rows (shard_id, local_id, pass, rank).
    ``read_mode`` interleaves the components of a chunk; with
    ``shuffle_components`` a component's samples come in hash order within it."""
    if read_mode not in READ_MODES:
        raise ValueError(f"read mode is one of {READ_MODES}, not {read_mode!r}")
    schema = "g long, component_id int, pass int, first long, n long, before long"
    rows = []
    for c in chunks:
        seen: dict[int, int] = {}
        for k, turn, first, n in c.pieces:
            rows.append((c.number, k, turn, first, n, seen.get(k, 0)))
            seen[k] = seen.get(k, 0) + n
    pieces = spark.createDataFrame(rows, schema)
    offsets = pieces.groupBy("g", "component_id").agg(F.sum("n").alias("n")).groupBy("g").applyInPandas(lambda pdf: _slots(pdf, read_mode, seed), "g long, component_id int, nth long, chunk_offset long")
    drawn = pieces.select("g", "component_id", "pass", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i", "rank"), "before").select("g", "component_id", "pass", "rank", (F.col("before") + F.col("i")).alias("nth"))
    if shuffle_components:
        mark = stable_hash(seed, F.col("g"), F.col("component_id"), F.col("pass"), F.col("rank"))
        drawn = drawn.withColumn("nth", (F.row_number().over(W.partitionBy("g", "component_id").orderBy(mark, "nth")) - 1).cast("long"))
    order = None
    for k, r in enumerate(ranks):
        one = r.select(F.lit(k).alias("component_id"), F.lit(k).alias("dataset_id"), "shard_id", "local_id", F.col("pass").cast("int").alias("pass"), "rank")
        order = one if order is None else order.unionByName(one)
    placed = drawn.join(offsets, ["g", "component_id", "nth"]).join(order, ["component_id", "pass", "rank"])
    where = lanes(spark, spark.createDataFrame([(c.number,) for c in chunks], "g long"), canonical_replicas, lane_assignment, seed)
    return placed.join(where, "g").select("lane_id", "chunk_id", "chunk_offset", "component_id", "dataset_id", "shard_id", "local_id", "pass", F.col("g").alias("global_chunk"))


def exhaustion(spark: SparkSession, chunks: Sequence[Chunk]) -> DataFrame:
    """(g, source_exhausted): components that are empty after each chunk."""
    return spark.createDataFrame([(c.number, ",".join(map(str, c.exhausted))) for c in chunks], "g long, source_exhausted string")


def token_ratio(texts: DataFrame, tokens: str, size: str, by: str = "component_id") -> DataFrame:
    """Tokens for each payload byte, over all rows."""
    return texts.groupBy(by).agg((F.sum(tokens) / F.sum(size)).alias("tokens_per_byte"))


def token_cost(rows: DataFrame, ratios: DataFrame, size: str, by: Sequence[str] = ("component_id", "shard_id")) -> DataFrame:
    """Tokens that a sample of a shard costs: mean bytes times ratio, one at least."""
    per = rows.groupBy(*by).agg(F.avg(size).alias("avg_bytes"))
    return per.join(F.broadcast(ratios), by[0]).withColumn("cost", F.greatest(F.lit(1.0), F.col("avg_bytes") * F.col("tokens_per_byte")))
