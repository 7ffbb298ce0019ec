"""A lazy, fluent builder over the operators.

Every method returns a new pipeline; nothing runs until rows are asked for.
Two orders are kept apart: the cursor (where a sample was planned) and, once a
lane is reordered or batched, ``ordinal`` (where it is delivered).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import chat, templates, text, training
from .operators import lanes
from .plans import mixture
from .schema import token_field
from .sources.readers import Dataset, samples


@dataclass(frozen=True)
class Options:
    """What decides results; all else is Spark configuration."""

    seed: int = 0
    canonical_replicas: int = 1
    flush_every_k_chunks: int = 8
    dp_degree: int = 1
    dp_group_id: int | None = None
    lane_mode: str = "contiguous"


@dataclass(frozen=True)
class WorkSource:
    """Datasets drawn by weight: gives the plan."""

    datasets: Sequence[Dataset]
    weights: Mapping[str, float]
    chunk_size: int = 16384
    seed: int = 0
    shuffle_shards: bool = True
    shuffle_within_shard: bool = False
    shuffle_block_size: int | str | None = None
    exhausted_policy: str | Mapping[str, str] = "repeat"
    max_repeats: int | None = None
    reshuffle_on_repeat: bool = True
    stop_after_passes: int | None = 1
    max_chunks: int | None = None
    lane_assignment: str = "permute"
    read_mode: str = "round_robin"
    shuffle_components: bool = False
    token_costs: Mapping[str, float] | None = None

    def names(self) -> list[str]:
        return [d.name for d in self.datasets]

    def config(self) -> dict[str, Any]:
        """All that the plan follows from but the rows: progress belongs to it."""
        settings = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "datasets"}
        return {"datasets": self.names(), **{k: dict(v) if isinstance(v, Mapping) else v for k, v in settings.items()}}

    def chunks(self, spark: SparkSession) -> list[mixture.Chunk]:
        spec = mixture.MixtureSpec(self.weights).ordered(self.names())
        sources = []
        for d in self.datasets:
            policy = self.exhausted_policy if isinstance(self.exhausted_policy, str) else self.exhausted_policy[d.name]
            cost = (self.token_costs or {}).get(d.name, 1.0)
            sources.append(mixture.Source(d.load(spark).count(), policy, self.max_repeats, cost))
        endless = any(s.policy == "repeat" for s in sources)
        return mixture.schedule(sources, spec, self.chunk_size, stop_after_passes=self.stop_after_passes if endless else None, max_chunks=self.max_chunks, by_tokens=self.token_costs is not None)

    def plan(self, spark: SparkSession, replicas: int) -> DataFrame:
        chunks = self.chunks(spark)
        turns: dict[int, int] = {}
        for c in chunks:
            for k, turn, _, _ in c.pieces:
                turns[k] = max(turns.get(k, 0), turn)
        ranks = []
        for k, d in enumerate(self.datasets):
            rows = d.load(spark)
            block = self.shuffle_block_size
            if block == "auto":
                block = 8 * max((r["n"] for r in rows.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).collect() if r["n"]), default=1)
            elif block == "global":
                block = max(1, rows.count())
            ranks.append(mixture.ranked(rows, seed=self.seed, shuffle_shards=self.shuffle_shards, shuffle_within_shard=self.shuffle_within_shard, block=block, passes=turns.get(k, 0) + 1, reshuffle=self.reshuffle_on_repeat))
        return mixture.plan(spark, ranks, chunks, canonical_replicas=replicas, lane_assignment=self.lane_assignment, read_mode=self.read_mode, shuffle_components=self.shuffle_components, seed=self.seed)


@dataclass(frozen=True)
class Pipeline:
    spark: SparkSession
    df: DataFrame
    stages: tuple[tuple[str, dict], ...] = ()
    options_: Options = field(default_factory=Options)
    batched: bool = False
    reordered: bool = False

    @classmethod
    def of(cls, spark: SparkSession, source: WorkSource, options: Options | None = None) -> Pipeline:
        """Plan the source and fetch its samples."""
        options = options or Options(seed=source.seed)
        plan = source.plan(spark, options.canonical_replicas)
        if options.dp_group_id is not None:
            mine = lanes.dp_group(F.col("lane_id"), options.canonical_replicas, options.dp_degree, options.lane_mode) == options.dp_group_id
            plan = plan.where(mine)
        rows = lanes.fetch(plan, samples(spark, source.datasets))
        return cls(spark, rows, (("plan", source.config()),), options)

    @classmethod
    def from_frame(cls, spark: SparkSession, df: DataFrame, options: Options | None = None) -> Pipeline:
        return cls(spark, df, (("frame", {}),), options or Options())

    def _with(self, name: str, df: DataFrame, config: dict | None = None, **changes: Any) -> Pipeline:
        shown = {k: v if isinstance(v, (int, float, str, bool, type(None), list, tuple, dict)) else str(v) for k, v in (config or {}).items()}
        return replace(self, df=df, stages=(*self.stages, (name, shown)), **changes)

    def options(self, **changes: Any) -> Pipeline:
        return replace(self, options_=replace(self.options_, **changes))

    # Records

    def decode_text(self, fields: Sequence[str] = ("text",), **options: Any) -> Pipeline:
        return self._with("decode_text", text.decode_text(self.df, tuple(fields), **options), options)

    def map_transform(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A DataFrame transformation of records; before ``batch`` only."""
        if self.batched:
            raise ValueError("map_transform works on records and must come before batch")
        return self._with("map_transform", fn(self.df), {"fn": getattr(fn, "__qualname__", fn)})

    def map_batch(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        if not self.batched:
            raise ValueError("map_batch works on batches and must come after batch")
        return self._with("map_batch", fn(self.df), {"fn": getattr(fn, "__qualname__", fn)})

    def add_op(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return self._with(name, fn(self.df))

    def tokenize(self, field: str = "text", **options: Any) -> Pipeline:
        return self._with("tokenize", text.tokenize(self.df, field, **options), options)

    def split_long_samples(self, max_length: int, **options: Any) -> Pipeline:
        return self._with("split_long_samples", text.split_long(self.df, max_length, **options), {"max_length": max_length, **options})

    def expand_chat(self, field: str = "messages") -> Pipeline:
        """``query`` numbers the user queries; ``ordinal`` stays the place in the lane."""
        return self._with("expand_chat", chat.expand_chat(self.df, field).withColumnRenamed("ordinal", "query"))

    def tokenize_chat(self, field: str = "messages", **options: Any) -> Pipeline:
        return self._with("tokenize_chat", chat.tokenize_chat(self.df, field, **options), options)

    def tokenize_chat_template(self, encode: Callable[[Column], Column], field: str = "messages", **options: Any) -> Pipeline:
        return self._with("tokenize_chat_template", templates.tokenize_chat_template(self.df, encode, field, **options), options)

    def prefetch(self, **_: Any) -> Pipeline:
        """Spark reads ahead on its own; kept so that pipelines carry over."""
        return self

    def materialize(self) -> Pipeline:
        """A barrier that cuts Spark's lineage, in the folder of spark.checkpoint.dir."""
        if not self.spark.conf.get("spark.checkpoint.dir", None):
            raise ValueError("materialize needs the shared folder that spark.checkpoint.dir names")
        return self._with("materialize", self.df.checkpoint())

    # Order and state

    def shuffle(self, buffer_size: int = 8192, *, seed: int | None = None, algorithm: str = "streaming") -> Pipeline:
        seed = self.options_.seed if seed is None else seed
        out = lanes.shuffle(self.df, buffer_size, seed=seed, algorithm=algorithm, flush_every=self.options_.flush_every_k_chunks)
        return self._with("shuffle", self._replaced(out), {"buffer_size": buffer_size, "algorithm": algorithm, "seed": seed}, reordered=True)

    def ensure_mixture(self, targets: Mapping[int, Mapping[int, float]], **options: Any) -> Pipeline:
        out = lanes.ensure_mixture(self.df, targets, flush_every=self.options_.flush_every_k_chunks, **options)
        return self._with("ensure_mixture", self._replaced(out), options, reordered=True)

    def _replaced(self, out: DataFrame) -> DataFrame:
        """Give reordered rows cursors in their new order, chunk by chunk size,
        so that later operators go on from it within the same epochs."""
        first = F.col("chunk_id") - F.col("chunk_id") % max(1, self.options_.flush_every_k_chunks)
        return out.withColumn("chunk_id", first).withColumn("chunk_offset", F.col("ordinal"))

    def stateful_transform(self, init: Callable, push: Callable, flush: Callable | None, schema: str) -> Pipeline:
        return self._with("stateful_transform", lanes.stateful(self.df, init, push, flush, schema, flush_every=self.options_.flush_every_k_chunks))

    def pack_sequences(self, max_length: int, **options: Any) -> Pipeline:
        """Segments of bins, without payloads."""
        options.setdefault("tokens", token_field(self.df.columns))
        return self._with("pack_sequences", lanes.pack(self.df, max_length, flush_every=self.options_.flush_every_k_chunks, **options), {"max_length": max_length, **options})

    def pack_flat(self, max_length: int, *, pad_token_id: int = 0, aligned: Sequence[str] = (), **options: Any) -> Pipeline:
        """Bins with tokens, positions and padding; ``ordinal`` numbers them."""
        tokens = options.pop("tokens", None) or token_field(self.df.columns)
        parts = lanes.pack(self.df, max_length, tokens=tokens, flush_every=self.options_.flush_every_k_chunks, **options)
        out = lanes.filled(parts, self.df, max_length, tokens=tokens, aligned=aligned, pad_token_id=pad_token_id)
        out = lanes.numbered(out, ["epoch"], [F.col("domain"), F.col("bin")], counts=parts.where("seg = 0"))
        return self._with("pack_flat", out, {"max_length": max_length, **options}, reordered=True)

    def batch(self, microbatch_size: int, *, drop_last: bool = True) -> Pipeline:
        rows = self.df if "ordinal" in self.df.columns else lanes.in_lane(self.df)
        return self._with("batch", lanes.batch(rows, microbatch_size, drop_last=drop_last), {"microbatch_size": microbatch_size, "drop_last": drop_last}, batched=True)

    def to_training(self, **options: Any) -> Pipeline:
        options.setdefault("tokens", token_field(self.df.columns))
        if "positions" in self.df.columns:
            options.setdefault("position_column", "positions")
        if "total_length" in self.df.columns:
            options.setdefault("real", "total_length")
        return self._with("to_training", training.to_training(self.df, **options), options)

    # Results

    def frame(self) -> DataFrame:
        return self.df

    def ordered(self) -> DataFrame:
        """Rows under their lane ordinal."""
        return self.df if "ordinal" in self.df.columns else lanes.in_lane(self.df)

    def __iter__(self) -> Iterator[Row]:
        """Rows of all lanes in turn, without gathering them in the driver."""
        return self.ordered().orderBy("ordinal", "lane_id").toLocalIterator()

    def sample_at(self, ordinal: int, lane: int = 0) -> DataFrame:
        return self.ordered().where((F.col("ordinal") == ordinal) & (F.col("lane_id") == lane))

    def config(self) -> dict:
        return {"stages": [list(s) for s in self.stages], "seed": self.options_.seed, "canonical_replicas": self.options_.canonical_replicas, "flush": self.options_.flush_every_k_chunks}

    def fingerprint(self) -> str:
        return lanes.fingerprint(self.config())

    def checkpoint(self, delivered: Column | None = None) -> str:
        """Progress after the rows for which ``delivered`` holds (all if None)."""
        rows = self.ordered()
        return lanes.progress(rows if delivered is None else rows.where(delivered), self.config())

    def restore(self, saved: str) -> Pipeline:
        return self._with("restore", lanes.resume(self.ordered(), saved, self.config()))

    def explain(self) -> str:
        """The stages, then Spark's plan."""
        lines = [f"{i}. {name} {config}" for i, (name, config) in enumerate(self.stages)]
        return "\n".join([*lines, self.df._jdf.queryExecution().toString()])
