"""Operators on ordered lanes: delivery, batches, audits, shuffles, packing.

Operators that keep state are reset with each epoch, the ``flush_every``
chunks of a lane that belong together, so (lane, epoch) is the group in which
their kernels run; only keys and lengths enter Python, payloads are joined
back. Places in a lane are the records of earlier groups plus the place in the
own group: no window over records spans a lane.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY, LINE, SAMPLE, TOKEN_FIELDS, cursor, line, stable_hash, with_lineage
from . import kernels

PACKING = ("first_fit", "best_fit", "wrap", "best_fit_wrap")


def epoch(flush_every: int) -> Column:
    """Epoch of a chunk; one for the whole lane if nothing is flushed."""
    return F.expr(f"chunk_id div {flush_every}") if flush_every else F.lit(0).cast("long")


def fetch(plan: DataFrame, samples: DataFrame) -> DataFrame:
    """The only join: pointers to payloads."""
    return plan.join(samples, list(SAMPLE)).withColumn("component_sample_counts", F.create_map(F.col("component_id"), F.lit(1)))


def earlier(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """(lane_id, by..., _before): records of the lane's earlier groups.
    ``groups`` has a row for each group with its size ``_n``; the window over a
    lane sees these counts, not records."""
    before = F.sum("_n").over(W.partitionBy("lane_id").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    return groups.select("lane_id", *by, F.coalesce(before, F.lit(0)).cast("long").alias("_before"))


def numbered(df: DataFrame, by: Sequence[str], inside: Sequence[Column], name: str = "ordinal", counts: DataFrame | None = None) -> DataFrame:
    """Number the records of each lane by groups, then in the order ``inside``."""
    per = (df if counts is None else counts).groupBy("lane_id", *by).agg(F.count(F.lit(1)).alias("_n"))
    nth = F.row_number().over(W.partitionBy("lane_id", *by).orderBy(*inside)) - 1
    return df.withColumn("_nth", nth).join(earlier(per, by), ["lane_id", *by]).withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_nth", "_before")


def in_lane(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the records of each lane in order."""
    bare = "lineage" not in df.columns
    out = numbered(with_lineage(df), ["chunk_id"], cursor(), name)
    return out.drop("lineage") if bare else out


def round_robin(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Global order of delivery: one item of each lane in turn. Lanes that end
    are passed over, so the k-th item of a lane comes in round k."""
    sizes = df.groupBy("lane_id").count().collect()  # a number for each lane
    width = F.array(*[F.struct(F.lit(r["lane_id"]).alias("lane"), F.lit(r["count"]).alias("size")) for r in sizes])
    # Items before (k, lane): of each lane all up to its length, k of them, or k + 1 of lanes that come earlier.
    k, lane = F.col(order), F.col("lane_id")
    before = F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + F.least(x["size"], F.when(x["lane"] < lane, k + 1).otherwise(k)))
    return df.withColumn("delivery", before if sizes else F.lit(0).cast("long"))


def batch(df: DataFrame, size: int, *, drop_last: bool = True, order: str = "ordinal") -> DataFrame:
    """batch_id and slot of each record; a lane's last, short batch goes with
    ``drop_last``. Batches may span epochs."""
    out = df.withColumn("batch_id", F.expr(f"`{order}` div {size}")).withColumn("slot", (F.col(order) % size).cast("int"))
    if drop_last:
        count = df.groupBy("lane_id").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(F.broadcast(count), "lane_id").where(F.col("batch_id") < F.expr(f"_n div {size}")).drop("_n")
    return out


def dp_group(lane: Column, lanes: int, groups: int, mode: str = "contiguous") -> Column:
    """Which of ``groups`` reads a lane."""
    if mode == "interleaved":
        return (lane % groups).cast("int")
    if mode != "contiguous":
        raise ValueError(f"lanes go to groups 'contiguous' or 'interleaved', not {mode!r}")
    base, extra = divmod(lanes, groups)
    edge = extra * (base + 1)
    late = F.lit(extra) + F.floor((lane - edge) / max(base, 1))
    return F.when(lane < edge, F.floor(lane / (base + 1))).otherwise(late).cast("int")


def check_world(global_batch: int, lanes: int, groups: int, microbatch: int) -> int:
    """Records a lane gives to each optimiser step, or an error."""
    if lanes % groups:
        raise ValueError(f"{lanes} lanes can't be dealt evenly to {groups} groups")
    if global_batch % lanes or (global_batch // lanes) % microbatch:
        raise ValueError(f"a global batch of {global_batch} is not a whole number of microbatches of {microbatch} from each of {lanes} lanes")
    return global_batch // lanes


def steps(df: DataFrame, global_batch: int, lanes: int, order: str = "ordinal") -> DataFrame:
    """Optimiser step of each record: every step takes the same from every lane."""
    return df.withColumn("step", F.expr(f"`{order}` div {global_batch // lanes}"))


# Audits and progress


def exactly_once(plan: DataFrame, contributors: DataFrame) -> DataFrame:
    """How often each planned sample is closed (``is_last_child`` of its parts)."""
    closed = contributors.groupBy("lane_id", "chunk_id", "chunk_offset").agg(F.sum(F.col("is_last_child").cast("long")).alias("closed"))
    return plan.select("lane_id", "chunk_id", "chunk_offset").join(closed, ["lane_id", "chunk_id", "chunk_offset"], "left").withColumn("closed", F.coalesce("closed", F.lit(0)).cast("long"))


def dropped(plan: DataFrame, kept: DataFrame) -> DataFrame:
    """Planned records that no record carries."""
    return with_lineage(plan).join(with_lineage(kept).select(*KEY), list(KEY), "left_anti")


#: Records that one window of an order audit sees.
_STRETCH = 1 << 16


def out_of_order(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Records whose cursor is not above the one before in their lane. Compared
    within stretches of the order, and across their ends by a join."""
    here = F.struct(*cursor())
    rows = with_lineage(df).withColumn("_c", here).withColumn("_s", F.expr(f"`{order}` div {_STRETCH}"))
    ends = rows.groupBy("lane_id", "_s").agg(F.max_by("_c", order).alias("_e"))
    # Stretches may be empty, so the one before is the last that there is.
    before = F.lag("_e").over(W.partitionBy("lane_id").orderBy("_s"))
    ends = ends.select("lane_id", "_s", before.alias("_e"))
    previous = F.coalesce(F.lag("_c").over(W.partitionBy("lane_id", "_s").orderBy(order)), F.col("_e"))
    bad = rows.join(ends, ["lane_id", "_s"]).withColumn("_p", previous).where(F.col("_p") >= F.col("_c"))
    return bad.select(*df.columns)


def progress(df: DataFrame, config: Mapping[str, Any], order: str = "ordinal") -> str:
    """What a later run needs to go on: the last ordinal of each lane."""
    last = {str(r["lane_id"]): r["last"] for r in df.groupBy("lane_id").agg(F.max(order).alias("last")).collect()}  # a number for each lane
    return json.dumps({"config": fingerprint(config), "lanes": dict(sorted(last.items()))}, sort_keys=True)


def fingerprint(config: Mapping[str, Any]) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def resume(df: DataFrame, saved: str, config: Mapping[str, Any], order: str = "ordinal") -> DataFrame:
    """What a run delivers after the saved progress. The plan is a pure
    function, so the suffix is a filter; another config is refused."""
    state = json.loads(saved)
    if state["config"] != fingerprint(config):
        raise ValueError("the saved progress belongs to another configuration")
    if not state["lanes"]:
        return df
    last = F.create_map(*[F.lit(x) for k, v in state["lanes"].items() for x in (int(k), int(v))])
    return df.where(F.col(order) > F.coalesce(F.try_element_at(last, F.col("lane_id")), F.lit(-1)))


# Shuffles


def shuffle(df: DataFrame, size: int = 8192, *, seed: int = 0, algorithm: str = "streaming", flush_every: int = 8, growth: float = 1.5) -> DataFrame:
    """Reorder each lane within bounds; ``ordinal`` is the new place in the lane."""
    keyed = with_lineage(df).withColumn("_epoch", epoch(flush_every))
    if algorithm == "streaming":

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = in_order(pdf)
            lines = [[int(i) for i in x.split(".") if i] for x in pdf[LINE]]
            places = pdf[["chunk_id", "chunk_offset"]].values.tolist()
            cursors = [[*p, *l, *k] for p, l, k in zip(places, lines, pdf[list(SAMPLE)].values.tolist(), strict=True)]
            order = kernels.shuffle_stream(cursors, size, seed, int(pdf["lane_id"].iloc[0]))
            return pdf.iloc[order].assign(_at=range(len(pdf)))[[*KEY, "_epoch", "_at"]]

        names = [*KEY, "_epoch"]
        places = keyed.select(*names, line().alias(LINE)).groupBy("lane_id", "_epoch").applyInPandas(run, _ddl(keyed, names) + ", _at long")
        out = keyed.join(places, names)
    else:
        nth = (F.row_number().over(W.partitionBy("lane_id", "_epoch").orderBy(*cursor())) - 1).cast("long")
        rows = keyed.withColumn("_nth", nth)
        if algorithm == "block":
            block = F.expr(f"_nth div {size}")
        elif algorithm == "block_warmup":
            block = _ramp(size, growth)
        else:
            raise ValueError(f"unknown shuffle algorithm {algorithm!r}")
        rows = rows.withColumn("_block", block)
        mark = stable_hash(seed, F.col("lane_id"), F.col("_epoch"), F.col("_block"), F.col("dataset_id"), F.col("shard_id"), F.col("local_id"), F.col("chunk_offset"), F.when(F.size("lineage") > 0, line()))
        inside = (F.row_number().over(W.partitionBy("lane_id", "_epoch", "_block").orderBy(mark, *cursor())) - 1).cast("long")
        # Blocks are consecutive, so the first number of a block begins its places.
        first = F.min("_nth").over(W.partitionBy("lane_id", "_epoch", "_block"))
        out = rows.withColumn("_at", first + inside).drop("_block", "_nth")
    # A reordered epoch has the size it had.
    sizes = keyed.groupBy("lane_id", "_epoch").agg(F.count(F.lit(1)).alias("_n"))
    return _at_ordinals(out, sizes)


def _at_ordinals(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Places in the epoch (_at) to places in the lane."""
    return df.join(earlier(sizes, ["_epoch"]), ["lane_id", "_epoch"]).withColumn("ordinal", F.col("_before") + F.col("_at")).drop("_epoch", "_at", "_before")


def in_order(pdf: pd.DataFrame, first: Sequence[str] = ()) -> pd.DataFrame:
    """A group's records in the order of their cursors."""
    return pdf.sort_values([*first, "chunk_id", "chunk_offset", LINE, *SAMPLE]).reset_index(drop=True)


def _ramp(size: int, growth: float) -> Column:
    """Block of a record number when blocks grow: few sizes, then constant."""
    import math

    edges, now, at = [], 1 if size <= 1 else max(1, min(128, size // 16)), 0
    while now < size:
        at += now
        edges.append(at)
        now = min(size, max(now + 1, math.ceil(now * growth)))
    early = F.size(F.filter(F.array(*map(F.lit, edges)) if edges else F.array().cast("array<int>"), lambda e: e <= F.col("_nth"))).cast("long")
    return F.when(F.col("_nth") < at, early).otherwise(F.lit(len(edges)) + F.floor((F.col("_nth") - at) / size)).cast("long")


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


# Mixture correction


def ensure_mixture(
    df: DataFrame,
    targets: Mapping[int, Mapping[int, float]],
    *,
    most: int | None = 1000,
    ratio: float = 0.8,
    rate: float = 0.1,
    weight: str | None = None,
    ended: Mapping[int, Sequence[int]] | None = None,
    flush_every: int = 8,
) -> DataFrame:
    """Reorder each lane so that its components follow the target of its
    chunks (``targets``: from chunk id on). One record at a time; ``weight``
    names a column of token counts, "auto" takes the tokens where there are
    some, else records count one. ``ended``: components whose sources end with
    a chunk; they leave the target once that chunk is in."""
    starts = sorted(targets)
    table = {int(k): {int(c): float(w) for c, w in t.items()} for k, t in targets.items()}
    stamps = {int(c): frozenset(map(int, ks)) for c, ks in (ended or {}).items()}
    if weight == "auto":
        field = next((f for f in TOKEN_FIELDS if f in df.columns), None)
        amount = F.size(field) if field else F.lit(1)
    else:
        amount = F.col(weight) if weight else F.lit(1)
    keyed = with_lineage(df).withColumn("_epoch", epoch(flush_every)).withColumn("_w", amount.cast("double"))
    names = [*KEY, "_epoch"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = in_order(pdf)
        chunks = pdf["chunk_id"].tolist()
        # Each chunk has its target; chunks of one target are one but where a source ends.
        aims = {c: table[max((s for s in starts if s <= c), default=starts[0])] for c in set(chunks)}
        records = [kernels.Weighed(((int(k), float(w)),), int(c)) for k, w, c in zip(pdf["component_id"], pdf["_w"], chunks, strict=True)]
        order = kernels.ensure_mixture(records, aims, most, ratio, rate, stamps)
        return pdf.iloc[order].assign(_at=range(len(order)), _n=len(order))[[*names, "_at", "_n"]]

    places = keyed.select(*names, "component_id", "_w", line().alias(LINE)).groupBy("lane_id", "_epoch").applyInPandas(run, _ddl(keyed, names) + ", _at long, _n long")
    # Without ``most`` an epoch may lose records, so its size is the kernel's.
    sizes = keyed.groupBy("lane_id", "_epoch").agg(F.count(F.lit(1)).alias("_n")) if most is not None else places.where("_at = 0").select("lane_id", "_epoch", "_n")
    return _at_ordinals(keyed.drop("_w").join(places.drop("_n"), names), sizes)


def drift(df: DataFrame, target: Mapping[int, float], weight: str | None = None) -> DataFrame:
    """Share of each component in each lane against its target."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    per = df.groupBy("lane_id", "component_id").agg(F.sum(w).alias("_w"))
    whole = df.groupBy("lane_id").agg(F.sum(w).alias("_t"))
    want = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, float(v))])
    return per.join(F.broadcast(whole), "lane_id").select("lane_id", "component_id", (F.col("_w") / F.col("_t")).alias("actual"), F.coalesce(F.try_element_at(want, F.col("component_id")), F.lit(0.0)).alias("target"))


# Packing


def pack(
    df: DataFrame,
    max_length: int,
    *,
    length: str | None = None,
    tokens: str = "input_ids",
    algorithm: str = "first_fit",
    num_bins: int = 64,
    max_sequences_per_bin: int | None = None,
    min_sequence_length: int = 1,
    drop_oversized: bool = True,
    flush_strategy: str = "fifo",
    candidate_pool_size: int = 64,
    max_candidate_age: int | None = None,
    homogeneity: Column | None = None,
    shuffle_strategy: str | None = None,
    shuffle_seed: int = 0,
    flush_every: int = 8,
    by: Sequence[str] = ("lane_id",),
) -> DataFrame:
    """Segments of bins: (by..., domain, epoch, bin, seg, record key, start, stop).

    Only keys and lengths are packed; ``filled`` joins tokens. ``homogeneity``
    is a column whose values never share a bin. ``shuffle_strategy`` reorders
    the records of an epoch before they are packed: "length" from long to short,
    "random" by a stable hash of the record under ``shuffle_seed``."""
    if algorithm not in PACKING:
        raise ValueError(f"packing algorithm is one of {PACKING}, not {algorithm!r}")
    size = (F.col(length) if length else F.size(tokens)).cast("long")
    if algorithm in ("first_fit", "best_fit") and not drop_oversized:
        size = F.when(size > max_length, F.raise_error(F.lit("a record is longer than max_length")).cast("long")).otherwise(size)
    domain = homogeneity if homogeneity is not None else F.lit(0)
    if shuffle_strategy == "length":
        turn = -size
    elif shuffle_strategy == "random":
        turn = stable_hash(shuffle_seed, *[F.col(c) for c in ("lane_id", "chunk_id", "chunk_offset")], line(), *[F.col(c) for c in SAMPLE])
    elif shuffle_strategy is None:
        turn = F.lit(0)
    else:
        raise ValueError(f"packing shuffles 'random', 'length' or not at all, not {shuffle_strategy!r}")
    rows = with_lineage(df).select(*dict.fromkeys([*by, *KEY]), size.alias("_size"), domain.alias("domain"), epoch(flush_every).alias("epoch"), turn.alias("_turn")).where("_size > 0")
    group = [*by, "domain", "epoch"]
    if algorithm == "wrap" and max_sequences_per_bin is None:
        return _wrap(rows, max_length, group)
    names = [c for c in rows.columns if c not in ("_size", "_turn")]
    where = [names.index(c) for c in group]
    if algorithm == "wrap":
        bins = partial(kernels.wrap_bins, capacity=max_length, most_parts=max_sequences_per_bin)
    elif algorithm == "best_fit_wrap":
        bins = partial(kernels.best_fit_wrap_bins, capacity=max_length, pool=candidate_pool_size, most_age=max_candidate_age, most_parts=max_sequences_per_bin)
    else:
        rows = rows.where(F.col("_size") <= max_length)
        bins = partial(kernels.fit_bins, capacity=max_length, best=algorithm == "best_fit", num_bins=num_bins, least=min_sequence_length, most_parts=max_sequences_per_bin, evict=flush_strategy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; of a group only records are held
        of which a part is in no closed bin yet."""
        fields: list[pa.Field] = []

        def records() -> Iterator[tuple]:
            for batch in batches:
                fields[:] = [batch.schema.field(n) for n in names]
                yield from zip(*[batch.column(n).to_pylist() for n in (*names, "_size")], strict=True)

        def made(rows_: list[tuple]) -> pa.RecordBatch:
            own = [pa.field("bin", pa.int64()), pa.field("seg", pa.int32()), pa.field("start", pa.int64()), pa.field("stop", pa.int64())]
            schema = pa.schema([*fields, *own])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), schema, strict=True)], schema=schema)

        def sizes(group_: Iterator[tuple], held: dict[int, list]) -> Iterator[int]:
            for number, record in enumerate(group_):
                held[number] = [record[:-1], record[-1]]
                yield record[-1]

        out: list[tuple] = []
        for _, group_ in groupby(records(), key=lambda r: [v if v == v else "nan" for v in (r[i] for i in where)]):
            held: dict[int, list] = {}
            for b, parts in enumerate(bins(sizes(group_, held))):
                for seg, (number, start, stop) in enumerate(parts):
                    record = held[number]
                    record[1] -= stop - start
                    if not record[1]:
                        del held[number]
                    out.append((*record[0], b, seg, start, stop))
                if len(out) >= 8192:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    dealt = rows.repartition(*group).sortWithinPartitions(*group, "_turn", *cursor())
    return dealt.drop("_turn").mapInArrow(run, _ddl(rows, names) + ", bin long, seg int, start long, stop long")


def _wrap(rows: DataFrame, max_length: int, group: list[str]) -> DataFrame:
    """Interval arithmetic on running lengths; the tail of a group is dropped."""
    order = W.partitionBy(*group).orderBy("_turn", *cursor())
    ends = rows.withColumn("_e", F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_t", F.sum("_size").over(W.partitionBy(*group)))
    cut = ends.withColumn("_s", F.col("_e") - F.col("_size")).withColumn("bin", F.explode(F.expr(f"sequence(_s div {max_length}, (_e - 1) div {max_length})"))).where((F.col("bin") + 1) * max_length <= F.col("_t"))
    low, high = F.greatest("_s", F.col("bin") * max_length), F.least("_e", (F.col("bin") + 1) * max_length)
    seg = (F.row_number().over(W.partitionBy(*group, "bin").orderBy("_s")) - 1).cast("int")
    return cut.withColumn("seg", seg).withColumn("start", low - F.col("_s")).withColumn("stop", high - F.col("_s")).drop("_s", "_e", "_t", "_size", "_turn")


def filled(segments: DataFrame, df: DataFrame, max_length: int, *, tokens: str = "input_ids", aligned: Sequence[str] = (), pad_token_id: int = 0, by: Sequence[str] = ("lane_id",)) -> DataFrame:
    """Bins with their tokens end to end, padded; positions restart in each
    segment and in the padding; ``aligned`` columns are cut and padded alike."""
    from ..functions import training

    group = [*by, "domain", "epoch", "bin"]
    fields = [tokens, *aligned]
    tallied = "component_id" in df.columns and "component_id" not in KEY
    extra = ["component_id"] if tallied else []
    source = with_lineage(df).select(*KEY, *fields, *extra, F.size(tokens).cast("long").alias("_whole"))
    parts = segments.join(source, list(KEY))
    cut = [F.slice(f, (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias(f) for f in fields]
    gathered = parts.select(*group, "seg", *[k for k in KEY if k not in group], "start", "stop", *cut, *extra, "_whole").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("seg", *[k for k in KEY if k not in group], "start", "stop", *fields, *extra, "_whole"))).alias("_p"))
    real = F.aggregate("_p", F.lit(0), lambda a, p: a + F.size(p[tokens]))
    room = F.lit(max_length) - F.col("total_length")
    lengths = F.concat(F.transform("_p", lambda p: F.size(p[tokens])), F.when(room > 0, F.array(room)).otherwise(F.array().cast("array<int>")))
    out = gathered.withColumn("num_sequences", F.size("_p")).withColumn("total_length", real.cast("int"))
    for f in fields:
        kind = df.schema[f].dataType.elementType.simpleString()
        pad = F.lit(pad_token_id if f == tokens else 0).cast(kind)
        out = out.withColumn(f, F.concat(F.flatten(F.col(f"_p.{f}")), F.array_repeat(pad, room)))
    out = out.withColumn("positions", training.positions(lengths)).withColumn("padding_length", room).withColumn("packing_efficiency", F.col("total_length") / max_length)
    if tallied:
        # A record counts where its last token is; its tokens count where they are.
        tokens_of = lambda c: F.aggregate("_p", F.lit(0), lambda a, p: a + F.when(p["component_id"] == c, F.size(p[tokens])).otherwise(0))
        samples_of = lambda c: F.size(F.filter("_p", lambda p: (p["component_id"] == c) & (p["stop"] == p["_whole"])))
        inside = F.array_sort(F.array_distinct(F.transform("_p", lambda p: p["component_id"])))
        closing = F.array_sort(F.array_distinct(F.transform(F.filter("_p", lambda p: p["stop"] == p["_whole"]), lambda p: p["component_id"])))
        out = out.withColumn("component_token_counts", F.map_from_arrays(inside, F.transform(inside, tokens_of))).withColumn("component_sample_counts", F.map_from_arrays(closing, F.transform(closing, samples_of)))
    return out.withColumn("segments", F.transform("_p", lambda p: F.struct(*[p[k].alias(k) for k in (*[k for k in KEY if k not in group], "start", "stop")]))).drop("_p")


def contributors(segments: DataFrame) -> DataFrame:
    """Which records a bin carries. Of all parts of a planned sample, its
    children's included, one closes it: the last part of the last child."""
    here = F.struct("lineage", "stop")
    last = F.max(here).over(W.partitionBy("lane_id", "chunk_id", "chunk_offset", *SAMPLE))
    return with_lineage(segments).withColumn("is_last_child", here == last).select(*KEY, "is_last_child", *[c for c in ("domain", "epoch", "bin", "seg") if c in segments.columns])


# User state


def stateful(df: DataFrame, init: Callable[[], Any], push: Callable[[Any, dict], Sequence[dict]], flush: Callable[[Any], Sequence[dict]] | None, schema: str, *, flush_every: int = 8, columns: Sequence[str] | None = None) -> DataFrame:
    """A fold over each lane in order, with new state in every epoch."""
    keyed = df.withColumn("_epoch", epoch(flush_every)).withColumn(LINE, line() if "lineage" in df.columns else F.lit(""))
    keyed = keyed.select(*dict.fromkeys([*(columns or df.columns), "_epoch", LINE, "lane_id", "chunk_id", "chunk_offset", *SAMPLE]))
    given = list(columns or df.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = init(), []
        for record in in_order(pdf)[given].to_dict("records"):
            rows += push(state, record)
        if flush is not None:
            rows += flush(state)
        return pd.DataFrame(rows, columns=names)

    names = [f.split(" ")[0] for f in schema.split(", ")]
    return keyed.groupBy("lane_id", "_epoch").applyInPandas(run, schema)


def groups(spark: SparkSession, members: Mapping[str, Sequence[int]]) -> Callable[[Column], Column]:
    """A domain column from named groups of components; others stay alone."""
    pairs = [(c, f"g:{name}") for name, cs in members.items() for c in cs]
    if len({c for c, _ in pairs}) != len(pairs):
        raise ValueError("a component can be in one group only")
    table = F.create_map(*[F.lit(x) for p in pairs for x in p]) if pairs else None
    single = lambda c: F.concat(F.lit("c:"), c.cast("string"))
    return lambda c: F.coalesce(F.try_element_at(table, c), single(c)) if table is not None else single(c)
