"""Training columns of token rows: labels, masks, document ids, offsets.

All of it is column expressions over arrays. Padding is known by position (the
length of the real content), never by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100


def positions(segments: Column) -> Column:
    """Positions that restart in each segment, from segment lengths."""
    return F.flatten(F.transform(segments, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def sequence_positions(ids: Column) -> Column:
    return F.transform(ids, lambda _, i: i)


def inputs(ids: Column) -> Column:
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def labels(ids: Column, real: Column | None = None, ignore: int = IGNORE) -> Column:
    """Next ids; targets beyond the real content are ignored."""
    shifted = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    if real is None:
        return shifted
    return F.transform(shifted, lambda x, i: F.when(i + 1 < real, x).otherwise(F.lit(ignore).cast("bigint")))


def ignore_where(targets: Column, flags: Column, ignore: int = IGNORE) -> Column:
    """Ignore the targets whose flag is true."""
    return F.zip_with(targets, flags, lambda x, f: F.when(f, F.lit(ignore).cast("bigint")).otherwise(x))


def unsupervised(loss: Column) -> Column:
    """Flags of targets that the supervision mask leaves out."""
    return F.transform(F.slice(loss, 2, F.greatest(F.size(loss) - 1, F.lit(0))), lambda m: m == 0)


def segment_starts(position: Column) -> Column:
    """Flags of targets that open a segment."""
    return F.transform(F.slice(position, 2, F.greatest(F.size(position) - 1, F.lit(0))), lambda p: p == 0)


def after_eos(ids: Column, eos: int) -> Column:
    """Flags of targets whose input is the end of a sequence."""
    return F.transform(inputs(ids), lambda x: x == eos)


def loss_mask(targets: Column, ignore: int = IGNORE) -> Column:
    return F.transform(targets, lambda x: F.when(x != ignore, 1.0).otherwise(0.0).cast("float"))


def valid(targets: Column, ignore: int = IGNORE) -> Column:
    return F.size(F.filter(targets, lambda x: x != ignore)).cast("bigint")


def padding_mask(ids: Column, real: Column) -> Column:
    return F.transform(ids, lambda _, i: i >= real)


def document_ids(position: Column, real: Column) -> Column:
    """Number of segments begun so far, from 1; 0 on padding. Built from the
    lengths of the segments, so the work is linear in the row."""
    starts = F.filter(F.transform(position, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    bounds = F.concat(starts, F.array(F.size(position)))
    lengths = F.zip_with(F.slice(bounds, 2, F.size(starts)), starts, lambda b, a: b - a)
    begun = F.flatten(F.transform(lengths, lambda n, k: F.array_repeat(k + 1, n)))
    whole = F.concat(F.array_repeat(F.lit(0), F.element_at(bounds, 1)), begun)
    return F.transform(whole, lambda d, i: F.when(i < real, d).otherwise(0).cast("int"))


def cu_seqlens(position: Column, real: Column | None = None) -> Column:
    """Segment starts and the end."""
    stop = F.size(position) if real is None else real
    starts = F.filter(F.transform(position, lambda p, i: F.when((p == 0) & (i < stop), i)), lambda i: i.isNotNull())
    return F.concat(starts, F.array(stop.cast("int")))


def max_seqlen(offsets: Column) -> Column:
    """Longest distance of two neighbours."""
    gaps = F.zip_with(F.slice(offsets, 2, F.greatest(F.size(offsets) - 1, F.lit(0))), F.slice(offsets, 1, F.greatest(F.size(offsets) - 1, F.lit(0))), lambda b, a: b - a)
    return F.coalesce(F.array_max(gaps), F.lit(0))


def to_training(
    df: DataFrame,
    *,
    tokens: str = "input_ids",
    real: str | None = None,
    return_labels: bool = True,
    position_column: str | None = None,
    supervision: str | None = None,
    mask_segment_starts: bool = False,
    eos_mask_loss: bool = False,
    eos: int = 2,
    ignore_index: int = IGNORE,
    pad_to_length: int | None = None,
    pad_token_id: int = 0,
    extra_fields: tuple[str, ...] = (),
    rename: dict[str, str] | None = None,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Token rows as training rows. Masks apply in a fixed order: padding,
    supervision, segment starts, ends of sequences. ``extra_fields`` are
    columns aligned with the tokens: padded with 0 and cut like the inputs."""
    out = df.withColumn("_real", (F.col(real) if real else F.size(tokens)).cast("int"))
    ids = F.col(tokens)
    if pad_to_length is not None:
        room = F.lit(pad_to_length) - F.size(ids)
        tail = F.when(room < 0, F.raise_error(F.lit("a row is longer than pad_to_length")).cast("int")).otherwise(room)
        out = out.withColumn("_tail", tail)
        if position_column:
            more = F.when(F.col("_tail") > 0, F.sequence(F.lit(0), F.greatest(F.col("_tail") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            out = out.withColumn(position_column, F.concat(F.col(position_column).cast("array<int>"), more))
        if supervision:
            out = out.withColumn(supervision, F.concat(supervision, F.array_repeat(F.lit(0).cast("tinyint"), F.col("_tail"))))
        for f in extra_fields:
            out = out.withColumn(f, F.concat(f, F.array_repeat(F.lit(0).cast(df.schema[f].dataType.elementType), F.col("_tail"))))
        out = out.withColumn(tokens, F.concat(ids, F.array_repeat(F.lit(pad_token_id).cast("bigint"), F.col("_tail")))).drop("_tail")
    ids = F.col(tokens)
    place = F.col(position_column) if position_column else sequence_positions(ids)
    out = out.withColumn("_pos", place)
    if return_labels:
        target = labels(ids, F.col("_real"), ignore_index)
        if supervision:
            target = ignore_where(target, unsupervised(F.col(supervision)), ignore_index)
        if mask_segment_starts:
            target = ignore_where(target, segment_starts(F.col("_pos")), ignore_index)
        if eos_mask_loss:
            target = ignore_where(target, after_eos(ids, eos), ignore_index)
        out = out.withColumn("labels", target).withColumn("loss_mask", loss_mask(F.col("labels"), ignore_index)).withColumn("num_valid_tokens", valid(F.col("labels"), ignore_index))
        # A row of padding alone loses one place like any other.
        out = out.withColumn("_real", F.least(F.col("_real"), F.greatest(F.size(tokens) - 1, F.lit(0))))
        out = out.withColumns({f: inputs(F.col(f)) for f in extra_fields}).withColumn(tokens, inputs(F.col(tokens))).withColumn("_pos", inputs(F.col("_pos")))
    out = out.withColumn("padding_mask", padding_mask(F.col(tokens), F.col("_real"))).withColumn("document_ids", document_ids(F.col("_pos"), F.col("_real")))
    out = out.withColumn("cu_seqlens", cu_seqlens(F.col("_pos"))).withColumn("max_seqlen", max_seqlen(F.col("cu_seqlens"))).withColumn("position_ids", F.col("_pos")).drop("_pos", "_real")
    return renamed(out, rename or {}, exclude)


def renamed(df: DataFrame, rename: dict[str, str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rename (swaps are fine, collisions raise), then drop."""
    names = [rename.get(c, c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"renaming gives columns twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names).drop(*exclude)


def flatten_batches(df: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows of a batch joined end to end."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    joined = df.groupBy(*by).agg(rows.alias("_rows"))
    return joined.select(*by, *[F.flatten(F.col(f"_rows.{f}")).alias(f) for f in fields])
