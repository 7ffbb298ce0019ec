"""Samples from files and memory: (dataset_id, shard_id, local_id, payload...).

A shard is a file; a row's place in it comes from the reader (Parquet) or from
the byte order of lines (JSON lines), never from partition order, so ids do not
depend on how the input is split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes by format.
SUFFIXES = {"jsonl": (".jsonl", ".jsonl.gz", ".jsonl.bz2", ".jsonl.zst", ".ndjson"), "parquet": (".parquet",), "orc": (".orc",), "mds": (".mds",), "csv": (".csv",)}

_formats: dict[str, Callable[..., DataFrame]] = {}


def register_format(name: str, reader: Callable[..., DataFrame], suffixes: Sequence[str] = ()) -> None:
    """``reader(spark, path, schema)`` gives columns _shard, local_id and the payload."""
    _formats[name] = reader
    if suffixes:
        SUFFIXES[name] = tuple(suffixes)


def detect_format(paths: Sequence[str]) -> str:
    """The format whose suffix a path has; JSON lines before the others."""
    for name, suffixes in SUFFIXES.items():
        if any(p.endswith(suffixes) for p in paths):
            return name
    raise ValueError(f"no known format among {list(paths)[:5]}")


def _parquet(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).select(F.col("_metadata.file_path").alias("_shard"), F.col("_metadata.row_index").alias("local_id"), "*")


def _jsonl(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """One record a non-blank line; the ordinal counts those lines in each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_shard"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nth"), "value")
    # Within a split, lines come in file order, and splits of a file in order of their start.
    lines = lines.where(F.trim("value") != "")
    ordinal = F.row_number().over(W.partitionBy("_shard").orderBy("_block", "_nth")) - 1
    numbered = lines.withColumn("local_id", ordinal.cast("long"))
    if schema is None:
        return numbered.select("_shard", "local_id", F.col("value").alias("record"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return numbered.select("_shard", "local_id", parsed.alias("_r")).select("_shard", "local_id", "_r.*")


register_format("parquet", _parquet)
register_format("jsonl", _jsonl)
register_format("orc", lambda spark, path, schema: _unordered(spark.read.orc(path), "orc"))
register_format("csv", lambda spark, path, schema: _unordered((spark.read.schema(schema) if schema else spark.read).csv(path, header=True), "csv"))


def _unordered(df: DataFrame, name: str) -> DataFrame:
    raise ValueError(f"{name} files have no stable row index; convert them to Parquet or JSON lines")


@dataclass(frozen=True)
class Dataset:
    """A named set of shards. ``samples`` is lazy."""

    name: str
    load: Callable[[SparkSession], DataFrame] = field(repr=False)

    @classmethod
    def from_path(cls, name: str, path: str, *, fmt: str | None = None, schema: T.StructType | None = None) -> Dataset:
        kind = fmt or detect_format([path.rstrip("/")]) if fmt or "." in path.rsplit("/", 1)[-1] else None

        def load(spark: SparkSession) -> DataFrame:
            chosen = kind or detect_format(_listing(spark, path))
            if chosen not in _formats:
                raise ValueError(f"format {chosen!r} has no reader; register_format() adds one")
            return _formats[chosen](spark, path, schema)

        return cls(name, load)

    @classmethod
    def from_dict(cls, name: str, shards: Mapping[int, Sequence[Mapping[str, Any]]], schema: T.StructType | str | None = None) -> Dataset:
        rows = [(str(s).zfill(12), i, dict(r)) for s, rs in shards.items() for i, r in enumerate(rs)]

        def load(spark: SparkSession) -> DataFrame:
            if not rows:
                wanted = schema if schema is not None else "text string"
                return spark.createDataFrame([], wanted).select(F.lit("").alias("_shard"), F.lit(0).cast("long").alias("local_id"), "*").where("false")
            payload = spark.createDataFrame([{"_at": i, **r} for i, (_, _, r) in enumerate(rows)]) if schema is None else spark.createDataFrame([(i, *(r.get(f) for f in _names(schema))) for i, (_, _, r) in enumerate(rows)], _with_at(schema))
            place = spark.createDataFrame([(i, s, k) for i, (s, k, _) in enumerate(rows)], "_at long, _shard string, local_id long")
            return place.join(payload, "_at").drop("_at")

        return cls(name, load)

    @classmethod
    def from_frame(cls, name: str, df: DataFrame, shard: str, order: Sequence[str]) -> Dataset:
        """Rows of a table: ``shard`` names the shard, ``order`` must be total in it."""

        def load(spark: SparkSession) -> DataFrame:
            nth = F.row_number().over(W.partitionBy(shard).orderBy(*order)) - 1
            return df.select(F.col(shard).cast("string").alias("_shard"), nth.cast("long").alias("local_id"), "*")

        return cls(name, load)


def _names(schema: T.StructType | str) -> list[str]:
    return (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()


def _with_at(schema: T.StructType | str) -> T.StructType:
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([T.StructField("_at", T.LongType()), *kind.fields])


def _listing(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext() and len(found) < 1000:
        found.append(files.next().getPath().toString())
    return found


def shard_index(df: DataFrame) -> DataFrame:
    """(_shard, shard_id, num_rows, first_rank): shards in order of name.

    The table has a row for each shard; ranks of rows follow from it without
    ordering the rows of a dataset."""
    counts = df.groupBy("_shard").agg(F.count(F.lit(1)).alias("num_rows"))
    order = W.orderBy("_shard")
    before = F.sum("num_rows").over(order.rowsBetween(W.unboundedPreceding, -1))
    return counts.select("_shard", (F.row_number().over(order) - 1).cast("long").alias("shard_id"), "num_rows", F.coalesce(before, F.lit(0)).alias("first_rank"))


def samples(spark: SparkSession, datasets: Sequence[Dataset]) -> DataFrame:
    """All rows of all datasets under their sample ids."""
    out = None
    for i, dataset in enumerate(datasets):
        rows = dataset.load(spark)
        # A row for each shard goes to all tasks; joined as exchanges, the rows of a shard would meet in one.
        one = rows.join(F.broadcast(shard_index(rows).select("_shard", "shard_id")), "_shard").drop("_shard").select(F.lit(i).alias("dataset_id"), "shard_id", "local_id", *[c for c in rows.columns if c not in ("_shard", "local_id")])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one dataset is needed")
    return out
