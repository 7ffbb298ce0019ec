"""Columns that operators exchange, and the order of samples.

A record is known by its place in the plan, by its lineage (which child of a
fan-out it is, of each fan-out in turn; empty for a sample as read) and by the
sample it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = ("dataset_id", "shard_id", "local_id")
POSITION = ("lane_id", "chunk_id", "chunk_offset")
KEY = (*POSITION, "lineage", *SAMPLE)
#: Text form of the lineage that sorts as the lineage does; for kernels.
LINE = "_line"
#: First of these that a table has holds its tokens.
TOKEN_FIELDS = ("input_ids", "tokens", "token_ids", "ids")


def with_lineage(df: DataFrame) -> DataFrame:
    """Rows that no fan-out made have the empty lineage."""
    return df if "lineage" in df.columns else df.withColumn("lineage", F.array().cast("array<int>"))


def line(column: Column | str = "lineage") -> Column:
    """Fixed-width numbers joined by dots: sorts like the array."""
    return F.array_join(F.transform(column, lambda i: F.lpad(i.cast("string"), 10, "0")), ".")


def cursor() -> list[Column]:
    """Total order of records within a lane."""
    return [F.col(n) for n in ("chunk_id", "chunk_offset", "lineage", *SAMPLE)]


def token_field(columns: list[str], wanted: str = "auto") -> str:
    if wanted != "auto":
        return wanted
    for name in TOKEN_FIELDS:
        if name in columns:
            return name
    raise ValueError(f"no token column among {columns}; expected one of {TOKEN_FIELDS}")


def stable_hash(*parts: Column | str | int) -> Column:
    """Hex digest of the parts: the same on every engine and partitioning."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))
