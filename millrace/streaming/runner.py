"""Lanes as streams: micro-batches over chunk ranges, and per-lane state.

A plan is a pure function of its configuration, so a stream of chunk numbers
is enough to drive it; each micro-batch computes its range of chunks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def over_chunks(spark: SparkSession, step: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], *, checkpoint: str, chunks: DataFrame | None = None, rate: int = 1) -> StreamingQuery:
    """Run ``step`` on each new range of global chunk numbers (column g) and
    hand its rows to ``sink`` with the batch number: exactly once if the sink
    overwrites by that number."""
    source = chunks if chunks is not None else spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rate).load().selectExpr("value as g")
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(step(df), n)).start()


def first_of_key(events: DataFrame, key: str, order: str) -> DataFrame:
    """Arrivals of keys not seen before, kept by key across micro-batches."""
    names = events.columns
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in names)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        if not state.exists:
            state.update((1,))
            yield rows.sort_values(order).head(1)[names]

    return events.groupBy(key).applyInPandasWithState(run, schema, "seen int", "append", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Number of arrivals of each key so far, updated with each micro-batch."""
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, n long"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return events.groupBy(key).applyInPandasWithState(run, schema, "n long", "update", GroupStateTimeout.NoTimeout)
