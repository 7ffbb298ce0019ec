"""Counts of what passes a stage, gathered while the job runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Metrics:
    """Named observations of a pipeline. They cost no job of their own: values
    are there once an action on the observed frame has run."""

    seen: dict[str, Observation] = field(default_factory=dict)

    def observe(self, name: str, df: DataFrame, tokens: str | None = None, **more: Column) -> DataFrame:
        """Rows (and tokens, and further aggregates) that pass here."""
        if name in self.seen:
            raise ValueError(f"{name!r} is observed already")
        what = [F.count(F.lit(1)).alias("rows")]
        if tokens is not None:
            what.append(F.sum(F.size(tokens).cast("long")).alias("tokens"))
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], *what, *[c.alias(k) for k, c in more.items()])

    def snapshot(self) -> dict[str, dict]:
        """Values by stage; waits for stages whose job has not ended."""
        return {name: dict(o.get) for name, o in self.seen.items()}
