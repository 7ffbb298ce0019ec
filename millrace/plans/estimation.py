"""Token ratios for a mixture by tokens: pinned, measured on all rows, or
estimated on a sample of draws."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import stable_hash


@dataclass(frozen=True)
class TokenEstimation:
    """``primer``: "measure", a ratio for all datasets, or one for each."""

    primer: str | float | Mapping[str, float] = "measure"
    calibration_samples: int = 2048
    calibration_shards_min: int = 4
    calibration_shards_max: int = 16
    fallback_tokens_per_byte: float = 0.25
    full_scan: bool = True
    seed: int = 0

    def ratio(self, name: str, rows: DataFrame, tokens: Column, size: Column) -> float:
        """Tokens for each byte of a dataset's rows (_shard, local_id, payload)."""
        if isinstance(self.primer, Mapping):
            return float(self.primer[name])
        if not isinstance(self.primer, str):
            return float(self.primer)
        if self.primer != "measure":
            raise ValueError(f"primer is 'measure', a number or a mapping, not {self.primer!r}")
        sized = rows.withColumn("_b", size.cast("long"))
        if self.full_scan:
            got = sized.withColumn("_t", tokens.cast("long")).agg(F.sum("_t").alias("t"), F.sum("_b").alias("b")).first()
            return got.t / got.b if got.b and got.t is not None else self.fallback_tokens_per_byte
        return self._sampled(sized, tokens)

    def shards(self, per: DataFrame) -> int:
        """How many shards to scan: more if bytes a row vary between shards."""
        got = per.agg(F.sum("rows").alias("n"), (F.sum("bytes") / F.sum("rows")).alias("mean"), F.sum(F.col("bytes") * F.col("bytes") / F.col("rows")).alias("square"), F.count(F.lit(1)).alias("k")).first()
        if not got.n or not got.mean:
            return 0
        spread = math.sqrt(max(0.0, got.square / got.n - got.mean**2)) / got.mean
        wanted = min(self.calibration_shards_max, max(self.calibration_shards_min, math.ceil((spread / 0.03) ** 2)))
        return min(wanted, got.k)

    def _sampled(self, sized: DataFrame, tokens: Column) -> float:
        """Mean of tokens / bytes over draws with replacement by bytes, which
        estimates all tokens / all bytes without bias."""
        per = sized.groupBy("_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("_b").alias("bytes"))
        n = self.shards(per)
        chosen = per.orderBy(stable_hash(self.seed, F.col("_shard")), "_shard").limit(n)
        before = F.coalesce(F.sum("bytes").over(W.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offset = chosen.withColumn("_first", before)  # a row for each scanned shard
        total = offset.agg(F.sum("bytes")).first()[0] if n else 0
        if not total:
            return self.fallback_tokens_per_byte
        end = F.sum("_b").over(W.partitionBy("_shard").orderBy("local_id").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_first")
        placed = sized.where("_b > 0").join(F.broadcast(offset.select("_shard", "_first")), "_shard").withColumn("_end", end)
        # Draw j lands on byte hash(j) mod total; a row gets as many draws as land in it.
        marks = sorted(int(stable_point(self.seed, j) % total) for j in range(self.calibration_samples))
        table = F.array(*[F.lit(m).cast("long") for m in marks])
        hits = F.size(F.filter(table, lambda m: (m >= F.col("_end") - F.col("_b")) & (m < F.col("_end"))))
        got = placed.withColumn("_n", hits).where("_n > 0").withColumn("_t", tokens.cast("double")).agg(F.sum(F.col("_n") * F.col("_t") / F.col("_b")).alias("r"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_n"))).alias("n")).first()
        if not got.n or got.n < self.calibration_samples / 2:
            return self.fallback_tokens_per_byte
        return got.r / got.n


def stable_point(seed: int, j: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.md5(f"{seed}:{j}".encode()).digest()[:8], "big")
