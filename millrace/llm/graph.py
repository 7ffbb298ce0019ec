"""Connected components over link tables, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest
    node reachable. Labels spread over links and jump along themselves, so the
    number of rounds follows the logarithm of a chain's length."""
    both = stored(spark, links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = lower.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = stored(spark, lower.join(up, "comp").select("node", F.least("comp", "top").alias("comp"), "old"))
        moved = jumped.where("comp <> old").limit(1).count()
        discard(spark, labels)
        labels = jumped.select("node", "comp")
        if not moved:
            discard(spark, both)
            return labels
