import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions import text
from millrace.sources import ranks

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_places_by_hand(spark, rows):
    ends = [-(2**63), -(2**63) + 1, 2**63 - 1]
    values = [*range(-30, 200), *[10**12 + i * i for i in range(60)], *ends]
    data = [(v, f"g{v % 3}" if v % 7 else None) for v in values]
    df = spark.createDataFrame(data, "id long, g string").repartition(3)
    begins = ranks.cuts(df, "id", rows)
    got = ranks.ranked(df, ["id"], {"all": [], "own": ["g"]}, begins=begins).collect()
    assert len(got) == len(data) and (rows > len(data)) == (not begins)
    assert {r.id: r["all"] for r in got} == {v: i for i, v in enumerate(sorted(values))}
    for g in {g for _, g in data}:
        assert {r.id: r.own for r in got if r.g == g} == {v: i for i, v in enumerate(sorted(v for v, k in data if k == g))}


def test_stretches_are_small_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias("id"))  # far from even
    begins = ranks.cuts(df, "id", 2)
    assert len(begins) > ranks.SIDE
    per = df.groupBy(ranks.stretch("id", begins).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("s").collect()
    assert max(r.n for r in per) <= 20
    assert all(x.b < y.a for x, y in zip(per, per[1:], strict=False))


def test_no_window_sees_a_whole_lane(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", 50)
    for df in (queries.tokenized(spark, SF), queries.corpus(spark, SF)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
        assert windows and all("_stretch" in line for line in windows)


def test_lengths_hash_no_word(spark):
    for name in ("packing_efficiency", "exactly_once_audit", "dropped_samples", "pack_first_fit", "pack_best_fit_wrap", "split_long_shuffle"):
        assert "md5(cast(lambda" not in queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name
    assert "md5(cast(lambda" in queries.pack_wrap(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_split_by_a_length(spark):
    rows = text.tokenize(spark.createDataFrame([("a b c d",), ("",), ("a b",)], "text string")).withColumn("n", F.size("input_ids"))
    got = text.split_long(rows, 4, length="n").collect()
    assert [(r.lineage, len(r.input_ids), r.n) for r in got] == [([0], 4, 4), ([1], 2, 2), ([], 2, 2), ([], 4, 4)]
    assert {r.n for r in text.split_long(rows, 4, length="n", padding=True).collect()} == {4}


def test_rows_of_a_shard_dont_meet_in_a_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("parquet_ordinals", "block_order"):
            plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
