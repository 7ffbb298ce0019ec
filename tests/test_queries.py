import oracle
import pytest

from millrace import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, con, name):
    assert oracle.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_partitioning_changes_nothing(spark):
    from millrace.validation import same_rows

    first = {}
    for n, adaptive in ((1, "false"), (3, "true"), (7, "false")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for name in ("pack_wrap", "shuffle_stream", "chunk_swrr", "pack_best_fit_wrap", "full_plan", "stateful_dedup"):
            got = queries.QUERIES[name](spark, SF)
            if name in first:
                assert same_rows(first[name], got), name
            else:
                first[name] = spark.createDataFrame(got.collect(), got.schema)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
