from itertools import count, islice

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import kernels, lanes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bins", [kernels.fit_bins, kernels.wrap_bins, kernels.best_fit_wrap_bins])
def test_bins_leave_before_the_group_ends(bins):
    """Of a stream without an end only what waits is held."""
    first = list(islice(bins((3 + i * 7 % 11 for i in count()), 16), 500))
    seen = [n for parts in first for n, _, _ in parts]
    assert max(seen) < 2000 and all(sum(z - a for _, a, z in parts) <= 16 for parts in first)


@pytest.mark.parametrize("algorithm", ["first_fit", "best_fit", "best_fit_wrap", "wrap"])
def test_groups_of_a_partition_stay_apart(spark, algorithm):
    """Many groups, one of them long, domains with null and NaN: as the kernel packs each by itself."""
    kernel = {"first_fit": kernels.pack_fit, "best_fit": lambda n, c: kernels.pack_fit(n, c, best=True), "best_fit_wrap": kernels.pack_best_fit_wrap, "wrap": lambda n, c: kernels.pack_wrap(n, c, 3)}[algorithm]
    domains = [None, float("nan"), 0.5, 2.0]
    rows = [(i % 3, i // 12, i % 12, 0, 0, i, domains[0 if i > 600 else i % 4], 1 + i * 13 % 41) for i in range(12000)]
    df = spark.createDataFrame(rows, "lane_id int, chunk_id long, chunk_offset long, dataset_id int, shard_id long, local_id long, d double, n long").repartition(5)
    got = lanes.pack(df, 32, length="n", algorithm=algorithm, homogeneity=F.col("d"), flush_every=0, max_sequences_per_bin=3 if algorithm == "wrap" else None)
    found = {}
    for r in got.collect():
        found.setdefault((r.lane_id, str(r.domain), r.bin), []).append((r.seg, r.local_id, r.start, r.stop))
    want = {}
    for key in {(r[0], str(r[6])) for r in rows}:
        own = [r for r in rows if (r[0], str(r[6])) == key]
        for b, parts in enumerate(kernel([r[7] for r in own], 32)):
            want[(*key, b)] = [(s, own[i][5], a, z) for s, (i, a, z) in enumerate(parts)]
    assert {k: sorted(v) for k, v in found.items()} == want


@pytest.mark.parametrize("name", ["pack_first_fit", "pack_homogeneous_groups", "pack_best_fit_wrap", "dropped_samples"])
def test_no_group_is_gathered(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert plan.count("MapInArrow") == (2 if name == "pack_best_fit_wrap" else 1)
