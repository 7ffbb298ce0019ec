from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from millrace.llm import common

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = common.documents(spark, SF)
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = common.stored(spark, stage(spark, docs, SF))
        if i < len(pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
            docs = out
            sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] > 0.7 * sizes[0] and sizes[-1] == sizes[-2]
    assert out.select("doc_id").distinct().count() == sizes[-1]
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    bins = defaultdict(int)
    for r in out.collect():
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024
    total = sum(bins.values())
    assert len(bins) <= -(-total // 1024) * 1.02 + 1
    again = pipeline.run(spark, SF)
    assert again.count() == out.count() and sorted(map(tuple, again.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, out.select("doc_id", "piece", "ids_crc32").collect()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, k):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words of text here", "en", None, 5), (4, "x " * 3000, "en", "s", 6000), (4, "x " * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.count() >= 0
    if k < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_other_columns(spark, k):
    """Names that stages use themselves, a dotted one, and a map."""
    names = ["items", "spans", "n_words", "_text", "_doc", "_key", "_base", "_spans", "_nth", "row", "stats", "runs", "base", "_null", "_rank", "a.b"]
    docs = common.documents(spark, SF).limit(120)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names], "map(lang, doc_id) AS m")
    name, stage = pipeline.STAGES[k]
    out = stage(spark, wide, SF)
    plain = stage(spark, docs, SF)
    if k < 4:
        assert out.dtypes == wide.dtypes
        rows = out.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names) and all(r.m == {r.lang: r.doc_id} for r in rows)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    else:
        assert sorted(r[:5] for r in map(tuple, out.collect())) == sorted(r[:5] for r in map(tuple, plain.collect()))
