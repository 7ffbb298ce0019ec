import numpy as np
import pyarrow as pa

from millrace.llm import op01_quality as op
from millrace.llm.textvec import slices


def test_statistics_do_not_depend_on_slices():
    texts = ["", None, "One two. Two!!", "a\nb\na", "É ÀB " * 50, "x" * 3000, "A | b | C\n" * 20]
    column = pa.array(texts)
    whole = np.concatenate([op.statistics(d, e) for _, d, e in slices(column)])
    parts = np.concatenate([op.statistics(d, e) for _, d, e in slices(column, 1)])
    assert whole.shape == (7, len(op.NAMES)) and np.allclose(whole, parts) and np.isfinite(whole).all()
    named = dict(zip(op.NAMES, whole[3], strict=True))
    assert named["distinct_words"] == 2 / 3 and named["distinct_lines"] == 2 / 3 and named["lines_per_word"] == 1


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = op.fit(x, y)
    got = model.score(x)
    assert ((got > 0.5) == y).mean() > 0.97
    for i in range(20):
        raw = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > t[node])
            raw += v[node - len(f)]
        assert abs(1 / (1 + np.exp(-raw)) - got[i]) < 1e-12


def test_without_labels():
    assert (op.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))) == 0.5).all()
    assert (op.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((3, 2))) > 0.9).all()


def test_held_out_accuracy_and_stage(spark):
    sf = "/root/testdata/sf0.01"
    out = op.op1_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "t"), (2, "", "t")], "doc_id long, text string, score string")
    none = labels.where("false")
    assert op.good_documents(spark, docs, none).count() == 3
    assert op.good_documents(spark, docs.where("false"), labels).count() == 0
