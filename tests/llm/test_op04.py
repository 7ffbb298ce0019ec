import random

import numpy as np
import pytest

from millrace.llm import op04_jaccard as op


def sets(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if len(w) >= 4 else {tuple(w)}


def brute(docs):
    s = [sets(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s[i]), low[find(i)]) for i, (d, _) in enumerate(docs))


def family(rng, k):
    word = lambda: "w%d" % rng.randrange(400)
    base = [word() for _ in range(rng.choice([8, 12, 40, 120, 300]))]
    out = []
    for _ in range(k):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + [word() for _ in range(rng.randrange(1 + len(w) // 6))]
        base = w if rng.random() < 0.5 else base
        out.append(" ".join(w).title() if rng.random() < 0.2 else "\n".join(w))
    return out


@pytest.mark.parametrize("frequent", [False, True])
def test_signatures_miss_no_link(frequent):
    rng = random.Random(7)
    classes = np.random.default_rng(1).integers(0, 256, 1 << 20).astype(np.uint8) if frequent else np.zeros(1 << 20, np.uint8)
    for _ in range(400):
        n = rng.choice([7, 8, 13, 14, 20, 60, 130, 500, 1100])
        common = np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 63, n, dtype=np.uint64)
        drop = lambda: common[np.random.default_rng(rng.randrange(1 << 30)).random(n) < rng.uniform(0.88, 1)]
        more = lambda: np.random.default_rng(rng.randrange(1 << 30)).integers(0, 1 << 63, rng.randrange(n // 10 + 1), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([drop(), more()])) for _ in range(2))
        same = len(np.intersect1d(x, y))
        if not np.array_equal(x, y) and 100 * same >= 85 * (len(x) + len(y) - same):
            (a, left), (b, right) = op.signatures(x, classes), op.signatures(y, classes)
            _, i, j = np.intersect1d(a, b, return_indices=True)
            assert (1 + np.minimum(left[i], right[j]) >= same).any()


def test_against_brute_force(spark):
    rng = random.Random(11)
    texts = [t for _ in range(14) for t in family(rng, rng.randrange(1, 9))]
    rng.shuffle(texts)
    docs = list(enumerate(texts)) + [(900, None), (901, " \n"), (902, "one two"), (903, "ONE\ttwo"), (904, "one two three"), (5, texts[5]), (5, texts[6]), (905, "a " * 500), (906, "a " * 300)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, node int").repartition(3)
    got = sorted(tuple(r) for r in op.grouped(spark, df).select("_doc", "n", "component").collect())
    assert got == brute(docs)
    kept = [r.doc_id for r in op.one_of_each(spark, df).collect()]
    want = {c for _, n, c in brute(docs) if n} | {900, 901}
    assert set(kept) == want and len(kept) == len(want)


def test_blocks_of_hot_signatures(spark, monkeypatch):
    """With blocks of two holders the same links are found."""
    rng = random.Random(12)
    docs = list(enumerate(t for _ in range(6) for t in family(rng, rng.randrange(4, 12))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(op, "BLOCK", 2)
    monkeypatch.setattr(op, "_bands", lambda found: op.mix(found[:1].repeat(op._BANDS)))  # few pivots, so that signatures do the work
    got = sorted(tuple(r) for r in op.grouped(spark, df).select("_doc", "n", "component").collect())
    assert got == brute(docs)


def test_null_is_larger_than_any_id(spark, tmp_path):
    last = (1 << 63) - 1
    rows = [(last, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"), (None, ""), (last, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.op4_jaccard(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(last, 3, last), (None, 3, last), (None, 3, None), (None, 0, None), (last, 0, last)]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.grouped(spark, df).count() == 0 and op.one_of_each(spark, df).count() == 0


def _marked(words, marks):
    return " ".join("changed%d" % i if i in marks else w for i, w in enumerate(words))


def test_other_sizes_against_sql(spark):
    """The pipeline's shingle size and similarity, against the same SQL."""
    import duckdb

    import corpus_pipeline
    from millrace.llm import sql

    rng = random.Random(21)
    texts = [t for _ in range(10) for t in family(rng, rng.randrange(2, 8))]
    cut = ["c%d" % i for i in range(500)]
    spaced = ["s%d" % i for i in range(940)]
    docs = list(enumerate(texts)) + [(800, " ".join(cut)), (801, " ".join(cut[:415])), (810, " ".join(spaced)), (811, _marked(spaced, range(20, 940, 47))), (820, "one two three four"), (821, "one two three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    size, least = corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_LEAST
    assert (size, least) == (5, 80)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = sorted(tuple(r) for r in op.grouped(spark, df, size, least).select("_doc", "n", "component").collect())
    assert got == sorted(con.execute(sql.near_copies(size, least)).fetchall())
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert {800, 810, 820, 821} <= kept and not {801, 811} & kept
    assert {801, 811} <= {r.doc_id for r in op.one_of_each(spark, df).collect()}


def test_signatures_at_the_pipeline_similarity():
    rng = np.random.default_rng(5)
    for k in range(300):
        classes = rng.integers(0, 256, 1 << 20).astype(np.uint8) if k % 2 else np.zeros(1 << 20, np.uint8)
        x = np.unique(rng.integers(0, 1 << 63, int(rng.choice([4, 5, 9, 20, 127, 500, 1100])), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.88], rng.integers(0, 1 << 63, int(rng.integers(0, len(x) // 12 + 1)), dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        if len(y) and not np.array_equal(x, y) and 100 * same >= 80 * (len(x) + len(y) - same):
            (a, left), (b, right) = op.signatures(x, classes, 80), op.signatures(y, classes, 80)
            _, i, j = np.intersect1d(a, b, return_indices=True)
            assert (1 + np.minimum(left[i], right[j]) >= same).any()
