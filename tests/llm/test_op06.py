import hashlib
import random
import re

from millrace.llm import op06_substrings as op
from millrace.llm.superkmers import with_spans


def brute(docs, window):
    texts = [(d if d is not None else 2**63 - 1, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, w), (name, _) in zip(texts, docs, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def run(spark, docs, window, gram):
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, first long").repartition(3)
    rows = with_spans(df, op.repeated(spark, df, window, gram), ["doc_id"]).mapInArrow(op._kept, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, rows), key=key), sorted(brute(docs, window), key=key)


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [w for _ in range(rng.randrange(4)) for w in rng.choice(passages)]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(parts) + rng.choice(["", " ", "\n"])))
    docs += [(None, docs[3][1]), (7, docs[7][1]), (7, docs[8][1]), (90, None), (91, ""), (92, "a " * 300), (93, "a " * 200), (94, "é" * 9 + " ü a" * 30)]
    got, want = run(spark, docs, 8, 3)
    assert got == want and sum(r[2] for r in got) > 300


def test_production_window(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(70)]
    docs = [(i, " ".join([word() for _ in range(rng.randrange(30))] + base[i % 5 : 49 + i % 7 + i % 13] + [word()])) for i in range(120)]
    got, want = run(spark, docs, op.WINDOW, op.GRAM)
    assert got == want and sum(r[2] for r in got) > 500
    assert run(spark, [], op.WINDOW, op.GRAM) == ([], [])
