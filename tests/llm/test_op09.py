import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import op09_suffix_dedup as op
from millrace.llm.suffixes import suffix_order
from millrace.llm.superkmers import with_spans


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_order(text):
    text = [*text, 0]
    assert suffix_order(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs, length):
    seen = Counter(t[i : i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        n_spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for i, b in enumerate(t) if not gone[i + 1])
        out.append((d, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, docs, length, gram):
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, stop long").repartition(3)
    rows = with_spans(df, op.repeated(spark, df, length, gram), ["doc_id"]).mapInArrow(op._kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, rows), key=key), sorted(brute([(d, (t or "").encode()) for d, t in docs], length), key=key)


def test_against_brute_force(spark):
    rng = random.Random(3)
    for length, gram in ((20, 4), (33, 5)):
        passages = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(10, 90))) for _ in range(10)]
        docs = [(i, "".join(p if rng.random() < 0.7 else p[: rng.randrange(len(p))] + "#" + str(i) for p in rng.choices(passages, k=rng.randrange(5)))) for i in range(60)]
        docs += [(None, docs[3][1]), (7, docs[7][1]), (90, None), (91, ""), (92, "ab" * 60), (93, "x" * 70), (94, "x" * 19), (95, "q" * 20)]
        got, want = run(spark, docs, length, gram)
        assert got == want and sum(r[2] for r in got) > 300


def test_production_length(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    base = word(700)
    docs = [(i, word(rng.randrange(50)) + base[i : 390 + i + rng.randrange(40)] + word(5)) for i in range(60)] + [(99, word(450) * 2)]
    got, want = run(spark, docs, op.LENGTH, op.GRAM)
    assert got == want and sum(r[2] for r in got) > 500
    assert run(spark, [], op.LENGTH, op.GRAM) == ([], [])
