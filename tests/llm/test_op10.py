import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import op10_pack as op


def check(counts, fillings, capacity):
    used = defaultdict(int)
    for filling, times in fillings:
        assert sum(filling) <= capacity and times > 0
        for n in filling:
            used[n] += times
    assert dict(used) == {n: c for n, c in counts.items() if c}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=10))
def test_search_is_whole_and_no_worse_than_best_fit(counts):
    found = op.complete(counts, 24)
    check(counts, found, 24)
    check(counts, op.best_fit(counts, 24), 24)
    assert sum(t for _, t in found) <= sum(t for _, t in op.best_fit(counts, 24))


def test_beats_best_fit_where_it_fails():
    counts = {n: 1 for n in ()} | {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}
    assert sum(t for _, t in op.complete(counts, 20)) == 2
    counts = {100: 1, 98: 1, 96: 1, 93: 1, 91: 1, 87: 1, 81: 1, 59: 1, 58: 1, 55: 1, 50: 1, 43: 1, 22: 1, 21: 1, 20: 1, 15: 1, 14: 1, 10: 1, 8: 1, 6: 1, 5: 1, 4: 1, 3: 1, 1: 1}
    found = op.complete(counts, 100)
    check(counts, found, 100)
    assert sum(t for _, t in found) == -(-sum(counts) // 100)


def test_ids_equal_whole_text_encoding():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = ["a", "B", "don't", " ", "  ", "\n", "\t", "é", " ", "　", "12", "...", "'s", "\r\n", "\x1c", "日本", "<|endoftext|>", "🙂", " "]
    assert model.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", " ", "a", "a ", " a  b\n\n c "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    encoder = op.Encoder()
    got = [encoder.encode(t).tolist() for t in texts]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_round_trip(spark):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = {i: " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice([1, 5, 200, 900, 3000]))) for i in range(40)} | {90: None, 91: "", 92: "x"}
    rows = [(k, v, "z") for k, v in texts.items()] + [(92, "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = op.pack(spark, docs).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        ids = np.array([*model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.length) == op.pieces_of(len(ids))[r.piece] and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(out) == sum(len(op.pieces_of(len(model.encode(t or "", add_special_tokens=False).ids) + 1)) for _, t, _ in rows)
    assert op.pack(spark, docs.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=6), st.integers(1, 16))
def test_completions_are_the_undominated_fillings(counts, gap):
    from itertools import product

    def dominated(filling):
        waste = gap - sum(filling)
        free = {n for n in counts if counts[n] > filling.count(n)}
        return any(n <= waste for n in free) or any(y < x <= y + waste for y in filling for x in free)

    names = sorted(counts, reverse=True)
    every = [tuple(n for n, k in zip(names, ks, strict=True) for _ in range(k)) for ks in product(*(range(counts[n] + 1) for n in names))]
    want = {f for f in every if sum(f) <= gap and not dominated(f)}
    got = list(op.completions(gap, counts))
    assert len(got) == len(set(got)) and {tuple(sorted(f, reverse=True)) for f in got} == want
    assert [gap - sum(f) for f in got] == sorted(gap - sum(f) for f in got)
