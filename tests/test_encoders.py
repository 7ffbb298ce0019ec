import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import chat, encoders, text


def test_tokens_of_a_batch_are_few_objects_at_once(spark):
    texts = pa.array([" ".join(f"w{(i * j) % 997}" for j in range(100)) for i in range(3000)] + [None, "", " x "])
    run = encoders.word_offsets().func
    tracemalloc.start()
    got = list(run(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 300,000 tokens; as dictionaries they take more than 100 MB
    assert sum(map(len, got)) == len(texts) and max(map(len, got)) <= 256
    last = got[-1].to_pylist()[-3:]
    assert last[:2] == [None, []] and [(t["start"], t["stop"]) for t in last[2]] == [(1, 2)]


def test_offsets_agree_with_ids(spark):
    df = spark.createDataFrame([("a é😀 b\x0bc",), ("",), (None,), ("x " * 5000,)], "text string")
    encode = encoders.word_offsets()
    for r in df.select(encode(F.col("text")).alias("got"), text.word_ids(F.col("text")).alias("want"), "text").collect():
        assert (r.got and [t.id for t in r.got]) == r.want
        assert r.text is None or [r.text[t.start : t.stop] for t in r.got] == [w for w in r.text.replace("\x0b", " ").split(" ") if w]


def test_own_encoder(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string").coalesce(1)
    encode = encoders.encoder(lambda: lambda texts: [[len(c) for c in t] for t in texts])
    assert [r[0] for r in df.select(encode(F.col("text"))).collect()] == [[1, 1], None, []]


def test_long_conversations_are_no_cube(spark):
    n = 1600
    roles = ["assistant" if i % 2 else "user" for i in range(n)]
    df = spark.createDataFrame([([{"role": r, "content": "x"} for r in roles],)], "messages array<struct<role:string,content:string>>")
    for scope in ("after_last_user", "last_span"):
        assert df.select(chat.supervised(F.col("messages"), scope)).first()[0] == [i == n - 1 for i in range(n)]


def test_masks_by_hand(spark):
    tokens = [(i, 3 * i, 3 * i + 2) for i in range(400)]
    spans = [(5 * i, 5 * i + i % 4) for i in range(0, 250, 2)]
    df = spark.createDataFrame([([{"id": i, "start": a, "stop": b} for i, a, b in tokens], [{"start": a, "stop": b} for a, b in s]) for s in (spans, [])], "t array<struct<id:long,start:int,stop:int>>, s array<struct<start:int,stop:int>>")
    got = [r[0] for r in df.select(chat.mask_of_spans(F.col("t"), F.col("s"))).collect()]
    assert got == [[int(any(a < z and b > y for y, z in s)) for _, a, b in tokens] for s in (spans, [])]
