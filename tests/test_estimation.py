from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.functions import text
from millrace.functions.encoders import fast_tokenizer
from millrace.operators import kernels
from millrace.pipeline import Options, Pipeline, WorkSource
from millrace.plans.estimation import TokenEstimation
from millrace.sources.readers import Dataset


def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return Dataset.from_frame("d", docs, "source", ["doc_id"]).load(spark)


def test_ratios(spark):
    df, n, b = rows(spark), F.size(text.words(F.col("text"))), F.octet_length("text")
    exact = TokenEstimation().ratio("d", df, n, b)
    sampled = TokenEstimation(full_scan=False, calibration_samples=400).ratio("d", df, n, b)
    assert abs(sampled / exact - 1) < 0.05
    assert sampled == TokenEstimation(full_scan=False, calibration_samples=400).ratio("d", df.repartition(5), n, b)
    assert TokenEstimation({"d": 0.3}).ratio("d", df, n, b) == 0.3 and TokenEstimation(0.2).ratio("d", df, n, b) == 0.2
    assert TokenEstimation(full_scan=False).ratio("d", df.where("false"), n, b) == 0.25
    with pytest.raises(ValueError):
        TokenEstimation("guess").ratio("d", df, n, b)


def test_trained_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    df = spark.createDataFrame([("a b c",), ("",), ("été",)], "text string")
    got = [r.input_ids for r in text.tokenize(df, ids=fast_tokenizer(path)(F.col("text"))).collect()]
    assert got == [[1, *model.encode(t, add_special_tokens=False).ids, 2] for t in ("a b c", "", "été")]


def test_read_modes(spark):
    assert Counter(kernels.weighted_random([3, 0, 5], 1)) == {0: 3, 2: 5} and kernels.weighted_random([9, 9], 1) != kernels.weighted_random([9, 9], 2)
    data = [Dataset.from_dict(n, {0: [{"text": f"{n}{i}"} for i in range(12)]}) for n in "ab"]
    seen = set()
    for mode, shuffled in (("round_robin", False), ("weighted_random", False), ("round_robin", True)):
        source = WorkSource(data, {"a": 1, "b": 1}, chunk_size=8, exhausted_policy="redistribute", read_mode=mode, shuffle_components=shuffled)
        got = [r.text for r in Pipeline.of(spark, source, Options()).frame().orderBy("chunk_id", "chunk_offset").collect()]
        assert len(set(got)) == 24
        seen.add(tuple(got))
    assert len(seen) == 3
