import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import chat, text, training
from millrace.operators import lanes
from millrace.pipeline import Options, Pipeline, WorkSource
from millrace.plans import mixture
from millrace.sources.readers import Dataset, detect_format, samples, shard_index
from millrace.validation import conserved, invariant, lint, ordered, preflight, same_rows

IDS = "lane_id int, chunk_id long, chunk_offset long, dataset_id int, shard_id long, local_id long"


def lane_rows(spark, n, extra="input_ids array<bigint>", value=lambda i: [i] * (1 + i % 5), lanes_=2):
    rows = [(i % lanes_, i // lanes_ // 4, i // lanes_ % 4, 0, 0, i, value(i)) for i in range(n)]
    return spark.createDataFrame(rows, f"{IDS}, {extra}")


def first(df):
    return df.first()[0]


def test_decode(spark):
    df = spark.createDataFrame([(b"a\r\nB\rc\n", 5, None)], "text binary, n int, other string")
    assert text.decode_text(df, ("text", "n", "other", "absent"), lowercase=True).first()[:] == ("a\nb\nc\n", "5", None)


def test_tokenize_edges(spark):
    df = spark.createDataFrame([("a b c d",), ("",), ("  ",)], "text string")
    ids = [r.input_ids for r in text.tokenize(df).collect()]
    assert [len(i) for i in ids] == [6, 2, 2] and ids[1] == [1, 2]
    cut = text.tokenize(df, max_length=4, truncation=True, padding=True).collect()
    assert [len(r.input_ids) for r in cut] == [4, 4, 4] and cut[0].input_ids[-1] == 2 and cut[1].attention_mask == [1, 1, 0, 0]
    assert len(text.tokenize(df, max_length=2, padding=True).first().input_ids) == 6
    null = spark.createDataFrame([(None,)], "text string")
    assert text.tokenize(null, missing_field="empty").first().input_ids == [1, 2]
    with pytest.raises(Exception, match="missing"):
        text.tokenize(null).collect()
    split = text.split_long(text.tokenize(df), 4, padding=True).collect()
    assert [(r.lineage, len(r.input_ids)) for r in split] == [([0], 4), ([1], 4), ([], 4), ([], 4)]
    exact = text.split_long(text.tokenize(spark.createDataFrame([("a b",)], "text string")), 4).collect()
    assert len(exact) == 1 and exact[0].lineage == []


CHATS = {
    "no user": [("system", "s"), ("assistant", "a")],
    "assistant first": [("assistant", "a0"), ("user", "u1"), ("assistant", "a1")],
    "unanswered": [("user", "u1"), ("assistant", "a1"), ("user", "u2")],
    "two": [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("assistant", "b1"), ("user", "u2"), ("assistant", "a2 x")],
    "empty": [],
}


def chats(spark):
    return spark.createDataFrame([(k, [{"role": r, "content": c} for r, c in v]) for k, v in CHATS.items()], "name string, messages array<struct<role:string,content:string>>")


def test_expand(spark):
    got = sorted((r.name, r.ordinal, len(r.messages), r.lineage) for r in chat.expand_chat(chats(spark)).collect())
    assert got == [("assistant first", 0, 3, []), ("two", 0, 4, [0]), ("two", 1, 6, [1]), ("unanswered", 0, 2, [])]


def test_loss_scopes(spark):
    def masks(scope, **options):
        rows = chat.tokenize_chat(chats(spark).where("name = 'two'"), scope=scope, **options).collect()
        return rows[0].loss_mask if rows else None

    # s | u1 | a1 eos | b1 eos | u2 | a2 x eos
    assert masks("all_assistant") == [0, 0, 1, 1, 1, 1, 0, 1, 1, 1]
    assert masks("last_span") == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert masks("after_last_user") == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert masks("all_tokens") == [0] + [1] * 9
    assert masks("all_assistant", special_tokens="bos_eos") == [0, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1]
    with pytest.raises(Exception, match="supervised"):
        chat.tokenize_chat(chats(spark).where("name = 'assistant first'")).collect()
    assert chat.tokenize_chat(chats(spark).where("name = 'empty'")).count() == 0
    shown = chat.render_chat(chats(spark).where("name = 'unanswered'"), begin="[{role}]", end=";").first()
    assert shown.text == "[user]u1;[assistant]a1;[user]u2;" and [shown.text[s.start : s.stop] for s in shown.spans] == ["u1", "a1", "u2"]


def test_training_columns(spark):
    df = spark.createDataFrame([([5, 6, 2, 7, 8, 0], [0, 1, 2, 0, 1, 0], 5, [0, 1, 1, 0, 1, 0])], "input_ids array<bigint>, positions array<int>, total int, mask array<tinyint>")
    r = training.to_training(df, real="total", position_column="positions", supervision="mask", mask_segment_starts=True, eos_mask_loss=True).first()
    assert r.input_ids == [5, 6, 2, 7, 8] and r.labels == [6, 2, -100, 8, -100]
    assert r.loss_mask == [1, 1, 0, 1, 0] and r.num_valid_tokens == 3
    assert r.document_ids == [1, 1, 1, 2, 2] and r.cu_seqlens == [0, 3, 5] and r.max_seqlen == 3 and r.padding_mask == [False] * 5
    p = training.to_training(df.drop("mask"), real="total", position_column="positions", return_labels=False, pad_to_length=8).first()
    assert p.input_ids == [5, 6, 2, 7, 8, 0, 0, 0] and p.document_ids == [1, 1, 1, 2, 2, 0, 0, 0] and p.padding_mask[4:] == [False, True, True, True]
    extra = training.to_training(df.select("input_ids", F.transform("input_ids", lambda x: x * 10).alias("w")), pad_to_length=7, extra_fields=("w",)).first()
    assert extra.w == [50, 60, 20, 70, 80, 0] and len(extra.input_ids) == 6
    empty = training.to_training(spark.createDataFrame([([0, 0, 0], 0)], "input_ids array<bigint>, n int"), real="n").first()
    assert empty.labels == [-100, -100] and empty.padding_mask == [True, True]
    with pytest.raises(Exception, match="pad_to_length"):
        training.to_training(df, pad_to_length=3).collect()
    assert training.renamed(df, {"input_ids": "positions", "positions": "input_ids"}, ("mask",)).columns == ["positions", "input_ids", "total"]
    with pytest.raises(ValueError):
        training.renamed(df, {"input_ids": "total"})
    flat = training.flatten_batches(spark.createDataFrame([(0, 1, [3]), (0, 0, [1, 2])], "b int, slot int, x array<int>"), ["b"], ["slot"], ["x"])
    assert flat.first().x == [1, 2, 3]


def test_files(spark, tmp_path):
    for name, rows in (("b", ["x", "y"]), ("a", ["p", None, "q", "r"])):
        lines = [json.dumps({"text": r, "k": i}) if r is not None else "   " for i, r in enumerate(rows)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n")
    data = Dataset.from_path("d", str(tmp_path), fmt="jsonl", schema="text string, k int")
    got = sorted((r.shard_id, r.local_id, r.text) for r in samples(spark, [data]).collect())
    assert got == [(0, 0, "p"), (0, 1, "q"), (0, 2, "r"), (1, 0, "x"), (1, 1, "y")]
    assert detect_format(["z/a.parquet"]) == "parquet" and detect_format(["a.jsonl.gz", "b.parquet"]) == "jsonl"
    with pytest.raises(ValueError):
        detect_format(["a.unknown"])
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "p"))
    rows = Dataset.from_path("p", str(tmp_path / "p")).load(spark)
    assert shard_index(rows).agg(F.sum("num_rows")).first()[0] == 10
    memory = Dataset.from_dict("m", {0: [{"text": "a"}, {"text": "b"}], 1: []})
    assert [(r.dataset_id, r.local_id, r.text) for r in samples(spark, [memory]).orderBy("local_id").collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert samples(spark, [Dataset.from_dict("e", {})]).count() == 0


def memory(name, shards):
    return Dataset.from_dict(name, {s: [{"text": f"{name}:{s}:{i}"} for i in range(n)] for s, n in enumerate(shards)})


def source(**options):
    return WorkSource([memory("a", [9, 11]), memory("b", [5, 0, 7])], {"a": 3, "b": 1}, chunk_size=8, seed=2, **{"exhausted_policy": "redistribute", "shuffle_block_size": 4, **options})


def test_plan_is_whole_and_elastic(spark):
    out = {}
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        p = Pipeline.of(spark, source(), Options(canonical_replicas=3))
        rows = p.frame().orderBy("lane_id", "chunk_id", "chunk_offset").collect()
        out[parts] = [(r.lane_id, r.chunk_id, r.chunk_offset, r.text) for r in rows]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out["2"] == out["7"] and len({r[3] for r in out["2"]}) == 32
    # Groups of lanes see what one group sees.
    per = [r.text for g in (0, 1) for r in Pipeline.of(spark, source(), Options(canonical_replicas=3, dp_degree=2, dp_group_id=g)).frame().collect()]
    assert sorted(per) == sorted(r[3] for r in out["2"])


def test_repeat_reshuffles(spark):
    p = source(exhausted_policy="repeat", stop_after_passes=2).plan(spark, 1)
    counts = p.groupBy("dataset_id", "shard_id", "local_id").count()
    assert counts.agg(F.min("count")).first()[0] >= 2
    order = {turn: [r.local_id for r in p.where(f"dataset_id = 1 and pass = {turn}").orderBy("global_chunk", "chunk_offset").collect()] for turn in (0, 1)}
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1])
    with pytest.raises(ValueError):
        mixture.lanes(spark, 4, 2, "other")


def test_resume_equals_uninterrupted(spark):
    def run():
        return Pipeline.of(spark, source(), Options(canonical_replicas=2, seed=3)).tokenize().shuffle(8)

    whole = sorted((r.lane_id, r.ordinal, r.text) for r in run().ordered().collect())
    saved = run().checkpoint(F.col("ordinal") < 5 + F.col("lane_id"))
    rest = sorted((r.lane_id, r.ordinal, r.text) for r in run().restore(saved).ordered().collect())
    assert rest == [r for r in whole if r[1] >= 5 + r[0]]
    with pytest.raises(ValueError):
        Pipeline.of(spark, source(), Options(canonical_replicas=2, seed=4)).tokenize().shuffle(8).restore(saved)


def test_builder_end_to_end(spark):
    p = Pipeline.of(spark, source(), Options(canonical_replicas=2)).decode_text().tokenize().shuffle(16).pack_flat(16, algorithm="best_fit").to_training(mask_segment_starts=True)
    rows = list(p)
    assert [r.ordinal for r in rows if r.lane_id == 0] == list(range(sum(r.lane_id == 0 for r in rows)))
    assert all(len(r.input_ids) == 15 and len(r.labels) == 15 for r in rows)
    assert sum(s.stop - s.start for r in rows for s in r.segments) == 32 * 3
    assert "pack_flat" in p.explain() and p.fingerprint() == p.fingerprint()
    with pytest.raises(ValueError):
        Pipeline.of(spark, source()).batch(4).map_transform(lambda d: d)
    with pytest.raises(ValueError):
        Pipeline.of(spark, source()).map_batch(lambda d: d)


@pytest.mark.parametrize("algorithm", ["first_fit", "best_fit", "wrap", "best_fit_wrap"])
def test_packed_tokens(spark, algorithm):
    df = lane_rows(spark, 60)
    parts = lanes.pack(df, 8, algorithm=algorithm, flush_every=2)
    got = lanes.filled(parts, df, 8, pad_token_id=-1).collect()
    kept = sorted(x for r in got for x in r.input_ids if x != -1)
    every = sorted(i for i in range(60) for _ in range(1 + i % 5))
    assert kept == every if algorithm != "wrap" else set(kept) <= set(every)
    assert all(len(r.input_ids) == 8 == len(r.positions) and r.total_length + r.padding_length == 8 for r in got)
    assert conserved(df, lanes.contributors(parts)).ok


def test_capped_wrap_and_oversize(spark):
    df = lane_rows(spark, 10, value=lambda i: [i] * 10)
    parts = lanes.pack(df, 8, algorithm="wrap", max_sequences_per_bin=1, flush_every=0)
    assert parts.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == 100
    assert lanes.pack(df, 8).count() == 0
    with pytest.raises(Exception, match="max_length"):
        lanes.pack(df, 8, drop_oversized=False).collect()


def test_batches_and_delivery(spark):
    df = lanes.in_lane(lane_rows(spark, 23, lanes_=3))
    kept = lanes.batch(df, 3)
    assert kept.count() == 2 * 9 and kept.groupBy("lane_id", "batch_id").count().where("count <> 3").count() == 0
    assert lanes.batch(df, 3, drop_last=False).count() == 23
    got = [(r.lane_id, r.ordinal) for r in lanes.round_robin(df).orderBy("delivery").collect()]
    left, want, at = {0: 8, 1: 8, 2: 7}, [], {0: 0, 1: 0, 2: 0}
    while any(at[lane] < left[lane] for lane in left):
        for lane in left:
            if at[lane] < left[lane]:
                want.append((lane, at[lane]))
                at[lane] += 1
    assert got == want
    assert lanes.check_world(24, 4, 2, 3) == 6
    for bad in ((24, 5, 2, 3), (25, 4, 2, 3), (24, 4, 2, 4)):
        with pytest.raises(ValueError):
            lanes.check_world(*bad)


def _unstable(x):
    import random

    return random.random()


def test_state_and_checks(spark):
    df = lane_rows(spark, 40)
    counted = lanes.stateful(df.drop("input_ids"), lambda: [0], lambda s, r: s.__setitem__(0, s[0] + 1) or [{"n": s[0]}], None, "n long", flush_every=2)
    assert sorted(r.n for r in counted.collect()) == sorted([*range(1, 9), *range(1, 9), *range(1, 5)] * 2)
    assert ordered(lanes.in_lane(df)).ok
    assert lint(_unstable) and not lint(lane_rows)
    assert invariant(lambda d: lanes.shuffle(d, 4, algorithm="block", flush_every=2), df).ok
    bad = invariant(lambda d: d.withColumn("p", F.spark_partition_id()), df)
    assert not bad.ok
    assert not same_rows(df, df.limit(3)) and preflight({"words": lambda t: [1]}).ok and not preflight({"no": lambda t: 1 / 0}).ok
    drift = lanes.drift(df.withColumn("component_id", F.col("lane_id")), {0: 1.0, 1: 0.5}).collect()
    assert all(r.actual == 1.0 for r in drift)


def test_metrics(spark):
    from millrace.observability import Metrics

    metrics = Metrics()
    df = metrics.observe("in", lane_rows(spark, 10), tokens="input_ids", lanes=F.max("lane_id"))
    metrics.observe("kept", df.where("local_id < 4")).collect()
    assert metrics.snapshot() == {"in": {"rows": 10, "tokens": 30, "lanes": 1}, "kept": {"rows": 4}}


def test_streams(spark, tmp_path):
    from millrace.streaming.runner import over_chunks, running_counts

    spark.createDataFrame([(i, f"u{i % 3}") for i in range(9)], "i long, u string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, u string").parquet(str(tmp_path / "in"))
    q = running_counts(stream, "u").writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.u, r.n) for r in spark.sql("select * from counts").collect()) == [("u0", 3), ("u1", 3), ("u2", 3)]
    out = []
    chunks = spark.readStream.schema("i long, u string").parquet(str(tmp_path / "in")).selectExpr("i as g")
    q = over_chunks(spark, lambda d: mixture.lanes(spark, d, 2, "modulo"), lambda d, n: out.extend(d.collect()), checkpoint=str(tmp_path / "c2"), chunks=chunks)
    q.processAllAvailable()
    q.stop()
    assert sorted((r.g, r.lane_id) for r in out) == [(i, i % 2) for i in range(9)]


def test_children_are_records_of_their_own(spark):
    """After a fan-out nothing is multiplied or lost."""
    df = lane_rows(spark, 24, value=lambda i: list(range(10 * i, 10 * i + 10))).withColumn("component_id", F.col("lane_id"))
    children = text.split_long(df, 4)
    n = 24 * 3
    for algorithm in ("streaming", "block", "block_warmup"):
        out = lanes.shuffle(children, 8, algorithm=algorithm, flush_every=2)
        assert out.count() == n and out.select("lane_id", "ordinal").distinct().count() == n
    assert lanes.ensure_mixture(children, {0: {0: 0.5, 1: 0.5}}, flush_every=2).count() == n
    for algorithm in ("first_fit", "best_fit", "best_fit_wrap"):
        parts = lanes.pack(children, 8, algorithm=algorithm, flush_every=2)
        rows = lanes.filled(parts, children, 8, pad_token_id=-1).collect()
        assert sorted(x for r in rows for x in r.input_ids if x >= 0) == list(range(240)) and all(r.total_length <= 8 for r in rows)
        assert conserved(df, lanes.contributors(parts)).ok and lanes.exactly_once(df, lanes.contributors(parts)).where("closed <> 1").count() == 0
    assert lanes.in_lane(children).select("lane_id", "ordinal").distinct().count() == n
    assert lanes.dropped(children, lanes.pack(children, 3)).count() == 48


def test_source_that_ends():
    from millrace.operators import kernels as k

    records = [k.Weighed(((c, 1.0),), chunk) for chunk, cs in enumerate([[0, 1, 1, 1], [1, 1]]) for c in cs]
    targets = {0: {0: 0.5, 1: 0.5}, 1: {0: 0.5, 1: 0.5}}
    # Without the stamp component 1 waits for records of 0 that never come, and is lost without a bound.
    assert k.ensure_mixture(records, targets, None) == [0, 1]
    assert k.ensure_mixture(records, targets, None, ended={0: frozenset([0])}) == [0, 1, 2, 3, 4, 5]
    # The last component of a target stays in it.
    assert k.ensure_mixture(records, targets, None, ended={0: frozenset([0]), 1: frozenset([1])}) == [0, 1, 2, 3, 4, 5]


def test_order_audit_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(lanes, "_STRETCH", 4)
    df = lanes.in_lane(lane_rows(spark, 40))
    assert lanes.out_of_order(df).count() == 0
    turned = df.withColumn("ordinal", 19 - F.col("ordinal"))
    assert lanes.out_of_order(turned).count() == 2 * 19
