import json

import zstandard

from millrace.__main__ import main
from millrace.sources import mds
from millrace.sources.readers import Dataset, samples

NAMES, KINDS = ["id", "score", "text", "raw"], ["int", "float32", "str", "bytes"]


def folder(path, compressed=False):
    shards = []
    for s in range(3):
        rows = [{"id": 10 * s + i, "score": i / 2, "text": "é" * i, "raw": bytes([s, i])} for i in range(s + 2)]
        data, base = mds.write_shard(rows, NAMES, KINDS), f"shard.{s:05}.mds"
        one = {"column_names": NAMES, "column_encodings": KINDS, "column_sizes": [8, 4, None, None], "raw_data": {"basename": base}, "samples": len(rows)}
        if compressed:
            data, base = zstandard.compress(data), base + ".zstd"
            one |= {"zip_data": {"basename": base}, "compression": "zstd:3"}
        (path / base).write_bytes(data)
        shards.append(one)
    (path / "index.json").write_text(json.dumps({"version": 2, "shards": shards}))


def test_round_trip(spark, tmp_path):
    for compressed in (False, True):
        path = tmp_path / str(compressed)
        path.mkdir()
        folder(path, compressed)
        got = samples(spark, [Dataset.from_path("m", str(path), fmt="mds")]).orderBy("shard_id", "local_id").collect()
        assert [(r.shard_id, r.local_id, r.id, r.score, r.text, bytes(r.raw)) for r in got] == [(s, i, 10 * s + i, i / 2, "é" * i, bytes([s, i])) for s in range(3) for i in range(s + 2)]


def test_index_command(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [s["rows"] for s in main(["index", str(tmp_path / "p"), "--format", "parquet"])["shards"]] == [7]
