import json

import zstandard

from millrace.sources import litdata
from millrace.sources.readers import Dataset, samples

SPEC = json.dumps([1, {"type": "builtins.dict", "context": json.dumps(["text", "k", "x", "ok", "raw"]), "children_spec": [{"type": None, "context": None, "children_spec": []}] * 5}])


def test_round_trip(spark, tmp_path):
    for compression in (None, "zstd"):
        path = tmp_path / str(compression)
        path.mkdir()
        chunks = []
        for c in range(2):
            rows = [[f"é{c}{i}".encode(), str(i - 1).encode(), str(i / 4).encode(), str(i == 1).encode(), bytes([c, i])] for i in range(3 + c)]
            data = litdata.write_chunk(rows)
            name = f"chunk-0-{c}.bin" if compression is None else f"chunk-0-{c}.zstd.bin"
            (path / name).write_bytes(zstandard.compress(data) if compression else data)
            chunks.append({"filename": name, "chunk_size": len(rows), "chunk_bytes": len(data), "dim": None})
        config = {"compression": compression, "data_format": ["str", "int", "float", "bool", "bytes"], "data_spec": SPEC}
        (path / "index.json").write_text(json.dumps({"chunks": chunks, "config": config}))
        got = samples(spark, [Dataset.from_path("l", str(path), fmt="litdata")]).orderBy("shard_id", "local_id").collect()
        assert [(r.shard_id, r.local_id, r.text, r.k, r.x, r.ok, bytes(r.raw)) for r in got] == [(c, i, f"é{c}{i}", i - 1, i / 4, i == 1, bytes([c, i])) for c in range(2) for i in range(3 + c)]


def test_other_structures():
    assert litdata.names_of({"data_format": ["str", "int"], "data_spec": "not json"}) == ["item_0", "item_1"]
    assert litdata.names_of({"data_format": ["str"], "data_spec": None}) == ["item_0"]
