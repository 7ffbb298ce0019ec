"""Reader of MDS folders: ``index.json`` and binary shards.

Each shard is one binary file: the number of samples, their offsets, then for
each sample the sizes of its variable columns and the columns' bytes. Files are
read by Spark's own readers, so any Hadoop file system will do; a shard is one
task's work.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import register_format

# Encodings with their Spark types; formats and sizes of fixed ones.
TYPES = {"str": T.StringType(), "bytes": T.BinaryType(), "json": T.StringType(), "int": T.LongType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "float64": T.DoubleType(), "float32": T.FloatType()}
FIXED = {"int": ("<q", 8), "int64": ("<q", 8), "int32": ("<i", 4), "int16": ("<h", 2), "int8": ("<b", 1), "uint8": ("<B", 1), "uint16": ("<H", 2), "uint32": ("<I", 4), "float64": ("<d", 8), "float32": ("<f", 4)}


def decode(encoding: str, raw: bytes) -> Any:
    if encoding in FIXED:
        return struct.unpack(FIXED[encoding][0], raw)[0]
    return raw if encoding == "bytes" else raw.decode("utf-8")


def rows(shard: bytes, names: list[str], encodings: list[str], sizes: list[int | None]) -> Iterator[list[Any]]:
    """Samples of a shard in order."""
    (n,) = struct.unpack_from("<I", shard, 0)
    offsets = struct.unpack_from(f"<{n + 1}I", shard, 4)
    open_ = [i for i, s in enumerate(sizes) if s is None]
    for begin in offsets[:-1]:
        found = dict(zip(open_, struct.unpack_from(f"<{len(open_)}I", shard, begin), strict=True))
        at = begin + 4 * len(open_)
        out = []
        for i, encoding in enumerate(encodings):
            size = found.get(i, sizes[i])
            out.append(decode(encoding, shard[at : at + size]))
            at += size
        yield out


def write_shard(samples: list[dict], names: list[str], encodings: list[str]) -> bytes:
    """The bytes of a shard (for tests and small exports)."""
    bodies = []
    for s in samples:
        parts = []
        for name, encoding in zip(names, encodings, strict=True):
            v = s[name]
            parts.append(struct.pack(FIXED[encoding][0], v) if encoding in FIXED else v if encoding == "bytes" else v.encode())
        heads = b"".join(struct.pack("<I", len(p)) for p, e in zip(parts, encodings, strict=True) if e not in FIXED)
        bodies.append(heads + b"".join(parts))
    at, offsets = 4 + 4 * (len(samples) + 1), []
    for b in bodies:
        offsets.append(at)
        at += len(b)
    return struct.pack(f"<{len(samples) + 2}I", len(samples), *offsets, at) + b"".join(bodies)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """(_shard, local_id, columns...) of an MDS folder."""
    index = json.loads("".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/index.json", wholetext=True).collect()))
    shards = index["shards"]
    if not shards:
        return spark.createDataFrame([], "_shard string, local_id long")
    names, encodings = shards[0]["column_names"], shards[0]["column_encodings"]
    unknown = sorted(set(encodings) - set(TYPES))
    if unknown:
        raise ValueError(f"no decoder for the encodings {unknown}")
    packed = {s["zip_data"]["basename"]: s.get("compression") for s in shards if s.get("zip_data")}
    sizes = shards[0]["column_sizes"]
    kind = T.StructType([T.StructField("_shard", T.StringType()), T.StructField("local_id", T.LongType()), *(T.StructField(n, TYPES[e]) for n, e in zip(names, encodings, strict=True))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                base = file.rsplit("/", 1)[-1]
                data = bytes(content)
                if base in packed:
                    if not str(packed[base]).startswith("zstd"):
                        raise ValueError(f"compression {packed[base]!r} is not supported")
                    import zstandard

                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                held: list[list[Any]] = []
                for i, row in enumerate(rows(data, names, encodings, sizes)):
                    held.append([base, i, *row])
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=kind.fieldNames())
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=kind.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mds,zstd,zst}").load(path)
    return files.select(F.col("path"), "content").mapInPandas(run, kind)


register_format("mds", read, (".mds", "index.json"))
