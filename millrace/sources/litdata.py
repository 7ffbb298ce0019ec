"""Reader of LitData folders: ``index.json`` and binary chunks.

A chunk holds the number of items, their offsets, and for each item the sizes
of its leaves and the leaves' bytes. Integers, floats and booleans are decimal
text, strings UTF-8; leaves of other kinds (arrays, images) stay binary. Leaves
of a flat mapping take its keys as names, else ``item_0`` and so on.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .readers import register_format

TYPES = {"str": T.StringType(), "string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType()}


def decode(kind: str, raw: bytes) -> Any:
    if kind in ("str", "string"):
        return raw.decode("utf-8")
    if kind == "int":
        return int(raw.decode())
    if kind == "float":
        return float(raw.decode())
    if kind in ("bool", "boolean"):
        return raw.decode() == "True"
    return raw


def names_of(config: dict) -> list[str]:
    """Column names from the recorded structure of an item."""
    kinds = config["data_format"]
    try:
        spec = json.loads(config.get("data_spec") or "null")[1]
        keys = json.loads(spec["context"]) if isinstance(spec["context"], str) else spec["context"]
        flat = all(not c.get("children_spec") for c in spec["children_spec"])
        if str(spec["type"]).endswith("dict") and flat and len(keys) == len(kinds):
            return [str(k) for k in keys]
    except (TypeError, KeyError, IndexError, ValueError):
        pass  # another structure: the leaves are numbered
    return [f"item_{i}" for i in range(len(kinds))]


def items(chunk: bytes, kinds: list[str]) -> Iterator[list[Any]]:
    (n,) = struct.unpack_from("<I", chunk, 0)
    offsets = struct.unpack_from(f"<{n + 1}I", chunk, 4)
    for begin in offsets[:-1]:
        sizes = struct.unpack_from(f"<{len(kinds)}I", chunk, begin)
        at, out = begin + 4 * len(kinds), []
        for kind, size in zip(kinds, sizes, strict=True):
            out.append(decode(kind, chunk[at : at + size]))
            at += size
        yield out


def write_chunk(rows: list[list[bytes]]) -> bytes:
    """The bytes of a chunk from leaves already as bytes (for tests and small exports)."""
    bodies = [struct.pack(f"<{len(r)}I", *map(len, r)) + b"".join(r) for r in rows]
    at, offsets = 4 * (len(rows) + 2), []
    for b in bodies:
        offsets.append(at)
        at += len(b)
    return struct.pack(f"<{len(rows) + 2}I", len(rows), *offsets, at) + b"".join(bodies)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """(_shard, local_id, columns...) of a LitData folder."""
    index = json.loads("".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/index.json", wholetext=True).collect()))
    config = index["config"]
    if config.get("encryption"):
        raise ValueError("encrypted chunks are not supported")
    kinds, compression = config["data_format"], config.get("compression")
    if compression and not str(compression).startswith("zstd"):
        raise ValueError(f"compression {compression!r} is not supported")
    names = names_of(config)
    known = [c["filename"] for c in index["chunks"]]
    kind = T.StructType([T.StructField("_shard", T.StringType()), T.StructField("local_id", T.LongType()), *(T.StructField(n, TYPES.get(k.split(":")[0], T.BinaryType())) for n, k in zip(names, kinds, strict=True))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(known)
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                base = file.rsplit("/", 1)[-1]
                if base not in wanted:
                    continue
                data = bytes(content)
                if compression:
                    import zstandard

                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                held = []
                for i, row in enumerate(items(data, kinds)):
                    held.append([base, i, *row])
                    if len(held) == 1000:
                        yield pd.DataFrame(held, columns=kind.fieldNames())
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=kind.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin*").load(path)
    return files.select("path", "content").mapInPandas(run, kind)


register_format("litdata", read, (".bin",))
