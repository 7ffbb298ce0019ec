"""Trained tokenizers as columns: Arrow batches, one model for each worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of text whose tokens a worker holds as Python objects at once (of
#: a longer text, all its own), and texts of one reply.
_CHARACTERS, _TEXTS = 1 << 18, 256


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """Consecutive texts, few at a time."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        value = text.as_py()
        if held and (len(held) >= _TEXTS or size + len(value or "") > _CHARACTERS):
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value or "")
    if held:
        yield held


def _columns(load: Callable[[], Callable[[list[str]], Sequence[Sequence]]], shape: Callable[[np.ndarray], pa.Array], width: int):
    """Batches of texts to lists of what ``load()`` finds in them, as numbers
    in Arrow arrays: only a portion's tokens are Python objects."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for texts in batches:
            for portion in _portions(texts):
                found = iter(encode([t for t in portion if t is not None]))
                each = [None if t is None else np.asarray(next(found), dtype=np.int64).reshape(-1, width) for t in portion]
                ends = np.cumsum([0, *(0 if a is None else len(a) for a in each)], dtype=np.int32)
                values = np.concatenate([np.empty((0, width), np.int64), *(a for a in each if a is not None)])
                yield pa.ListArray.from_arrays(pa.array(ends), shape(values), mask=pa.array([a is None for a in each]))
        pa.default_memory_pool().release_unused()

    return run


def encoder(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """``load`` runs once in each task and returns a batch encoder. Null texts
    give null, which ``tokenize(missing_field=...)`` has dealt with before."""
    each = _columns(load, lambda v: pa.array(v[:, 0]), 1)

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each(batches)

    return run


def fast_tokenizer(path: str) -> Callable[[Column], Column]:
    """A tokenizer file of the ``tokenizers`` library, without special ids."""

    def load() -> Callable[[list[str]], list[list[int]]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = True
        return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]

    return encoder(load)


def offset_encoder(load: Callable[[], Callable[[list[str]], list[list[tuple[int, int, int]]]]]) -> Callable[[Column], Column]:
    """The same with the characters of each token: (id, start, stop)."""

    names = ["id", "start", "stop"]
    each = _columns(load, lambda v: pa.StructArray.from_arrays([pa.array(v[:, 0]), *(pa.array(v[:, i].astype(np.int32)) for i in (1, 2))], names), 3)

    @F.arrow_udf("array<struct<id:bigint,start:int,stop:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each(batches)

    return run.asNondeterministic()  # so that a filter on its tokens doesn't run it once more


def fast_tokenizer_offsets(path: str) -> Callable[[Column], Column]:
    """A tokenizer file of the ``tokenizers`` library, whose added tokens (the
    marks of a template) are taken as such."""

    def load() -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda texts: [[(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)] for e in model.encode_batch(texts, add_special_tokens=False)]

    return offset_encoder(load)


def word_offsets() -> Callable[[Column], Column]:
    """The ids of ``text.word_ids`` with the characters of the words."""

    def load() -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
        word = re.compile("[^ \\t\\n\\r\\x0b\\x0c]+")

        @lru_cache(1 << 16)
        def number(w: str) -> int:
            return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 10000 + 10

        return lambda texts: [[(number(m.group()), m.start(), m.end()) for m in word.finditer(t)] for t in texts]

    return offset_encoder(load)
