"""Exact Jaccard join over word shingles with token-combination prefixes.

Every text becomes the set of its shingles of ``size`` words (64-bit hashes).
Equal sets are one node. Two sets link when 100 * intersection >= ``least`` *
union; the query op4_jaccard takes ``SHINGLE`` and ``LEAST``.

1. Nodes that agree in a band of minima are compared with one pivot of the
   band, its member of the most frequent shingles on average: among near copies
   that is the one the others come from, so this finds most links of a group
   without any pair list.
2. Shingles are ordered from rare to frequent, by counts over all documents
   that a sketch of fixed size holds. Sets of n shingles that link differ in
   at most t = (100 - least)n/100 shingles of either. A prefix is long enough when every
   choice of t lost shingles leaves a signature: rare shingles are signatures
   alone; frequent ones are dealt into groups and each two of a group in the
   prefix form one, so the prefix is extended by the groups it touches. Then
   two linked sets share a signature: before their first common one, common
   shingles lie in distinct groups and add nothing to either count.
3. A signature matters only if nodes of different components hold it; all
   pairs across components that share such a one and have fitting sizes are
   verified on their texts. Components that links join are merged.

Links are never collected. Pivots are dealt out with salted parts of their
groups. The holders of a signature are dealt into blocks of ``BLOCK``, and each
two blocks meet in a part of their own, so no task sees all holders of a hot
one. Defined results: null, empty and wordless texts are linked with nothing
and keep their own doc_id; a text of fewer words than a shingle is one shingle;
repeated rows and repeated doc_ids are rows of their own; null doc_ids count as
larger than any other and stay null unless a group has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, discard, documents, lean, small_batches, stored, unboxed
from .graph import components
from .superkmers import LAST, keyed
from .textvec import LOWER, mix, ranges, runs, slices, sums, words

SHINGLE = 4
#: Similarity in hundredths.
LEAST = 85
_SKETCH_BITS, _PARTS = 20, 128
_BINS, _BANDS = 16, 8
#: Members of a group that one task compares with the pivot.
SALT = 64
#: Holders of a signature in a block.
BLOCK = 4096
_FILTER_BITS = 24
#: Bits of a set's parity map.
_PARITY = 512


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    data = LOWER[data]
    starts, stops, first = words(data, ends)
    hashes = ranges(sums(data), starts, stops)
    all_ = runs(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_[a : b - size + 1])
        elif b > a:
            yield mix(runs(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def slack(n: int, least: int = LEAST) -> int:
    """How many of n shingles a linked set may lack."""
    return (100 - least) * n // 100


def links_only_equals(n: int, least: int = LEAST) -> bool:
    """Whether a set of n shingles can link with none but an equal one."""
    return not slack(n, least) and 100 * n // least == n


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bands(found: np.ndarray) -> np.ndarray:
    """Hashes of pairs of minima, each over one part of the hash space."""
    edges = np.arange(_BINS, dtype=np.uint64) << np.uint64(60)
    scrambled = np.sort(mix(found ^ np.uint64(0xA0761D6478BD642F)))
    at = np.searchsorted(scrambled, edges)
    minima = scrambled[np.where(at < len(scrambled), at, 0)]
    return mix(minima[0::2] * np.uint64(3) + minima[1::2] + np.arange(_BANDS, dtype=np.uint64))


_SETS = "_doc long, _null boolean, _key long, n long, node long, bands array<long>, part int, counts binary"


def _describe(width: int, least: int):
    """A row for each document, and each task's shingle counts in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_doc", "_null", "_key", "n", "node", "bands", "part", "counts"]
        counts = np.zeros(1 << _SKETCH_BITS, np.int64)
        for batch in batches:
            size, node, bands = [], [], []
            for _, data, ends in slices(batch.column("_text")):
                sets = list(shingle_sets(data, ends, width))
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                for found in sets:
                    size.append(len(found))
                    if len(found):
                        both = np.array([np.bitwise_xor.reduce(mix(found)), np.add.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)))])
                        node.append(int(_signed(mix(both[:1] + both[1:] * np.uint64(3)))[0]))
                        bands.append(None if links_only_equals(len(found), least) else _signed(_bands(found)))
                    else:
                        node.append(None)
                        bands.append(None)
            k = len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), batch.column("_null"), batch.column("_key"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names
            )
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(p.astype("<i8").tobytes()) if p.any() else None for p in np.split(counts, _PARTS)]
        have = [i for i, p in enumerate(parts) if p]
        none = pa.nulls(len(have), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(have), pa.bool_()), none, none, none, pa.nulls(len(have), pa.list_(pa.int64())), pa.array(have, pa.int32()), pa.array([parts[i] for i in have], pa.binary())], names=names)

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, block in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.as_py()), "<i8")
            total[part] = total[part] + got if part in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.ZstdCompressor().compress(t.tobytes()) for t in total.values()], pa.binary())], names=["part", "counts"])


def frequency_classes(sets: DataFrame) -> np.ndarray:
    """For each cell of the sketch an order from rare (0) to frequent; 128 and
    more: frequent. Fixed size; counts cover all documents."""
    counts = np.zeros((_PARTS, (1 << _SKETCH_BITS) // _PARTS), np.int64)
    parts = sets.where("part is not null").select("part", "counts").repartition(_PARTS, "part").mapInArrow(lean(_add_parts), "part int, counts binary")
    for row in parts.collect():  # at most _PARTS rows, 8 MB in all
        counts[row.part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.counts)), "<i8")
    counts = counts.ravel()
    mean = counts.mean()
    level = np.minimum(127, 6 * np.log2(1 + counts)).astype(np.uint8)
    return np.where(counts > mean + 8 * np.sqrt(mean) + 64, level + 128, level).astype(np.uint8)


def signatures(found: np.ndarray, classes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each how many shingles may be shared beside it.

    Linked sets that differ share a key that neither's count rules out: the
    first signature in the common order. Before it, common shingles lie in
    distinct groups; after it, at most what follows its last shingle is common.
    """
    n = len(found)
    lack = slack(n, least)
    if links_only_equals(n, least):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = classes[(found >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)]
    order = np.argsort(kind, kind="stable")
    tokens, often = found[order], kind[order] >= 128
    keys, beside = [], []
    for level in {n.bit_length(), (100 * n // least).bit_length()}:
        mark = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        if not often[: lack + 1].any():
            keys.append(mix(tokens[: lack + 1] ^ mark))
            beside.append(n - 1 - np.arange(lack + 1))
            continue
        groups = max(1, slack(1 << (level - 1), least) // 8)
        reach = min(n, lack + 1 + groups)
        group = (mix(tokens[:reach]) % np.uint64(groups)).astype(np.int64)
        adds = np.ones(reach, np.int64)
        frequent = np.flatnonzero(often[:reach])
        _, opening = np.unique(group[frequent], return_index=True)
        adds[frequent[opening]] = 0
        length = int(np.searchsorted(np.cumsum(adds), lack + 1)) + 1
        rare = np.flatnonzero(~often[:length])
        keys.append(mix(tokens[rare] ^ mark))
        beside.append(n - 1 - rare)
        frequent = frequent[frequent < length]
        frequent = frequent[np.lexsort((tokens[frequent], group[frequent]))]
        apart = 1
        while apart < len(frequent):
            pair = np.flatnonzero(group[frequent[apart:]] == group[frequent[:-apart]])
            if not len(pair):
                break
            keys.append(mix(mix(tokens[frequent[pair]] ^ mark) + tokens[frequent[pair + apart]] * np.uint64(0xD1342543DE82EF95)))
            beside.append(groups + n - 1 - np.maximum(frequent[pair], frequent[pair + apart]))
            apart += 1
    return np.concatenate(keys), np.concatenate(beside)


def _index(classes: np.ndarray, size: int, least: int):
    packed = zstandard.ZstdCompressor().compress(classes.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        for batch in batches:
            keys, beside, central, parity = [], [], [], []
            for _, data, ends in slices(batch.column("_text")):
                for found in shingle_sets(data, ends, size):
                    one, rest = signatures(found, levels, least)
                    keys.append(_signed(one))
                    beside.append(rest)
                    parity.append(np.packbits(np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=_PARITY) & 1 == 1).tobytes())
                    central.append(float(levels[(found >> np.uint64(64 - _SKETCH_BITS)).astype(np.int64)].mean()) if len(found) else 0.0)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            rest = np.concatenate(beside).astype(np.int32) if beside else np.zeros(0, np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(rest))]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_key"), pa.array(central, pa.float64()), pa.array(parity, pa.binary()), *lists], names=["_doc", "_key", "central", "parity", "keys", "beside"])

    return run


def _compare(size: int, least: int):
    """Rows in order of (group, salt), the pivot first in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, own = None, np.zeros(0, np.uint64), None
        for batch in batches:
            group, salt, node, first = (batch.column(c).to_pylist() for c in ("g", "salt", "node", "is_pivot"))
            a, b = [], []
            row = 0
            for _, data, ends in slices(batch.column("_text")):
                for found in shingle_sets(data, ends, size):
                    if first[row]:
                        at, pivot, own = (group[row], salt[row]), found, node[row]
                    elif at == (group[row], salt[row]):
                        same = len(np.intersect1d(pivot, found, assume_unique=True))
                        if 100 * same >= least * (len(pivot) + len(found) - same):
                            a.append(own)
                            b.append(node[row])
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The links among ``pairs`` (a, b), compared on whole texts."""
    wide = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    members = pairs.join(wide, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("node"), F.lit(0).alias("is_pivot"))
    pivots = wide.select(F.col("a").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("node"), F.lit(1).alias("is_pivot"))
    needed = members.unionByName(pivots).join(nodes.select("node", "_doc", "_key"), "node")
    # A node of very many groups is dealt out, so that no list of uses grows with them.
    per = stored(spark, needed.groupBy("_doc", "_key", "node", F.pmod(F.xxhash64("g", "salt"), F.lit(64)).alias("deal")).agg(F.collect_list(F.struct("g", "salt", "is_pivot")).alias("uses")).drop("deal"))
    wanted = keyed(docs).select("_doc", "_key", "_text").mapInArrow(lean(_picked(_filter(per.select(F.col("_key").alias("key"))))), "_doc long, _key long, _text string")
    texts = wanted.join(per, ["_doc", "_key"])
    shared = texts.select("node", "_text", F.explode("uses").alias("use")).select("use.g", "use.salt", "use.is_pivot", "node", "_text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = shared.repartition(n, "g", "salt").sortWithinPartitions("g", "salt", F.desc("is_pivot"))
    return stored(spark, dealt.mapInArrow(lean(_compare(size, least)), "a long, b long").distinct())


def _pairs(part: np.ndarray, side: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, beside: np.ndarray, parity: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of different components with a key in common, unless
    sizes, what may be shared beside the key, or parity rule them out: where
    two parity maps differ, the sets differ in a shingle at least. In a part of
    two blocks only pairs between them count (side 0 and 1; a block alone: 2)."""
    order = np.lexsort((n, part))
    part, side, node, comp, n, beside, parity = part[order], side[order], node[order], comp[order], n[order], beside[order], parity[order]
    group = np.cumsum(np.diff(part, prepend=part[:1]) != 0)
    reach = np.searchsorted((group << 32) + n, (group << 32) + 100 * n // least, side="right")
    size = reach - np.arange(len(n)) - 1
    total = np.cumsum(size)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 18))))
        left = np.repeat(np.arange(at, to), size[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        at = to
        both = n[left] + n[right]
        most = 1 + np.minimum(beside[left], beside[right])
        stay = np.flatnonzero((comp[left] != comp[right]) & ((side[left] == 2) | (side[left] != side[right])) & (100 * most >= least * (both - most)))
        left, right, both = left[stay], right[stay], both[stay]
        a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
        _, one = np.unique(mix(a.view(np.uint64) * np.uint64(3)) + b.view(np.uint64), return_index=True)
        found = []
        for k in range(0, len(one), 1 << 15):
            i = one[k : k + (1 << 15)]
            apart = np.bitwise_count(parity[left[i]] ^ parity[right[i]]).sum(axis=1, dtype=np.int64)
            found.append(i[100 * (both[i] - apart) >= least * (both[i] + apart)])
        if found:
            one = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one])], names=["a", "b"])


def _across(least: int):
    """Pairs across components of each part; rows in order of part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            maps = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(-1, _PARITY // 64)
            held.append((*(batch.column(c).to_numpy() for c in ("part", "side", "node", "comp", "n", "beside")), maps))
            waiting += batch.num_rows
            if waiting < 50_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            whole = int(np.argmax(columns[0] == columns[0][-1]))
            if whole:  # the last part may go on
                yield from _pairs(*(c[:whole] for c in columns), least)
            held = [tuple(c[whole:] for c in columns)]
            waiting = 0
        if held:
            yield from _pairs(*(np.concatenate(c) for c in zip(*held, strict=True)), least)

    return run


def _filter(keys: DataFrame) -> bytes:
    """A packed bit table of fixed size in which each key of ``keys`` (one
    hashed column, ``key``) sets two bits: what it rules out is not among them."""
    mask = F.lit((1 << _FILTER_BITS) - 1)
    place = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", _FILTER_BITS).bitwiseAND(mask)))
    words_ = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    if words_:
        table[[r.word for r in words_]] = np.array([r.bits for r in words_], dtype=np.int64).view(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(table.tobytes())


def _may_have(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    mask = np.uint64((1 << _FILTER_BITS) - 1)
    found = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> np.uint64(_FILTER_BITS)) & mask):
        found &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def _table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint64)


def _picked(packed: bytes):
    """Rows whose _key may be wanted, so that few other texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(packed)
        for batch in batches:
            yield batch.filter(pa.array(_may_have(table, batch.column("_key").to_numpy())))

    return run


def _spread(packed: bytes):
    """A row for each signature that may be shared across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(packed)
        for batch in batches:
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy()
            keep = np.flatnonzero(_may_have(table, flat))
            take = pa.array(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[keep], pa.int64())
            beside = batch.column("beside").flatten().to_numpy()[keep].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), *(batch.column(c).take(take) for c in ("node", "comp", "n", "parity")), pa.array(beside)], names=["key", "node", "comp", "n", "parity", "beside"])

    return run


def _links_across(spark: SparkSession, docs: DataFrame, nodes: DataFrame, index: DataFrame, comps: DataFrame, size: int, least: int) -> DataFrame:
    """All links between nodes of different components."""
    tagged = stored(spark, index.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "n", "parity", "keys", "beside"))
    discard(spark, index)
    shared = tagged.select("comp", F.explode("keys").alias("key")).groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("holders")).where("low < high")
    shared = stored(spark, shared.select("key", F.ceil(F.col("holders") / BLOCK).cast("int").alias("blocks")))
    rows = tagged.mapInArrow(lean(_spread(_filter(shared))), "key long, node long, comp long, n long, parity binary, beside long").join(shared, "key")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    dealt = met.select(part.alias("part"), side.alias("side"), "node", "comp", "n", "parity", "beside").repartition(n, "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(lean(_across(least)), "a long, b long").distinct()
    pairs = stored(spark, found)
    discard(spark, tagged)
    discard(spark, shared)
    return verified(spark, docs, nodes, pairs, size, least)


def grouped(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(_doc, _null, _key, n, component, unknown): component is the smallest
    doc_id of the group; where _null (unknown) holds, it is null."""
    small_batches(spark)
    sets = stored(spark, keyed(docs).mapInArrow(lean(_describe(size, least)), _SETS))
    rows = sets.where("_doc is not null").select("_doc", "_null", "_key", "n", "node", "bands")
    low = rows.where("n > 0").groupBy("node", "n").agg(F.min(F.struct("_doc", "_null", "_key", "bands")).alias("low"))
    nodes = stored(spark, low.select("node", "n", "low.*"))
    indexed = keyed(docs).mapInArrow(lean(_index(frequency_classes(sets), size, least)), "_doc long, _key long, central double, parity binary, keys array<long>, beside array<int>").where("size(keys) > 0")
    index = stored(spark, indexed.join(nodes.select("_doc", "_key", "node", "n"), ["_doc", "_key"]).dropDuplicates(["_doc", "_key"]).select("node", "n", "central", "parity", "keys", "beside"))
    bands = stored(spark, nodes.select("node", "n", F.explode("bands").alias("band")).join(index.select("node", "central"), "node"))
    pivots = stored(spark, bands.groupBy("band").agg(F.min(F.struct(-F.col("central"), "node", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", F.col("p.node").alias("a"), F.col("p.n").alias("m")))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * least
    star = stored(spark, bands.join(pivots, "band").where((F.col("a") != F.col("node")) & fits).select("a", F.col("node").alias("b")).distinct())
    near = verified(spark, docs, nodes, star, size, least)
    comps = components(spark, near)
    links = near.unionByName(_links_across(spark, docs, nodes, index, comps, size, least))
    final = components(spark, links)
    heads = final.join(nodes, "node").groupBy("comp").agg(F.min(F.struct("_doc", "_null")).alias("head"))
    named = final.join(stored(spark, heads), "comp").select("node", "head")
    own = nodes.join(named, "node", "left").select("node", F.coalesce("head", F.struct("_doc", "_null")).alias("head"))
    alone = F.coalesce("head", F.struct("_doc", "_null"))
    out = rows.select("_doc", "_null", "_key", "n", "node").join(stored(spark, own), "node", "left")
    return out.select("_doc", "_null", "_key", "n", alone["_doc"].alias("component"), alone["_null"].alias("unknown"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c, null: F.when(~F.col(null), F.col(c))
    return grouped(spark, documents(spark, sf_dir)).select(known("_doc", "_null").alias("doc_id"), F.col("n").alias("n_shingles"), known("component", "unknown").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """Pipeline stage: of each group the row of the smallest doc_id stays, of
    rows that agree in doc_id and text the one whose other columns come first
    as JSON. Documents without words all stay. Other columns may have any name
    and type."""
    wordless = ~F.coalesce(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    rank = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("")
    box = boxed(docs, _doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), _null=F.col("doc_id").isNull(), _key=F.xxhash64("text"), _text=F.col("text"), _rank=rank)
    rows = grouped(spark, docs, size, least).where("n > 0")
    first = stored(spark, rows.groupBy("component", "unknown").agg(F.min(F.struct("_doc", "_null", "_key")).alias("f")).select("f.*"))
    # Repeated rows are one before they are shuffled.
    once = box.where(~wordless).groupBy("_doc", "_null", "_key").agg(F.min_by("row", "_rank").alias("row"))
    return unboxed(once.join(first, ["_doc", "_null", "_key"]).select("row").unionByName(box.where(wordless).select("row")))
