"""Join of items over shared keys, packed: what near-duplicate operators have in common.

A worker turns a slice of texts into (key, item) pairs, each distinct pair once, and deals them to buckets by key: a bucket's pairs are two
packed arrays in one row.  So millions of pairs move as a few rows, equal items of a slice (copies) count once, and a bucket's size is
bounded by the number of buckets, which follows the input.

Within a bucket, items that share a key are candidates: a group gives stars, a number of pairs linear in it.  After those are verified and joined into components, only what still spans several components is looked at
again, at first against a few members chosen by hash, then by sketches (see `linked`).  So no link is lost and a large group of copies never
becomes all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components, jaccard_at_least, mix, pack_columns, shingles, slices, unpack_columns

#: What texts_of returns: an item's size, its sketch, and its compressed text, from which the set can be made again.
TEXTS = "item long, size int, sketch binary, packed binary"

FAMILY = 16_384
PACKED = "bucket int, pairs binary"


def pair_parts(buckets: int) -> int:
    """Groups in which the pairs of so many buckets are made distinct: each takes what about 16 buckets give."""
    return max(12, buckets // 16)


def pack(keys: np.ndarray, items: np.ndarray, sizes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (PACKED) of one slice: pairs (key, item) with the items' sizes, by bucket."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((keys, bucket))
    keys, items, sizes, bucket = keys[order], items[order], sizes[order], bucket[order]
    if not len(keys):
        return
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        blob = pack_columns([keys[a:b], items[a:b], sizes[a:b].astype(np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "pairs"])


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, item) pairs of a bucket whose key has two items or more, in order of key, size and item; and where keys begin."""
    parts = [unpack_columns(x, [np.uint64, np.int64, np.int32]) for x in table["pairs"].to_pylist()]
    keys, items, sizes = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    again[:-1] |= again[1:]
    order = order[again]  # most keys are of one item and go here
    keys, items, sizes = keys[order], items[order], sizes[order]
    order = np.lexsort((items, sizes, keys))
    keys, items, sizes = keys[order], items[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
    keys, items, sizes = keys[new], items[new], sizes[new]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    return keys, items, sizes, starts


def candidates(packed: DataFrame, percent: int, parts: int = 12) -> DataFrame:
    """One table of two kinds of rows of each bucket: its pairs, packed and dealt to `parts` (part, pairs, null), and its groups of three items
    or more (null, null, groups: packed keys and items).

    A group's items, in order of size, fall into stretches where neighbours' sizes fit; each stretch gives a star around its least item.  So
    stars of a family's many groups have few centres, and pairs are few.  Two items that share many keys are a pair in many buckets, the more
    the more buckets there are; `distinct_pairs` makes them one."""

    def run(table: pa.Table) -> pa.Table:
        keys, items, sizes, starts = _groups(table)
        counts = np.diff(np.append(starts, len(keys)))
        part, blobs = [], []
        if len(keys):
            cut = np.ones(len(keys), bool)
            cut[1:] = (keys[1:] != keys[:-1]) | (100 * sizes[:-1].astype(np.int64) < percent * sizes[1:].astype(np.int64))
            heads = np.flatnonzero(cut)
            centre = np.minimum.reduceat(items, heads)[np.cumsum(cut) - 1]
            apart = items != centre
            left, right = np.unique(np.stack([centre[apart], items[apart]]), axis=1)
            at = (mix(left.view(np.uint64) ^ mix(right.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
            part = np.unique(at).tolist()
            blobs = [pack_columns([left[at == p], right[at == p]]) for p in part]
        several = np.repeat(counts > 2, counts)
        blob = pack_columns([keys[several], items[several]])
        return pa.table({"part": pa.array([*part, None], pa.int32()), "pairs": pa.array([*blobs, None], pa.binary()), "groups": pa.array([None] * len(part) + [blob], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "part int, pairs binary, groups binary")


def distinct_pairs(found: DataFrame) -> DataFrame:
    """The pairs (a, b) of `candidates`, each once."""

    def run(table: pa.Table) -> pa.Table:
        made = [np.stack(unpack_columns(x, [np.int64, np.int64])) for x in table["pairs"].to_pylist()]
        a, b = np.unique(np.concatenate(made, axis=1), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return found.where("pairs is not null").select("part", "pairs").groupBy("part").applyInArrow(run, "a long, b long")


def unpacked_groups(found: DataFrame) -> DataFrame:
    """The groups of `candidates` as rows: key, a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, items = unpack_columns(blob, [np.uint64, np.int64])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(items)], names=["key", "a"])

    return found.where("groups is not null").select("groups").mapInArrow(run, "key long, a long")


def parity_sketch(s: np.ndarray) -> bytes:
    """A dense sketch of a set: each hash flips one of a power of two of bits, about four for each hash.  Two sketches' Hamming distance is at
    most the sets' symmetric difference; folding a longer sketch by XOR gives that set's shorter one."""
    bits = 1 << min(14, max(9, (4 * len(s) - 1).bit_length()))
    flipped = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flipped.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Rows of `size` bytes, as 64-bit words."""
    rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in sketches]
    return np.stack(rows).view(np.uint64) if rows else np.empty((0, size // 8), np.uint64)


def near(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of many sketches may be as similar as percent: their distance doesn't pass the greatest symmetric difference."""
    apart = np.bitwise_count(one ^ many).sum(-1).astype(np.int64)
    return (100 + percent) * apart <= (100 - percent) * (size + sizes.astype(np.int64))


def cross_pairs(members: DataFrame, percent: int, own: Scratch, block: int = 1024) -> DataFrame:
    """members (a, key, size, label, sketch) -> pairs (a, b) of different components that share a group and whose sketches are near.

    A group is dealt over blocks of its members, and each pair of blocks is compared apart; only pairs whose sketches are near leave."""
    blocks = own.write(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    rows = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks").cast("long")).cast("int"))
    dealt = rows.select("key", "a", "size", "label", "sketch", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("p"), F.greatest(x, F.col("own")).alias("q")))).alias("pair"))

    def run(table: pa.Table) -> pa.Table:
        items, sizes, labels = (table[c].to_numpy() for c in ("a", "size", "label"))
        own, p, q = table["own"].to_numpy(), table["p"][0].as_py(), table["q"][0].as_py()
        packed = table["sketch"].to_pylist()
        sketch = _folded(packed, min(map(len, packed)))
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        out = [np.empty((2, 0), np.int64)]
        for i in left:
            j = right[labels[right] != labels[i]]
            j = j[near(sketch[i], sketch[j], int(sizes[i]), sizes[j], percent)]
            out.append(np.stack([np.minimum(items[i], items[j]), np.maximum(items[i], items[j])]))
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1])})

    return dealt.select("key", "a", "size", "label", "sketch", "own", "pair.p", "pair.q").groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def near_pairs(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            sizes = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1).astype(np.int64)
            good = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(x, y, strict=True)):
                f = _folded([s, t], min(len(s), len(t)))
                good[i] = near(f[0], f[1], int(sizes[i, 0]), sizes[i, 1:], percent)[0]
            yield batch.select([0, 1]).filter(pa.array(good))

    one = texts.select(F.col("item").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    two = texts.select(F.col("item").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of percent or more: sketches first, then the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, 2_000_000):
            made: dict[int, np.ndarray] = {}
            good = []
            for i, j, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for item, packed in ((i, x), (j, y)):
                    if item not in made:
                        made[item] = shingles(unzip(packed))
                good.append(jaccard_at_least(made[i], made[j], percent))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("item").alias("a"), F.col("packed").alias("x"))
    two = texts.select(F.col("item").alias("b"), F.col("packed").alias("y"))
    left = near_pairs(pairs, texts, percent)
    return left.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def spanning(members: DataFrame, labels: DataFrame, texts: DataFrame, own: Scratch) -> DataFrame:
    """members (a, key) -> (a, key, size, label, sketch) of the groups that still span several components.

    What a key's rows add up to is a table before it is joined back: a hot key's side is then a plain shuffle, which adaptive execution splits."""
    at = members.join(labels, members["a"] == labels["node"], "left").select("key", "a", F.coalesce("component", "a").alias("label"))
    spread = own.write(at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "spread")
    sketches = texts.select(F.col("item").alias("a"), "size", "sketch").dropDuplicates(["a"])
    apart = own.write(at.join(spread, "key", "left_semi").join(sketches, "a"), "apart")
    own.drop(spread)
    return apart


def centre_pairs(members: DataFrame, salt: int, percent: int, own: Scratch, centres: int = 6) -> DataFrame:
    """members (a, key, size, label) -> each member with a few of its group, chosen by hash, of other components: linear in the group."""
    who = F.struct("a", "label", "size")
    chosen = members.groupBy("key").agg(*[F.min_by(who, F.xxhash64("a", F.lit(salt * centres + i))).alias(f"c{i}") for i in range(centres)])
    chosen = own.write(chosen.select("key", F.array_distinct(F.array(*[f"c{i}" for i in range(centres)])).alias("cs")), "centres")
    met = members.select("key", "a", "label", "size").join(chosen, "key").select("a", "label", "size", F.explode("cs").alias("c")).where(F.col("label") != F.col("c.label"))
    met = met.where(100 * F.least("size", "c.size") >= percent * F.greatest("size", "c.size"))
    return met.select(F.least("a", "c.a").alias("a"), F.greatest("a", "c.a").alias("b")).distinct()


def relabelled(labels: DataFrame, new: DataFrame, own: Scratch) -> DataFrame:
    """The components of labels (node, component) and further links new (a, b): only the components that these join are worked on."""
    def of(column: str, out: str) -> DataFrame:
        return labels.select(F.col("node").alias(column), F.col("component").alias(out))

    between = new.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = components(between.where("a <> b").distinct(), own)
    joined_to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(joined_to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = own.write(known.unionAll(joined.join(labels, "node", "left_anti").select("node", "component")), "labels")
    own.drop(joined, labels)
    return out


def linked(packed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, own: Scratch, rounds: int = 1, colliding: bool = False, parts: int = 12) -> DataFrame:
    """(node, component) of every item that is similar to another, a table of own.  texts_of(items) gives TEXTS of the items (item) asked
    for; two rows of an item are alike.

    Stars of the groups come first; over them, similar or not, items fall into families, and no link leaves a family.  A family is cut in
    bands of size, each with the next, so that all pairs whose sizes fit meet in one; bands that span several components of verified links are
    tried against a few of their members, which joins near copies at linear cost.  What is still apart is compared by sketches, block by block:
    within a band of up to `FAMILY` items each pair, in a larger one only pairs that share a key.  With colliding only pairs that share a key are
    compared, whatever the size of their family: for keys that don't promise to bring all similar pairs together.  parts: into how many
    groups the buckets' pairs are dealt to be made distinct (`pair_parts`)."""
    found = own.write(candidates(packed, percent, parts), "candidates")
    pairs = own.write(distinct_pairs(found), "pairs")
    families = None if colliding else components(pairs, own)
    items = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct() if colliding else families.select(F.col("node").alias("item"))
    texts = own.write(texts_of(items), "texts")
    links = own.write(verified(pairs, texts, percent), "links")
    labels = components(links, own)
    if colliding:
        bands = unpacked_groups(found)
    else:
        band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("int")
        sized = families.join(texts.select("item", "size").distinct(), families["node"] == F.col("item"))
        bands = sized.select(F.col("node").alias("a"), F.explode(F.array(F.xxhash64("component", band), F.xxhash64("component", band - 1))).alias("key"))
    bands = own.write(bands, "bands")
    own.drop(links, families)
    large = None if colliding else own.write(bands.groupBy("key").count().where(F.col("count") > FAMILY).select("key"), "large")
    for k in range(rounds + 1):
        apart = spanning(bands, labels, texts, own)
        if apart.isEmpty():
            break
        if k < rounds:
            more = centre_pairs(apart, k, percent, own)
        else:
            more = cross_pairs(apart if colliding else apart.join(large, "key", "left_anti"), percent, own)
            if not colliding and not large.isEmpty():
                inside = bands.join(large, "key", "left_semi").select("a").distinct()
                by_key = unpacked_groups(found).join(inside, "a", "left_semi")
                more = more.unionAll(cross_pairs(spanning(by_key, labels, texts, own), percent, own))
        more = own.write(more.distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        own.drop(apart)
        new = own.write(verified(more, texts, percent), "new")
        if not new.isEmpty():
            labels = relabelled(labels, new, own)
        pairs = own.write(pairs.unionAll(more), "pairs") if k < rounds else pairs
        own.drop(more, new)
    own.keep(labels)
    return labels
