"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles, as 64-bit hashes.  Its sketch of M segments of 2^32 bits each has one bit flipped per
shingle (kept sparsely: a segment is the XOR of its shingles' hashes), so two sketches differ in at most |A symmetric difference B| segments.
Two sets with Jaccard similarity of 0.75 or more have a symmetric difference of at most min(|A|, |B|) / 3 = D; with M > D segments, M - D at
least are equal (pigeonhole).  All segments of a sketch are ordered from rare to frequent by their content alone, so two linked documents
meet in one of the first D + 1 of either: only those become join keys.  Sizes are banded by powers of four; a document near a band's lower
end is also sketched for the band below.  Candidates are verified exactly, in integers.

The order puts segments made only of frequent shingles last: a pass over all documents counts shingles in each slice, and those that are
frequent in some slice are summed; the `HOT` most frequent are broadcast (8 bytes each).  The order decides how many candidates there are,
never which links are found.

Copies (equal sets) are one item, so they cost one item per slice.  Nulls: a null text or one without words is empty and linked with
nothing; a text of fewer than five words is one shingle.  A null doc_id gets a null component and is left out of links.  Rows that repeat a
doc_id each come back, in one component.  Empty tables give no rows.  Extra columns are not read; `keep_first` keeps those of docs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, input_partitions, mix, shingles, slices, zipped
from tessera.llm.pairs import PACKED, TEXTS, linked, pack, pair_parts, parity_sketch

PERCENT = 75
HOT = 1 << 17
#: A shingle is counted for a slice if so many of its distinct sets hold it.
OFTEN = 8
BUCKET_BYTES = 6 << 20


def item_of(s: np.ndarray) -> int:
    """A set's 64-bit identity, signed."""
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def segment_keys(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Join keys of a set of n shingles: in its band, and in the band below if a smaller partner may be there."""
    n = len(s)
    if n < 3:  # such a set is only similar to itself
        return np.empty(0, np.uint64)
    band = (n.bit_length() - 1) // 2
    bands = [band] if -(-PERCENT * n // 100) >= 4**band or not band else [band, band - 1]
    need = n // 3 + 1
    frequent = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
    out = []
    for k in bands:
        m = 2 * 4**k
        seg = s >> np.uint64(64 - (m - 1).bit_length())  # in order, as the hashes are
        at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        size = np.minimum(np.diff(np.append(at, n)), 63).astype(np.uint64)
        hash_ = mix(np.bitwise_xor.reduceat(s, at) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        # the key's own value is the order: frequent segments last, of the others those with more shingles first
        key = (np.logical_and.reduceat(frequent, at).astype(np.uint64) << np.uint64(62)) | ((np.uint64(63) - size) << np.uint64(56)) | (hash_ >> np.uint64(8))
        if len(key) > need:
            key = np.partition(key, need - 1)[:need]
        elif len(key) < need:  # too few segments hold anything: empty ones, the most frequent of all, have to serve
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), seg[at])[: need - len(key)]
            key = np.append(key, (np.uint64(1) << np.uint64(63)) | (np.uint64(k) << np.uint64(56)) | empty)
        out.append(key)
    return np.concatenate(out)


def document_sets(docs: DataFrame, own: Scratch) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, item of every document with words; and the most frequent shingles, sorted.  One pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 6_000_000):
            seen: dict[int, np.ndarray] = {}
            n, item = [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                item.append(item_of(s))
                seen[item[-1]] = s
            h, c = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            h, c = h[c >= OFTEN], c[c >= OFTEN]
            rows, more = b.num_rows, len(h)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.concat_arrays([b.column(0).cast(pa.int64()), pa.nulls(more, pa.int64())]), "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64())]),
                "item": pa.concat_arrays([pa.array(item, pa.int64()), pa.array(h.view(np.int64))]), "counted": pa.array([False] * rows + [True] * more),
            })

    both = own.write(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, item long, counted boolean"), "sets")
    sums = both.where("counted").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "item").limit(HOT)
    hot = sums.select("item").toArrow()["item"].to_numpy().astype(np.int64).view(np.uint64)
    return both.where("not counted").select("doc_id", "n", "item"), np.sort(hot)


def similarity_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, item) of every document, and (item, component) with the smallest doc_id that the item reaches."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    own = Scratch(spark, "ngram")
    rows, hot = document_sets(docs, own)
    shared = spark.sparkContext.broadcast(hot)
    buckets = input_partitions(docs, BUCKET_BYTES)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for b in slices(batches, 6_000_000):
            done: set[int] = set()
            keys, items, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for text in b.column(0).to_pylist():
                s = shingles(text)
                item = item_of(s)
                if item in done:
                    continue
                done.add(item)
                k = segment_keys(s, frequent)
                keys.append(k)
                items.append(np.full(len(k), item))
                sizes.append(np.full(len(k), len(s), np.int32))
            yield from pack(np.concatenate(keys), np.concatenate(items), np.concatenate(sizes), buckets)

    packed = docs.where("doc_id is not null").select("text").mapInArrow(keyed, PACKED)

    def texts_of(items: DataFrame) -> DataFrame:
        """Each item's text, from the first document that has it."""
        first = rows.where("doc_id is not null").groupBy("item").agg(F.min("doc_id").alias("doc_id"))
        wanted = first.join(items, "item").select("doc_id", F.col("item").alias("wanted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            unzip = zstandard.ZstdDecompressor().decompress
            for b in slices(batches, 4_000_000):
                made = [shingles(unzip(x)) for x in b.column(0).to_pylist()]
                good = pa.array([item_of(s) == w for s, w in zip(made, b.column(1).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_pydict({
                    "item": b.column(1), "size": pa.array(list(map(len, made)), pa.int32()), "sketch": pa.array(list(map(parity_sketch, made)), pa.binary()), "packed": b.column(0),
                }).filter(good)

        return zipped(docs, "text").join(wanted.hint("shuffle_hash"), "doc_id").select("packed", "wanted").mapInArrow(run, TEXTS)

    labels = linked(packed, texts_of, PERCENT, Scratch(spark, "ngram"), parts=pair_parts(buckets))
    least = rows.where("n > 0 and doc_id is not null").groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = least.join(labels, least["item"] == labels["node"], "left").select("item", "doc_id", "copies", F.coalesce("component", "item").alias("class"))
    smallest = classes.groupBy("class").agg(F.min("doc_id").alias("component"), F.sum("copies").alias("members")).where("members > 1")
    return rows, classes.join(smallest, "class").select("item", "component")


def join_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows, classes = similarity_classes(docs)
    rows = rows.withColumn("item", F.when(F.col("n") > 0, F.col("item")))
    out = rows.join(classes, "item", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with only the smallest doc_id of each component; of rows that repeat a doc_id all stay."""
    gone = join_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{n}`" for n in docs.columns])


ORACLE = r"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) g from w),
e as (select doc_id, len(g) n, unnest(g) g from s),
i as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from i where 100 * c >= 75 * (na + nb - c)),
sym as (select a, b from l union all select b, a from l),
reach as (with recursive r(a, b) as (select a, b from sym union select r.a, sym.b from r join sym on r.b = sym.a) select a, min(b) b from r group by 1)
select doc_id, len(g)::bigint n_shingles, least(doc_id, coalesce(b, doc_id)) component_id from s left join reach on a = doc_id
"""
