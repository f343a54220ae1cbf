"""Substring dedup by paragraphs: MinHash banding, exact verification, removal by components.

What is looked for are passages of `LEAST` words or more (A-Z lower-cased, split at ASCII white space) that stand in two documents.  Paragraphs
come in two cuts, and every word of a text lies in some:

* Lines of `LEAST` words or more.  A line's set is its distinct five-word shingles, banded by MinHash: `bands_for` gives the fewest bands of
  `ROWS` rows by which a pair at 0.75 meets with the wanted recall (20 for 0.999).  Lines that collide are verified by their exact Jaccard
  similarity of 0.75 or more, and similar lines are joined into components.  Of each component the lines of the least doc_id stay.
* Sliding paragraphs: each run of `LEAST` words, wherever it begins and across line breaks, in what lines that went leave.  Neighbours share
  nearly all words, so each has one MinHash, the `GRAM`-word string of least hash in it, and neighbours mostly the same one.  Only MinHashes
  that are in two texts bring their paragraphs together, which are verified by equality; of equal ones those of the least doc_id stay.
  So an unedited passage is found whatever is around it.  A run of a single word over and over is no passage.

All words that are in a paragraph to go are cut.  What a document repeats from itself stays.  Whether a paragraph goes is judged on the texts as they came, not on what is left.

Equal lines are one item, so a line that a third of all documents share costs one item per slice; groups of near copies are joined at linear
cost (see `pairs`).  Of a slice's equal sliding paragraphs only those of one document leave it.

Nulls: a null text has no paragraphs; rows with a null doc_id are returned uncut.  Rows that repeat a doc_id are told apart by their texts;
equal ones are cut alike.  Runs under `LEAST` words always stay.  Empty tables give no rows.  `cut` keeps all columns of docs, `report` reads
doc_id and text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHAIN, Scratch, input_partitions, mix, pack_columns, range_hashes, shingles, slices, unpack_columns, words_of_bytes, zipped
from tessera.llm.pairs import PACKED, TEXTS, _groups, linked, pack, pair_parts, parity_sketch
from tessera.llm.suffix_dedup import _gram_hashes, merged

LEAST, PERCENT = 50, 75
ROWS, RECALL = 4, 0.999
BUCKET_BYTES = 6 << 20
#: Bytes of text whose words are looked at at once: a word takes some sixty bytes more, and an executor may hold several workers.
SLICE_BYTES = 2_000_000
GRAM = 8
#: Words of a text that are looked at at once.
STRETCH = 1 << 20


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows by which a pair of that similarity collides with the recall: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(PERCENT / 100, ROWS, RECALL)
_RNG = np.random.default_rng(20)
#: Multipliers and offsets of the MinHash permutations.
MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def signed(h: int) -> int:
    return h - (h >> 63 << 64)


def text_hash(text: str) -> int:
    """Tells texts of one doc_id apart."""
    return signed(xxhash.xxh3_64_intdigest(text.encode()))


class Lines(NamedTuple):
    """Lines of `least` words or more: number of their text, place of the first word in it, words, item (a signed 64-bit hash of the words),
    place of the first word among all of the slice; and of each word of the slice its hash, first byte and end."""

    text: np.ndarray
    a: np.ndarray
    n: np.ndarray
    item: np.ndarray
    first: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: bytes

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """The words' hashes of some of the lines, end to end."""
        n = self.n[which]
        return self.words[np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def bytes_of(self, k: int) -> bytes:
        return self.raw[self.starts[self.first[k]] : self.ends[self.first[k] + self.n[k] - 1]]


def lines_of(texts: list[bytes], least: int) -> Lines:
    raw = b"\n".join(texts)
    words, starts, ends = words_of_bytes(raw)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    of = np.searchsorted(breaks, starts)
    heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
    n = np.diff(np.append(heads, len(words)))
    first, n = heads[n >= least], n[n >= least]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(begins, starts[first], side="right") - 1
    item = (range_hashes(words, first, first + n) + n.astype(np.uint64) * CHAIN).view(np.int64)
    return Lines(text, first - np.searchsorted(starts, begins)[text], n, item, first, words, starts, ends, raw)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def hashed(w: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of lines (word hashes end to end, of these lengths), where each line's begin, and how many distinct ones each has."""
    h = w[: len(w) - 4].copy()
    for j in range(1, 5):
        h *= CHAIN
        h += w[j : len(w) - 4 + j]
    inside = np.ones(len(w), bool)
    ends = np.cumsum(lengths)
    for j in range(1, 5):
        inside[ends - j] = False
    h = mix(h[inside[: len(h)]])
    counts = lengths - 4
    starts = np.cumsum(counts) - counts
    which = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    marked = np.sort((which << np.uint64(42)) | (h >> np.uint64(22)))
    new = np.concatenate(([True], marked[1:] != marked[:-1]))
    return h, starts, np.add.reduceat(new.astype(np.int32), starts)


def band_keys(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys of `hashed` paragraphs."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            v = h * MULTIPLY[r]
            v += OFFSET[r]
            key = key * CHAIN + (np.minimum.reduceat(v, starts) >> np.uint64(24))
        keys[:, b] = mix(key)
    return keys


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text, a, b, item): the words [a, b) of every line; text: its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            texts = batch.column(1).to_pylist()
            found = lines_of(encoded(texts), least)
            own = {k: text_hash(texts[k]) for k in np.unique(found.text).tolist()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found.text)), pa.array([own[k] for k in found.text.tolist()], pa.int64()), pa.array(found.a, pa.int32()), pa.array(found.a + found.n, pa.int32()), pa.array(found.item)],
                names=["doc_id", "text", "a", "b", "item"],
            )

    return docs.mapInArrow(run, "doc_id long, text long, a int, b int, item long")


def components_of(docs: DataFrame, seen: DataFrame, least: int, own: Scratch) -> DataFrame:
    """(node, component) of the lines that are similar to others, a table of own.  seen: their occurrences."""
    buckets = input_partitions(docs, BUCKET_BYTES)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 * SLICE_BYTES):
            found = lines_of(encoded(b.column(0).to_pylist()), least)
            items, one = np.unique(found.item, return_index=True)
            if not len(one):
                continue
            h, starts, distinct = hashed(found.hashes(one), found.n[one])
            keys = band_keys(h, starts).ravel()
            yield from pack(keys, np.repeat(items, BANDS), np.repeat(distinct, BANDS), buckets)

    packed = docs.select("text").mapInArrow(banded, PACKED)

    def texts_of(items: DataFrame) -> DataFrame:
        """Each item's words, from the first document that has it."""
        first = seen.groupBy("item").agg(F.min("doc_id").alias("doc_id"))
        wanted = first.join(items, "item").groupBy("doc_id").agg(F.collect_set("item").alias("wanted"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            unzip, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
            for b in slices(batches, SLICE_BYTES // 2):  # compressed
                found = lines_of([unzip(x) for x in b.column(0).to_pylist()], least)
                items, one = np.unique(found.item, return_index=True)
                one = one[np.isin(items, b.column(1).flatten().to_numpy())]
                texts = [found.bytes_of(k) for k in one.tolist()]
                made = list(map(shingles, texts))
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(found.item[one]), "size": pa.array(list(map(len, made)), pa.int32()), "sketch": pa.array(list(map(parity_sketch, made)), pa.binary()), "packed": pa.array(list(map(press, texts)), pa.binary()),
                })

        return zipped(docs, "text").join(wanted.hint("shuffle_hash"), "doc_id").select("packed", "wanted").mapInArrow(run, TEXTS)

    return linked(packed, texts_of, PERCENT, own, colliding=True, parts=pair_parts(buckets))


def later_lines(docs: DataFrame, least: int, own: Scratch) -> DataFrame:
    """doc_id, text, a, b of the lines that have a similar or equal one in a document of a smaller doc_id; a table of own."""
    seen = own.write(occurrences(docs, least), "lines")
    labels = components_of(docs, seen, least, inner := Scratch(docs.sparkSession, "paragraph"))
    by_item = seen.groupBy("item").agg(F.min("doc_id").alias("at"), F.max("doc_id").alias("last"))
    by_item = by_item.join(labels, by_item["item"] == labels["node"], "left").select("item", "at", "last", F.coalesce("component", "item").alias("class"))
    by_item = own.write(by_item, "items")
    inner.drop(labels)
    firsts = by_item.groupBy("class").agg(F.min("at").alias("first"), F.max("last").alias("last")).where("first < last").select("class", "first")
    known = own.write(by_item.join(own.write(firsts, "firsts"), "class").select("item", "first"), "known")
    later = own.write(seen.join(known, "item").where("doc_id > first").select("doc_id", "text", "a", "b"), "later")
    own.keep(later)
    return later


def sliding(w: np.ndarray, lengths: list[int] | np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the paragraphs of `least` of the words w (hashes; runs of these lengths end to end): first word, MinHash, its place, and own hash."""
    found = [[np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.uint64)]]
    inside = np.ones(len(w), bool)
    for end in np.cumsum(lengths).tolist():
        inside[max(0, end - least + 1) : end] = False
    for base in range(0, len(w) - least + 1, STRETCH):
        part = w[base : base + STRETCH + least - 1]
        n = len(part) - least + 1
        hashes = mix(_gram_hashes(part, gram))
        places = np.uint64(STRETCH * 2 - 1)
        low = (hashes & ~places) | np.arange(len(part), dtype=np.uint64)  # ties: the leftmost
        width, reach = 1, least - gram + 1
        while width * 2 <= reach:
            low[:-width] = np.minimum(low[:-width], low[width:])
            width *= 2
        if (left := reach - width) > 0:
            low[:-left] = np.minimum(low[:-left], low[left:])
        changes = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
        at = np.flatnonzero((changes[least - 1 :] > changes[:n]) & inside[base : base + n])
        anchor = (low[at] & places).astype(np.int64)
        found.append([base + at, hashes[anchor], base + anchor, mix(_gram_hashes(part, least))[at]])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def later_windows(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and document; and, in it, which have their key in a smaller document."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0)) if len(key) else order
    return order, doc != doc[first]


def by_text(row: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
    """Each text's places in one list: a text makes one row, however many paragraphs of it go."""
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)])
    return [pa.array(row[heads]), pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), pa.array(pos, pa.int32()))]


WINDOW = [np.uint64, np.int64, np.int64, np.int32]


def later_passages(docs: DataFrame, lines: DataFrame, least: int, own: Scratch) -> DataFrame:
    """doc_id, text, a, b: word spans to cut of what lines leave.  lines: what `later_lines` found."""
    buckets = input_partitions(docs, BUCKET_BYTES)
    gram = min(GRAM, least)

    def staying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of words that no line to go interrupts, where each begins."""
        import zstandard

        unzip, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches, 4_000_000):
            out: list[tuple] = []
            for doc, gone, x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = unzip(x)
                _, begin, end = words_of_bytes(raw)
                if len(begin) < least:
                    continue
                mine = signed(xxhash.xxh3_64_intdigest(raw))
                cuts = sorted((c["a"], c["b"]) for c in gone or () if c["text"] == mine)
                edges = [0, *chain.from_iterable(cuts), len(begin)]
                kept = [(p, q) for p, q in zip(edges[::2], edges[1::2], strict=True) if q - p >= least]
                if kept:
                    out.append((doc, mine, [p for p, _ in kept], press(b"\n".join(raw[begin[p] : end[q - 1]].replace(b"\n", b" ") for p, q in kept))))
            if out:
                doc, mine, starts, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "text": pa.array(mine, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "packed": pa.array(texts, pa.binary())})

    gone = lines.groupBy("doc_id").agg(F.collect_set(F.struct("text", "a", "b")).alias("gone"))
    rest = zipped(docs, "text").join(gone, "doc_id", "left").select("doc_id", "gone", "packed").mapInArrow(staying, "doc_id long, text long, starts array<int>, packed binary")
    rest = own.write(rest.withColumn("row", F.monotonically_increasing_id()), "rest")

    def of_slice(starts: list[list[int]], packed: list[bytes]) -> tuple[np.ndarray, ...]:
        """The sliding paragraphs of a slice: the row's number in it, place in the text, MinHash, its place in the slice, own hash."""
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        raw = b"\n".join(map(unzip, packed))
        w, begin, _ = words_of_bytes(raw)
        lengths = np.bincount(np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), begin), minlength=1)
        at, low, anchor, hashes = sliding(w, lengths, least, gram)
        ends = np.cumsum(lengths)
        run = np.searchsorted(ends, at, side="right")
        row = np.repeat(np.arange(len(starts)), list(map(len, starts)))[run]
        shift = (np.fromiter(chain.from_iterable(starts), np.int64, len(lengths)) - (ends - lengths))[run]
        return row, at + shift, low, anchor, hashes

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES // 2):
            row, _, low, anchor, _ = of_slice(b.column(1).to_pylist(), b.column(2).to_pylist())
            _, one = np.unique(anchor, return_index=True)
            row, key = b.column(0).to_numpy()[row[one]], low[one]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))[: len(row)]
            row, key = row[new], key[new]
            yield from pack(key, row, np.zeros(len(key), np.int32), buckets)

    def shared(table: pa.Table) -> pa.Table:
        key, row, _, _ = _groups(table)
        return pa.table({"row": pa.array(row), "key": pa.array(key.view(np.int64))})

    keys = rest.select("row", "starts", "packed").mapInArrow(anchored, PACKED).groupBy("bucket").applyInArrow(shared, "row long, key long")
    keys = own.write(keys.groupBy("row").agg(F.collect_set("key").alias("keys")), "keys")
    found = "bucket int, pairs binary, row long, pos array<int>"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE_BYTES // 2):
            k, pos, low, _, mine = of_slice(b.column(1).to_pylist(), b.column(2).to_pylist())
            wanted = [np.array(x, np.int64).view(np.uint64) for x in b.column(4).to_pylist()]
            good = np.zeros(len(k), bool)
            edges = np.searchsorted(k, np.arange(len(wanted) + 1))
            for i, want in enumerate(wanted):
                part = np.s_[edges[i] : edges[i + 1]]
                good[part] = np.isin(low[part], want)
            k, pos, mine = k[good], pos[good].astype(np.int32), mine[good]
            row, doc = b.column(0).to_numpy()[k], b.column(3).to_numpy()[k]
            # of a slice's equal paragraphs only the first document's go on
            order, later = later_windows(mine, doc)
            row, doc, pos, mine = row[order], doc[order], pos[order], mine[order]
            gone = by_text(row[later], pos[later])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(gone[0]), pa.int32()), pa.nulls(len(gone[0]), pa.binary()), *gone], names=["bucket", "pairs", "row", "pos"])
            row, doc, pos, mine = row[~later], doc[~later], pos[~later], mine[~later]
            bucket = (mine % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(part):
                    blob = pack_columns([mine[part], row[part], doc[part], pos[part]])
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[part[0]]], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32()))], names=["bucket", "pairs", "row", "pos"])

    def decided(table: pa.Table) -> pa.Table:
        mine, row, doc, pos = (np.concatenate(c) for c in zip(*(unpack_columns(x, WINDOW) for x in table["pairs"].to_pylist()), strict=True))
        order, later = later_windows(mine, doc)
        at = order[later]
        row, pos = row[at], pos[at]
        target = (mix(row.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(target[order])) + 1) if len(p)]
        return pa.table({"target": pa.array([int(target[p[0]]) for p in parts], pa.int32()), "gone": pa.array([pack_columns([row[p], pos[p]]) for p in parts], pa.binary())})

    def gathered(table: pa.Table) -> pa.Table:
        """What all buckets have decided of some texts."""
        row, pos = (np.concatenate(c) for c in zip(*(unpack_columns(x, [np.int64, np.int32]) for x in table["gone"].to_pylist()), strict=True))
        return pa.table(by_text(row, pos), names=["row", "pos"])

    pairs = own.write(rest.select("row", "starts", "packed", "doc_id").join(keys, "row").select("row", "starts", "packed", "doc_id", "keys").mapInArrow(met, found), "windows")
    cut = pairs.where("bucket is null").select("row", "pos").unionAll(pairs.where("bucket is not null").select("bucket", "pairs").groupBy("bucket").applyInArrow(decided, "target int, gone binary").groupBy("target").applyInArrow(gathered, "row long, pos array<int>"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, pos in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                starts = np.array(sorted(pos), np.int64)
                out += [(doc, text, x, y) for x, y in merged(np.stack([starts, starts + least], axis=1)).tolist()]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text", "a", "b"])

    by_row = cut.groupBy("row").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    return rest.select("row", "doc_id", "text").join(by_row, "row").select("doc_id", "text", "pos").mapInArrow(spans, "doc_id long, text long, a int, b int")


def later_copies(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and cuts (array of text, a, b): word spans of the texts' paragraphs that have a similar or equal one in a smaller document; a table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    own = Scratch(docs.sparkSession, "paragraphs")
    lines = later_lines(docs, least, own)
    cuts = lines.unionByName(later_passages(docs, lines, least, own))
    cuts = own.write(cuts.groupBy("doc_id").agg(F.collect_set(F.struct("text", "a", "b")).alias("cuts")), "cuts")
    own.keep(cuts)
    return cuts


def without(text: str, cuts: list[dict]) -> tuple[str, int, int]:
    """The text without the words to cut; how many runs went, and their words.  A cut that begins inside a line and takes its end keeps the
    line break."""
    mine = text_hash(text)
    spans = np.array(sorted((c["a"], c["b"]) for c in cuts if c["text"] == mine), np.int64).reshape(-1, 2)
    if not len(spans):
        return text, 0, 0
    spans = merged(spans)
    raw = text.encode()
    at = np.fromiter((m.start() for m in re.finditer(rb"[^ \t\n\r\f\v]+", raw)), np.int64)
    at = np.append(at, len(raw))
    kept, last = [], 0
    for a, b in spans.tolist():
        begin, end = int(at[a]), int(at[b])
        kept.append(raw[last:begin])
        if a and b"\n" not in raw[int(at[a - 1]) : begin] and b"\n" in raw[begin:end]:
            kept.append(b"\n")
        last = end
    kept.append(raw[last:])
    made = b"".join(kept)
    if spans[-1, 1] == len(at) - 1 and not raw.endswith(b"\n"):  # a line that went takes its break along
        made = made.removesuffix(b"\n")
    return made.decode(), len(spans), int((spans[:, 1] - spans[:, 0]).sum())


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_removed, removed_words, kept_sha256 (of the text that stays; null texts count as empty)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.join(later_copies(docs, least), "doc_id", "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or ""
                kept, gone, words = without(text, cuts) if cuts else (text, 0, 0)
                out.append((gone, words, hashlib.sha256(kept.encode()).hexdigest()))
            gone, words, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_removed": pa.array(gone, pa.int64()), "removed_words": pa.array(words, pa.int64()), "kept_sha256": sha})

    return rows.mapInArrow(run, "doc_id long, n_removed long, removed_words long, kept_sha256 string")


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with later copies of paragraphs cut out of `text` (and n_chars set anew); every row stays."""
    names = docs.columns
    key, made = (next(n for n in (base + "_" * k for k in range(len(names) + 1)) if n not in names) for base in ("cut_doc", "cuts_made"))
    cuts = later_copies(docs, least).select(F.col("doc_id").alias(key), F.col("cuts").alias(made))
    rows = docs.join(cuts, F.col("doc_id") == F.col(key), "left").select(*[f"`{n}`" for n in names], made)
    at, sized = names.index("text"), "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [without(t, c)[0] if t and c else t for t, c in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if sized:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
