"""Suffix-array dedup: removes every byte covered by a string of `SPAN` bytes that also starts in a document with a smaller doc_id.

What decides is, for each position, whether its longest previous factor (LPF: the longest string from here that also starts in an earlier
document) reaches SPAN.  In suffix order that match is at the previous or the next entry of a smaller document, so LPF arrays come from
previous- and next-smaller positions and the LCP array, cut at SPAN.  A suffix array of a whole corpus can't be dealt over machines; equal
strings can be brought together first:

1. Every window of SPAN bytes has an anchor, the `GRAM`-byte string of least hash in it.  Equal windows have equal anchors at equal offsets.
   The windows of one occurrence of an anchor are consecutive; their joint text is the occurrence's context, hashed whole.
2. Occurrences are dealt by anchor, packed, and within a slice of texts only the first document of each context goes.  A context that
   was in an earlier document is removed whole.  (Hot passages and copies so cost one entry per slice.)
3. Where an anchor has several contexts, the first documents' contexts themselves are dealt by anchor.  Their windows are put in suffix
   order, with the LCP array; the previous and the next smaller positions give the LPF array, which decides each window.
4. Removed intervals return to their texts.

Texts travel twice, compressed.  Nulls: a null text is empty; a row with a null doc_id is returned uncut and isn't compared.  Rows that repeat
a doc_id are no earlier than each other.  Texts under SPAN bytes stay.  Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHAIN, Scratch, input_partitions, mix, pack_columns, slices, unpack_columns, zipped

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM  # an anchor lies at most so far after its window's start
SLICE_BYTES = 3_000_000
BUCKET_BYTES = 6 << 20
STRETCH = 1 << 24
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An occurrence: anchor hash, context hash, doc_id, text's number in its slice, first window's start, windows - 1, anchor's offset in the first.
OCCURRENCE = [("key", np.uint64), ("context", np.uint64), ("doc", np.int64), ("text", np.int32), ("start", np.int32), ("more", np.uint8), ("offset", np.uint8)]


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of the k bytes from each place (of a byte array's hashes); meaningless in the last k - 1."""
    n, out, length, power, size = len(x), None, 0, x, 1
    while True:
        if k & size:
            if out is None:
                out, length = power, size
            else:
                joined = np.zeros(n, np.uint64)
                joined[: n - length] = out[: n - length] * np.uint64(pow(int(CHAIN), size, 1 << 64)) + power[length:]
                out, length = joined, length + size
        if length == k:
            return out
        doubled = np.zeros(n, np.uint64)
        doubled[: n - size] = power[: n - size] * np.uint64(pow(int(CHAIN), size, 1 << 64)) + power[size:]
        power, size = doubled, size * 2


def find_occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of texts of SPAN bytes or more: text number, first window's start, last window's start, anchor's place, anchor hash, context hash.

    Bytes are looked at in stretches of STRETCH; an occurrence that a stretch's end cuts counts as two, which changes no removed byte."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    inside = np.ones(len(buf), bool)
    for e in ends:
        inside[max(0, e - SPAN + 1) : e] = False
    found = []
    for base in range(0, len(buf) - SPAN + 1, STRETCH):
        part = buf[base : base + STRETCH + SPAN - 1]
        ok = inside[base : base + len(part) - SPAN + 1]
        if ok.any():
            first, last, anchor, key, context = _in_stretch(part, np.flatnonzero(ok))
            found.append([base + first, base + last, base + anchor, key, context])
    first, last, anchor, key, context = (np.concatenate(c) for c in zip(*found, strict=True))
    text = np.searchsorted(ends, first, side="right")
    begin = (ends - lengths)[text]
    return text.astype(np.int32), (first - begin).astype(np.int32), (last - begin).astype(np.int32), (anchor - begin).astype(np.int32), key, context


def _in_stretch(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows that start at `at`, in order: occurrences' first and last window, anchor's place, anchor hash, context hash."""
    n = len(buf)
    x = _TABLE[buf]
    gram = mix(_gram_hashes(x, GRAM))
    places = np.uint64(2 * STRETCH - 1)
    least = (gram & ~places) | np.arange(n, dtype=np.uint64)  # ties: the leftmost
    width = 1
    while width * 2 <= REACH + 1:
        least[: n - width] = np.minimum(least[: n - width], least[width:])
        width *= 2
    if (left := REACH + 1 - width) > 0:
        least[: n - left] = np.minimum(least[: n - left], least[left:])
    anchor = (least[at] & places).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    new = np.flatnonzero(new)
    first, last, anchor = at[new], np.append(at[new[1:] - 1], at[-1]), anchor[new]
    window = _gram_hashes(x, SPAN)
    shape = ((anchor - first) << 8 | (last - first)).astype(np.uint64)
    context = mix(mix(window[first]) * np.uint64(3) + window[last] + shape * CHAIN)
    return first, last, anchor, gram[anchor], context


def merged(spans: np.ndarray) -> np.ndarray:
    """(n, 2) intervals -> their union, in order and apart."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _by_text(text: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(text):
        return
    order = np.argsort(text, kind="stable")
    text, columns = text[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    for a, b in zip(edges, np.append(edges[1:], len(text)), strict=True):
        yield int(text[a]), [c[a:b] for c in columns]


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """windows: (n, SPAN) bytes -> their order, and the LCP array: how many bytes (SPAN at most) each shares with the one before it."""
    n = len(windows)
    padded = np.zeros((n, -(-SPAN // 8) * 8), np.uint8)
    padded[:, :SPAN] = windows
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    lcp = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):  # by stretches: a comparison takes SPAN bytes for each
        some = order[at - 1 : at + (1 << 16)]
        differ = windows[some[1:]] != windows[some[:-1]]
        lcp[at : at + len(differ)] = np.where(differ.any(1), differ.argmax(1), SPAN)
    return order, lcp


def smaller_before(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """In suffix order: how far each entry matches the previous entry of a smaller rank (0: there is none).

    The previous smaller position is found by jumps: from an entry that isn't smaller, to the one it has found so far; all between are not
    smaller either.  An entry whose match has fallen under SPAN stops, for it can't reach SPAN any more: its value is an upper bound."""
    at, reach = np.arange(len(rank)) - 1, lcp.copy()
    open_ = np.flatnonzero((at >= 0) & (reach >= SPAN))
    while len(open_):
        open_ = open_[rank[at[open_]] >= rank[open_]]
        via = at[open_]
        reach[open_] = np.minimum(reach[open_], np.where(at[via] >= 0, reach[via], 0))
        at[open_] = at[via]
        open_ = open_[(at[open_] >= 0) & (reach[open_] >= SPAN)]
    return reach


def longest_previous(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array: how far each window matches a window of a smaller document, exact from SPAN on.

    That match is at the previous or the next position of a smaller document in suffix order, whichever shares more."""
    n = len(windows)
    order, lcp = suffix_order(windows)
    rank = np.unique(docs, return_inverse=True)[1][order]
    before = smaller_before(rank, lcp)
    after = smaller_before(rank[::-1], np.concatenate(([0], lcp[:0:-1])))[::-1] if n else before
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def removed_spans(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) -> row, spans (packed int32 pairs): what to remove; rows without are left out.  row: a 64-bit key of the row."""
    buckets, own = input_partitions(docs, BUCKET_BYTES), Scratch(docs.sparkSession, "suffix")
    kinds = [k for _, k in OCCURRENCE]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(slices(batches, SLICE_BYTES)):
            rows, ids, texts = (b.column(i).to_pylist() for i in range(3))
            order = sorted((i for i in range(b.num_rows) if texts[i] and len(texts[i]) >= SPAN), key=lambda i: ids[i])
            first_of: dict[bytes, int] = {}
            whole: list[int] = []  # copies of an earlier document's text
            own: list[int] = []
            for i in order:
                j = first_of.setdefault(texts[i], i)
                if ids[j] < ids[i]:
                    whole.append(i)
                else:
                    own.append(i)
            name = int(np.array([hash_of(rows)], np.uint64).view(np.int64)[0])
            local = [np.empty((0, 3), np.int32)]
            local.append(np.array([(i, 0, len(texts[i])) for i in whole], np.int32).reshape(-1, 3))
            if own:
                text, first, last, anchor, key, context = find_occurrences([texts[i] for i in own])
                doc = np.array([ids[i] for i in own], np.int64)[text]
                text = np.array(own, np.int32)[text]
                order_ = np.lexsort((doc, context, key))
                k_, c_, d_ = key[order_], context[order_], doc[order_]
                new = np.concatenate(([True], (k_[1:] != k_[:-1]) | (c_[1:] != c_[:-1])))
                late = d_ > d_[np.flatnonzero(new)][np.cumsum(new) - 1]
                gone = order_[late]
                local.append(np.stack([text[gone], first[gone], last[gone] + SPAN], axis=1))
                stay = np.sort(order_[~late])
                columns = [key[stay], context[stay], doc[stay], text[stay], first[stay], (last - first)[stay].astype(np.uint8), (anchor - first)[stay].astype(np.uint8)]
                bucket = (mix(columns[0]) % np.uint64(buckets)).astype(np.int32)
                by = np.argsort(bucket, kind="stable")
                bucket, columns = bucket[by], [c[by] for c in columns]
                edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                for a, e in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                    yield row_batch(int(bucket[a]), name, pack_columns([c[a:e] for c in columns]))
            spans = np.concatenate(local)
            table = [np.array(rows, np.int64)]
            yield row_batch(buckets + name % buckets, name, pack_columns(table))
            yield row_batch(buckets + name % buckets, name, b"i" + pack_columns([spans[:, 0], spans[:, 1], spans[:, 2]]))

    def row_batch(bucket: int, name: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "slice", "blob"])

    def met(table: pa.Table) -> pa.Table:
        """One bucket's occurrences -> per slice, what is removed whole (r) and what is asked for (q)."""
        names = table["slice"].to_pylist()
        blobs = table["blob"].to_pylist()
        out: list[tuple[int, bytes]] = []
        if table["bucket"][0].as_py() >= buckets:
            out = [(n, x if x[:1] == b"i" else b"t" + x) for n, x in zip(names, blobs, strict=True)]
        else:
            parts = [unpack_columns(x, kinds) for x in blobs]
            of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            key, context, doc, text, start, more, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            k_ = key[order]
            shared = np.zeros(len(k_), bool)
            shared[1:] = k_[1:] == k_[:-1]
            shared[:-1] |= shared[1:]
            order = order[shared]
            order = order[np.lexsort((doc[order], context[order], key[order]))]
            k_, c_, d_ = key[order], context[order], doc[order]
            new_key = np.concatenate(([True], k_[1:] != k_[:-1]))[: len(k_)]
            new = new_key | np.concatenate(([True], c_[1:] != c_[:-1]))[: len(k_)]
            if len(k_):
                late = d_ > d_[np.flatnonzero(new)][np.cumsum(new) - 1]
                group = np.cumsum(new_key) - 1
                heads = np.flatnonzero(new_key)
                several = (np.add.reduceat(new.astype(np.int64), heads) > 1) & (np.minimum.reduceat(d_, heads) < np.maximum.reduceat(d_, heads))
                gone, asked = order[late], order[~late & several[group] & (d_ >= np.minimum.reduceat(d_, heads)[group])]
                for kind, rows in ((b"r", gone), (b"q", asked)):
                    for n, (r,) in _by_text(of[rows], rows):
                        columns = [text[r], start[r], more[r]] + ([offset[r], key[r]] if kind == b"q" else [])
                        out.append((names[n], kind + pack_columns(columns)))
        return pa.table({"slice": pa.array([n for n, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def per_text(table: pa.Table) -> pa.Table:
        """One slice's answers -> per row: merged spans, and what is asked for."""
        rows, spans, asked = None, [np.empty((0, 3), np.int64)], []
        for blob in table["blob"].to_pylist():
            kind, blob = blob[:1], blob[1:]
            if kind == b"t":
                rows = unpack_columns(blob, [np.int64])[0]
            elif kind == b"i":
                spans.append(np.stack(unpack_columns(blob, [np.int32] * 3), axis=1))
            elif kind == b"r":
                text, start, more = unpack_columns(blob, [np.int32, np.int32, np.uint8])
                spans.append(np.stack([text, start, start + more.astype(np.int32) + SPAN], axis=1))
            else:
                asked.append(unpack_columns(blob, [np.int32, np.int32, np.uint8, np.uint8, np.uint64]))
        found: dict[int, list] = {}
        every = np.concatenate(spans)
        for t, (a, e) in _by_text(every[:, 0], every[:, 1], every[:, 2]):
            found.setdefault(t, [None, None])[0] = merged(np.stack([a, e], axis=1)).astype(np.int32).tobytes()
        if asked:
            for t, columns in _by_text(*(np.concatenate(c) for c in zip(*asked, strict=True))):
                found.setdefault(t, [None, None])[1] = pack_columns(columns)
        return pa.table({"row": pa.array([int(rows[t]) for t in found], pa.int64()), "spans": pa.array([x[0] for x in found.values()], pa.binary()), "asked": pa.array([x[1] for x in found.values()], pa.binary())})

    sent = docs.where("doc_id is not null").select("row", "doc_id", "text").mapInArrow(dealt, "bucket int, slice long, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(met, "slice long, blob binary")
    whole = own.write(answers.groupBy("slice").applyInArrow(per_text, "row long, spans binary, asked binary"), "suffix")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, SLICE_BYTES):
            parts: list[list[np.ndarray]] = []
            for row, doc, packed, asked in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                start, more, offset, key = unpack_columns(asked, [np.int32, np.uint8, np.uint8, np.uint64])
                raw = unzip(packed)
                text = np.concatenate([np.zeros(REACH, np.uint8), np.frombuffer(raw, np.uint8), np.zeros(SPAN, np.uint8)])
                anchor = start.astype(np.int64) + offset
                parts.append([key, np.full(len(key), doc, np.int64), np.full(len(key), row, np.int64), start, more, offset, np.lib.stride_tricks.sliding_window_view(text, REACH + SPAN)[anchor]])
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                bucket = (mix(columns[0]) % np.uint64(buckets)).astype(np.int32)
                for n, (r,) in _by_text(bucket, np.arange(len(bucket))):
                    yield row_batch(n, 0, pack_columns([c[r] if c.ndim == 1 else np.ascontiguousarray(c[r]).view(f"V{REACH + SPAN}").ravel() for c in columns]))

    def decided(table: pa.Table) -> pa.Table:
        parts = [unpack_columns(x, [np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8, f"V{REACH + SPAN}"]) for x in table["blob"].to_pylist()]
        key, doc, row, start, more, offset, text = (np.concatenate(c) for c in zip(*parts, strict=True))
        text = np.frombuffer(text.tobytes(), np.uint8).reshape(len(key), REACH + SPAN)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        out_row, out_span = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
        at = 0
        while at < len(edges):  # whole anchors at a time, of bounded memory unless one anchor is larger
            end = int(np.searchsorted(edges, edges[at] + 20_000, side="left"))
            end = max(at + 1, min(end, len(edges)))
            pick = order[edges[at] : edges[end] if end < len(edges) else len(order)]
            at = end
            count = more[pick].astype(np.int64) + 1
            of = np.repeat(pick, count)
            step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            begin = REACH - offset[of].astype(np.int64) + step
            windows = np.lib.stride_tricks.sliding_window_view(text, SPAN, axis=1)[of, begin]
            gone = longest_previous(windows, doc[of]) >= SPAN
            out_row.append(row[of[gone]])
            begin = start[of[gone]].astype(np.int64) + step[gone]
            out_span.append(np.stack([begin, begin + SPAN], axis=1))
        rows_, spans_ = np.concatenate(out_row), np.concatenate(out_span)
        found = [(int(r), merged(np.stack([a, e], axis=1)).astype(np.int32).tobytes()) for r, (a, e) in _by_key(rows_, spans_)]
        return pa.table({"row": pa.array([r for r, _ in found], pa.int64()), "spans": pa.array([s for _, s in found], pa.binary())})

    texts = zipped(docs.where("doc_id is not null").select("row", "doc_id", "text"), "text")
    asking = texts.join(whole.where("asked is not null").select("row", "asked").hint("shuffle_hash"), "row").select("row", "doc_id", "packed", "asked")
    more = asking.mapInArrow(contexts, "bucket int, slice long, blob binary").groupBy("bucket").applyInArrow(decided, "row long, spans binary")
    return whole.where("spans is not null").select("row", "spans").unionAll(more).groupBy("row").agg(F.collect_list("spans").alias("spans"))


def _by_key(keys: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    yield from _by_text(keys, spans[:, 0], spans[:, 1])


def hash_of(rows: list[int]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(np.array(rows, np.int64).tobytes())


def keyed(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, text in bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    rows = keyed(docs)
    spans = removed_spans(rows)
    joined = zipped(rows, "text").join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, SLICE_BYTES):
            kept, size, gone, count = [], [], [], []
            for packed, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, cuts = unzip(packed), []
                if found:
                    cuts = merged(np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in found])).tolist()
                parts, at = [], 0
                for a, e in cuts:
                    parts.append(text[at:a])
                    at = e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                size.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                count.append(len(cuts))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64())})

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256) by a table of all windows; for tests, on distinct doc_ids."""
    first: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i, t in sorted(texts.items()):
        for at in range(len(t) - SPAN + 1):
            first.setdefault(t[at : at + SPAN], i)
    out = {}
    for i, t in texts.items():
        gone = merged(np.array([(at, at + SPAN) for at in range(len(t) - SPAN + 1) if first[t[at : at + SPAN]] < i], np.int64).reshape(-1, 2)).tolist()
        kept, at = b"", 0
        for a, e in gone:
            kept, at = kept + t[at:a], e
        kept += t[at:]
        out[i] = (len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    return out
