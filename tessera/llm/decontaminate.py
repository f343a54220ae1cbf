"""Benchmark decontamination by a generalised suffix automaton of the normalised items.

The driver builds one automaton over the items' words (linear in their number) and broadcasts it in parts of at most `PART_WORDS` item
words, each of bounded size; a larger benchmark is taken in several parts, one pass over the texts each.  A text is streamed through it
word by word, keeping the longest match that ends there; a match of ten words or more, or one that ends a short item, is a hit.  Only
stretches of words that the items know, as long as the shortest window, are walked: no other word can be part of a window.  No shuffle
unless there are several parts.

Nulls: a null text, or one without words, has no hits; an item without words has no window; a null item_id counts as an item without a name
in the list.  Items that repeat an item_id are one item.  Repeated rows come back repeated (with several parts: rows are numbered first).
Empty tables give no hits or no rows.  Extra columns are not read, but `clean` keeps those of docs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.llm.common import slices
from tessera.llm.suffix_dedup import merged

WINDOW = 10
PART_WORDS = 300_000
#: Other bytes end a word: 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F after lower-casing A-Z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences; states by number, 0 the root."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        names: list[str | None] = []
        ends: list[tuple[int, int]] = []
        for name, words in items:
            if not words:
                continue
            last, k = 0, len(names)
            names.append(name)
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, k))
        self.names = names
        lengths = [len(w) for _, w in items if w]
        self.least = min([window, *lengths])
        # items of a state: all whose words hold its strings; found from the ends upwards over suffix links
        holds: list[set[int]] = [set() for _ in self.len]
        for state, k in ends:
            while state > 0 and k not in holds[state]:
                holds[state].add(k)
                state = self.link[state]
        self.holds = [tuple(sorted(h)) for h in holds]
        # the state that a match of `window` words or more belongs to, by the state of its longest match
        self.at_window = list(range(len(self.len)))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in order:
            if self.len[self.link[v]] >= window:
                self.at_window[v] = self.at_window[self.link[v]]
        # short items that end here: (length, item) of this state, and of all its suffixes
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.len)
        own: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate((n, w) for n, w in items if w):
            if len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][self.ids[w]]
                own.setdefault(state, []).append((len(words), k))
        for v in order:
            self.short[v] = (*own.get(v, ()), *self.short[self.link[v]])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [from, to) of words, in order and apart, and the items with windows there."""
        n = len(words)
        codes = np.fromiter(map(self.ids.get, words, [-1] * n), np.int32, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0])).astype(np.int8)))
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window
        for a, b in zip(known[::2], known[1::2], strict=True):
            if b - a < self.least:
                continue
            state = size = 0
            for i, c in enumerate(codes[a:b].tolist(), int(a) + 1):
                while c not in nxt[state] and state:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    size += 1
                hit = 0
                if size >= window:
                    hit = size
                    found.update(self.holds[self.at_window[state]])
                for m, k in self.short[state]:
                    if m <= size:
                        hit = max(hit, m)
                        found.add(k)
                if hit:
                    start = i - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i])
        return [tuple(s) for s in spans], found


def automata(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[Automaton]:
    """Automata of the benchmark's items in parts of bounded size; items reach the driver one partition at a time."""
    part: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(text)
        for at in range(0, max(1, len(words)), part_words):  # a very long item is cut with an overlap, so no window is lost
            piece = words[at : at + part_words + window - 1] if len(words) > part_words else words
            if at and len(piece) < window:
                continue
            if part and size + len(piece) > part_words:
                yield Automaton(part, window)
                part, size = [], 0
            part.append((name, piece))
            size += len(piece)
    if part:
        yield Automaton(part, window)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, spans (array of [from, to) word positions), items (array of item_ids as strings, sorted)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    made = "doc_id {}, n_words long, spans array<struct<a:int,b:int>>, items array<string>".format(kind)
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def passed(source: DataFrame, automaton: Automaton | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches):
                n, spans, items = [], [], []
                for text in b.column(1).to_pylist():
                    words = words_of(text)
                    s, f = own.match(words) if own and words else ([], ())
                    n.append(len(words))
                    spans.append([{"a": x, "b": y} for x, y in s])
                    items.append(sorted({own.names[k] for k in f} - {None}) if f else [])
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, span_type), "items": pa.array(items, pa.list_(pa.string()))})

        return source.mapInArrow(run, made)

    parts = automata(benchmark, window, part_words)
    first, second = next(parts, None), next(parts, None)
    if second is None:
        return passed(docs.select("doc_id", "text"), first)
    from tessera.llm.common import materialise

    # rows are numbered in a written table, so that a row's parts meet again even where doc_ids repeat or are null
    rows = materialise(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    made = made.replace(f"doc_id {kind}", "doc_id bigint")
    every = None
    for automaton in (first, second, *parts):
        one = passed(numbered, automaton)
        every = one if every is None else every.unionAll(one)
    grouped = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ordered = grouped.withColumn("spans", F.array_sort("spans"))
    start = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    merged = F.aggregate(
        "spans", start,
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    spans = ordered.select(F.col("doc_id").alias("row"), "n_words", merged.alias("spans"), "items")
    return rows.select("row", "doc_id").join(spans, "row").select("doc_id", "n_words", "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the hit words' spans: each span goes from its first word's start to its last word's end."""
    raw = text.encode()
    mapped = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mapped, [0])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    kept.append(raw[at:])
    return b"".join(kept).decode()


def clean(docs: DataFrame, benchmark: DataFrame, most_words: int = 9, most_coverage: float = 0.1, part_words: int = PART_WORDS) -> DataFrame:
    """docs with contaminated spans cut out of `text` (and n_chars set anew).  A document that holds a span of over most_words words, or has
    over most_coverage of its words in spans, loses them; shorter and rarer matches stay.  Every document stays; one that is cut whole has an
    empty text.  With several parts the spans travel beside the uncut text; after the last part they are merged, judged and cut once."""
    names, at = docs.columns, docs.columns.index("text")
    sized = "n_chars" in names
    beside = next(n for n in ("spans" + "_" * k for k in range(len(names) + 1)) if n not in names)
    span_type = pa.list_(pa.list_(pa.int32()))

    def passed(source: DataFrame, automaton: Automaton, last: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches):
                texts, every = b.column(at).to_pylist(), []
                before = b.column(len(names)).to_pylist() if b.num_columns > len(names) else [[]] * b.num_rows
                for k, text in enumerate(texts):
                    words = words_of(text)
                    spans = own.match(words)[0] if words else []
                    if before[k]:
                        spans = [tuple(s) for s in merged(np.array([*before[k], *spans], np.int64)).tolist()]
                    every.append(spans)
                    if last and spans and (max(y - x for x, y in spans) > most_words or sum(y - x for x, y in spans) > most_coverage * len(words)):
                        texts[k] = clean_text(text, spans)
                columns = {n: b.column(i) for i, n in enumerate(names)}
                if not last:
                    columns[beside] = pa.array([list(map(list, s)) for s in every], span_type)
                else:
                    columns["text"] = pa.array(texts, pa.string())
                    if sized:
                        columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.column(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return source.mapInArrow(run, docs.schema if last else StructType([*docs.schema.fields, StructField(beside, ArrayType(ArrayType(IntegerType())))]))

    out, parts = docs, automata(benchmark, part_words=part_words)
    automaton = next(parts, None)
    while automaton is not None:
        following = next(parts, None)
        out = passed(out, automaton, following is None)
        automaton = following
    return out


#: Word windows as strings, by position; for small inputs.
ORACLE = r"""
with iw as (select item_id, string_split_regex(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') w from benchmark where text is not null),
items as (select item_id, w from iw where not (len(w) = 1 and w[1] = '')),
wins as (select distinct item_id, least(10, len(w)) sz, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items)),
dw as (select doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') w from documents),
d as (select doc_id, case when len(w) = 1 and w[1] = '' then [] else w end w from dw),
grams as (select doc_id, i, sz, array_to_string(list_slice(w, i, i + sz - 1), ' ') g from (select doc_id, w, sz, unnest(range(1, len(w) - sz + 2)) i from d, (select distinct sz from wins))),
m as (select doc_id, i, grams.sz, item_id from grams join wins on grams.sz = wins.sz and grams.g = wins.g),
hit as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + sz)) p from m) group by 1),
it as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from m group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""
