"""Byte-level BPE encoding and decoding by DuckDB, one in-process database per Python worker.

A batch's distinct words become rows of their tokens and of the ranks of neighbouring tokens.  A recursive query contracts each word's leftmost
pair of least rank, and joins the two pairs that are new by that to the merge table, until no pair is left.  Decoding joins ids to their
bytes and aggregates in order of position.  Words of over `LONG` bytes are token-position rows: where no pair that a merge makes new can rank
below it (checked in the rank file), all its places are contracted in one step, so long repetitive words take few rounds, and an ordered
aggregation gathers the ids; the result is the same.

A word of over `CHUNK` bytes is contracted in chunks, in time linear in its bytes, and stitched.  A sequence of tokens is a word's encoding if
and only if each two neighbours are the encoding of their joint bytes: the first merge across a border that the sequence lacks would also be
made in those two alone.  So only chunks' borders are checked; where a border fails, the tokens around it are contracted anew, over
more of the right side each time in a row (up to `WIDE` bytes), until both ends fit.

The rank file is read on the driver and broadcast: its size is fixed by the vocabulary and checked against `MOST_RANKS`.  Memory: texts are
taken in slices of `SLICE_CHARS`, words in slices of `SLICE_BYTES`, and a worker remembers up to `REMEMBERED` encoded words (a hot word is
encoded once).  No shuffle; a lost executor's partitions are simply run again.

Nulls: a null text is empty (no ids); a null doc_id is kept.  Repeated rows come back repeated; extra columns are not read; an empty table
gives an empty result.  A single word of n bytes holds its n bytes and up to 4 n bytes of ids beside the slices.
"""

from __future__ import annotations

import base64
import hashlib
import threading
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices, trim

MOST_RANKS = 1_000_000
SLICE_CHARS = 3_000_000
SLICE_BYTES = 250_000
SLICE_IDS = 500_000
REMEMBERED = 300_000
LONG = 200
CHUNK, WIDE = 2_000, 64_000
#: Bytes of the chunks of long words, and tokens on each side of a border that are contracted anew.
PIECE, AROUND = 96, 6

#: No pair of this rank.
NONE = 2**31 - 1

#: Rows of `words` (w, ids, ranks) to rows (w, ids).  ids: a word's tokens between two of -1; ranks: what each token and the next merge into, or
#: NONE; m: the least of ranks, of which list_position gives the leftmost.  A step makes two new pairs in a word, which are all that is looked up.
CONTRACT = f"""
with recursive step as (
  select w, ids, ranks, list_min(ranks) m from words
  union all
  select w, ids, ranks, list_min(ranks)
  from (
    select w, list_concat(ids[:p - 1], [m], ids[p + 2:]) ids, list_concat(ranks[:p - 2], [coalesce(f.r, {NONE}), coalesce(g.r, {NONE})], ranks[p + 2:]) ranks
    from (select w, ids, ranks, m, p, ids[p - 1] before, ids[p + 2] after from (select *, list_position(ranks, m) p from step where m < {NONE})) s
    left join merges f on f.a = s.before and f.b = s.m
    left join merges g on g.a = s.m and g.b = s.after))
select w, ids[2:len(ids) - 1] ids from step where m = {NONE}
"""

#: Rows of `start` (w, pos, id) to rows (w, ids), for long words: every place of a safe merge in a step.  r: twice the rank that the pair at pos merges into, one more if that merge isn't safe
#: to repeat within a step; m: the least r of the word, null at the fixpoint.
CONTRACT_LONG = """
with recursive step as (
  select w, pos, id, r, min(r) over (partition by w) m
  from (select p.w, p.pos, p.id, g.r from (select *, lead(id) over (partition by w order by pos) nxt from start) p left join long_merges g on g.a = p.id and g.b = p.nxt)
  union all
  select w, pos, id, r, min(r) over (partition by w) m
  from (
    select p.w, p.pos, p.id, g.r
    from (
      select w, pos, id, lead(id) over (partition by w order by pos) nxt
      from (
        select w, pos, case when hit then m // 2 else id end id
        from (
          select *, coalesce(lag(hit) over (partition by w order by pos), false) eaten
          from (
            select w, pos, id, m, r is not distinct from m and case
              when m % 2 = 1 then n = min(case when r = m then n end) over (partition by w)
              else (n - coalesce(max(case when r is distinct from m then n end) over (partition by w order by n), 0)) % 2 = 1 end hit
            from (select *, row_number() over (partition by w order by pos) n from step where m is not null)))
        where not eaten)) p
    left join long_merges g on g.a = p.id and g.b = p.nxt))
select w, list(id order by pos) ids from step where m is null group by w
"""

#: A piece holds its bytes as the characters of the same numbers.
GATHER = "select d, string_agg(piece, '' order by pos) chars from tokens join vocab using (id) group by d"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank, a line each."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks; the broadcast is bounded to {MOST_RANKS}")
    return ranks


class Codec:
    """Encoder and decoder of one rank file, with its DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.bytes_of = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.rank_of = np.array([ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        rows = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        made = np.array(rows, np.int64).reshape(-1, 3)
        least = np.full(max(ranks.values()) + 1, 1 << 60)
        np.minimum.at(least, made[:, 0], made[:, 2])
        np.minimum.at(least, made[:, 1], made[:, 2])
        code = made[:, 2] * 2 + (least[made[:, 2]] < made[:, 2])
        merges = pa.table({"a": made[:, 0].astype(np.int32), "b": made[:, 1].astype(np.int32), "r": made[:, 2].astype(np.int32)})
        long_merges = merges.set_column(2, "r", pa.array(code.astype(np.int32)))
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})
        for name, table in (("merges", merges), ("long_merges", long_merges), ("vocab", vocab)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def _listed(self, raw: np.ndarray, lengths: np.ndarray) -> pa.Table:
        """Rows of `CONTRACT`: each word's bytes as tokens, and the ranks of their pairs."""
        n = len(lengths)
        of, ends = np.repeat(np.arange(n), lengths), np.cumsum(lengths)
        pairs = np.full(len(raw), NONE, np.int32)
        pairs[:-1] = self.rank_of[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        pairs[ends[lengths > 0] - 1] = NONE
        columns = []
        for beside, rest, values in ((2, -1, self.bytes_of[raw]), (1, NONE, pairs)):
            flat = np.full(len(raw) + beside * n, rest, np.int32)
            flat[np.arange(len(raw)) + beside * of + 1] = values
            offsets = np.concatenate(([0], ends + beside * np.arange(1, n + 1))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        return pa.table({"w": np.arange(n, dtype=np.int32), "ids": columns[0], "ranks": columns[1]})

    def _contract(self, words: list[bytes], query: str) -> Iterator[tuple[int, bytes]]:
        lengths, raw = np.fromiter(map(len, words), np.int64, len(words)), np.frombuffer(b"".join(words), np.uint8)
        if query == CONTRACT:
            name, table = "words", self._listed(raw, lengths)
        else:
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            name, table = "start", pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": pos.astype(np.int32), "id": self.bytes_of[raw]})
        self.db.register(name, table)
        out = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister(name)
        if not out.num_rows:
            return
        ids = out["ids"].chunk(0)
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
        for w, a, b in zip(out["w"].to_pylist(), at[:-1], at[1:], strict=True):
            yield w, flat[a:b]

    def _in_slices(self, words: list[bytes], query: str) -> Iterator[tuple[int, bytes]]:
        """(number of a word, its ids); words in slices of `SLICE_BYTES`, by length: a slice takes as many steps as its longest word."""
        lengths = list(map(len, words))
        order = sorted(range(len(words)), key=lengths.__getitem__)
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + lengths[order[end]] <= SLICE_BYTES):
                size += lengths[order[end]]
                end += 1
            for w, ids in self._contract([words[i] for i in order[at:end]], query):
                yield order[at + w], ids
            at = end

    def _contracted(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(words)
        for i, ids in self._in_slices(words, query):
            out[i] = np.frombuffer(ids, "<u4")
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def _fit(self, pairs: list[tuple[int, int]]) -> None:
        """Learn which pairs of tokens are the encoding of their joint bytes."""
        new = [p for p in dict.fromkeys(pairs) if p not in self.fits]
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
            new = list(dict.fromkeys(pairs))
        made = self._contracted([self.tokens[a] + self.tokens[b] for a, b in new], CONTRACT)
        for (a, b), ids in zip(new, made, strict=True):
            self.fits[a, b] = ids.tolist() == [a, b]

    def _stitched(self, word: bytes) -> bytes:
        """The ids of a long word from those of its chunks."""
        pieces = self._contracted([word[i : i + PIECE] for i in range(0, len(word), PIECE)], CONTRACT_LONG)
        # all borders at once: where the tokens around one, contracted anew, fit on both sides, they replace it
        self._fit([(int(a[-1]), int(b[0])) for a, b in pairwise(pieces)])
        bad = [i for i, (a, b) in enumerate(pairwise(pieces)) if not self.fits[int(a[-1]), int(b[0])] and len(a) > 2 * AROUND + 1 and len(b) > 2 * AROUND + 1]
        made = self._contracted([self._bytes(np.concatenate([pieces[i][-AROUND:], pieces[i + 1][:AROUND]])) for i in bad], CONTRACT_LONG)
        ends = [((int(pieces[i][-AROUND - 1]), int(m[0])), (int(m[-1]), int(pieces[i + 1][AROUND]))) for i, m in zip(bad, made, strict=True)]
        self._fit(list(chain.from_iterable(ends)))
        good = {i: m for i, m, (p, q) in zip(bad, made, ends, strict=True) if self.fits[p] and self.fits[q]}
        runs = []
        for i, x in enumerate(pieces):
            runs.append(x[AROUND if i - 1 in good else 0 : len(x) - (AROUND if i in good else 0)])
            if i in good:
                runs.append(good[i])
        # what is left, from left to right: `done` is the encoding of the bytes before
        done, row = [runs[0]], 0
        at = 1
        while at < len(runs):
            border = (int(done[-1][-1]), int(runs[at][0]))
            self._fit([border])
            if self.fits[border]:
                done.append(runs[at])
                at, row = at + 1, 0
                continue
            right, size = [], 0
            while at < len(runs) and (not right or size < PIECE << row):
                right.append(self._bytes(runs[at]))
                size += len(right[-1])
                at += 1
            row += (PIECE << row) < WIDE
            back, left = AROUND, []
            while True:
                held = sum(map(len, left))
                while held < back and done:
                    left.insert(0, done.pop())
                    held += len(left[0])
                near = np.concatenate(left)
                if len(near) > back:  # the rest stays
                    done.append(near[:-back])
                    near = near[-back:]
                new = self._contracted([self._bytes(near) + b"".join(right)], CONTRACT_LONG)[0]
                if not done:
                    break
                border = (int(done[-1][-1]), int(new[0]))
                self._fit([border])
                if self.fits[border]:
                    break
                left, back = [near], 2 * back
            done.append(new)
        return np.concatenate(done).astype("<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Encode what isn't known yet, in slices of bounded size; the last two generations of words are remembered."""
        todo: list[tuple[str, bytes]] = []
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        for word in words:
            if word in self.known:
                continue
            if (old := self.older.get(word)) is not None:
                self.known[word] = old
                continue
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
            else:
                todo.append((word, raw))
        huge = [x for x in todo if len(x[1]) > CHUNK]
        for few, query in (([x for x in todo if len(x[1]) <= LONG], CONTRACT), ([x for x in todo if LONG < len(x[1]) <= CHUNK], CONTRACT_LONG)):
            for i, ids in self._in_slices([raw for _, raw in few], query):
                self.known[few[i][0]] = ids
        for word, raw in huge:
            self.known[word] = self._stitched(raw)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each sequence's bytes; ids are taken in slices of `SLICE_IDS`, which may cut a sequence."""
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        of = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        whole: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), SLICE_IDS):
            part = slice(at, at + SLICE_IDS)
            self.db.register("tokens", pa.table({"d": of[part], "pos": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            out = self.db.sql(GATHER).to_arrow_table()
            self.db.unregister("tokens")
            for d, chars in zip(out["d"].to_pylist(), out["chars"].to_pylist(), strict=True):
                whole[d].append(chars.encode("latin-1"))
        return list(map(b"".join, whole))


_CODECS: dict[tuple[int, str], Codec] = {}
#: A worker that has had no texts to encode for so many seconds gives its codec back: later stages need the memory.
IDLE_S = 4
_TIMERS: list[threading.Timer] = []


def _forget() -> None:
    _CODECS.clear()
    trim()


def _rest(idle: bool) -> None:
    """Start or stop the wait for the next partition."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    if idle:
        _TIMERS.append(threading.Timer(IDLE_S, _forget))
        _TIMERS[-1].daemon = True
        _TIMERS[-1].start()


def _codec(shared, pattern: str) -> Codec:
    key = (id(shared.value), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _mapped(docs: DataFrame, column: str, ranks_path: str, pattern: str, schema: str, work) -> DataFrame:
    """work(codec, values) -> columns beside doc_id, over slices of (doc_id, column)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _rest(False)
        codec = _codec(shared, pattern)
        for b in slices(batches, SLICE_CHARS):
            columns = work(codec, [x or type(x or "")() for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | columns)
        _rest(True)

    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids (little-endian unsigned 32-bit integers in one binary)."""

    def work(codec: Codec, texts: list[str]) -> dict:
        ids = codec.encode(texts)
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    return _mapped(docs, "text", ranks_path, pattern, "n_tokens long, ids binary", work)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, bytes; null ids are empty."""

    def work(codec: Codec, ids: list) -> dict:
        return {"bytes": pa.array(codec.decode([x or b"" for x in ids]), pa.binary())}

    return _mapped(encoded, "ids", ranks_path, pattern, "bytes binary", work)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids, and return both digests: doc_id, n_tokens, ids_sha256, decoded_sha256.  One pass: ids don't leave the worker."""

    def work(codec: Codec, texts: list[str]) -> dict:
        ids = codec.encode(texts)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": list(map(sha, ids)), "decoded_sha256": list(map(sha, codec.decode(ids)))}

    return _mapped(docs, "text", ranks_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
