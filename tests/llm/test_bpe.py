import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")

from tessera.llm import bpe  # noqa: E402
from tessera.llm.queries import tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def codec():
    path, pattern = tokenizer()
    return bpe.Codec(bpe.read_ranks(path), pattern)


@pytest.fixture(scope="module")
def encoding():
    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_every_code_point(codec, encoding):
    points = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c} {c}1" for c in points[i : i + 1000]) for i in range(0, len(points), 1000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_random_and_long_words(codec, encoding):
    rng = random.Random(1)
    texts = ["", "a", "=" * 4000, "ab" * 500, " " * 200, "".join(rng.choice("abcdefgh") for _ in range(1500)), "it's 12345 ½ <|endoftext|>"]
    texts += ["".join(rng.choice("aàb c\n\t1.,'sé🎉") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [encoding.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_words_in_chunks(codec, encoding):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "".join(rng.choice("ab") for _ in range(9000)), "".join(rng.choice(["the", "ing", "x"]) for _ in range(3000))]
    words += [(p * 9000)[:n] for p in ("a", "abc", "theand", "é", "日本語x") for n in (2001, 9000)] + ["a" * 3000 + "b" + "a" * 2501]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(words)] == [encoding.encode_ordinary(w) for w in words]


def test_a_word_of_ten_megabytes(codec):
    word = "ab" * 5_000_000
    (ids,) = codec.encode([word])
    assert codec.decode([ids]) == [word.encode()] and len(set(np.frombuffer(ids, "<u4")[100:-100].tolist())) == 1


def test_ids_in_slices(codec, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_IDS", 3)
    texts = ["one two three four", "", "five"]
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]


def test_words_are_forgotten_and_learnt_again(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    path, pattern = tokenizer()
    small = bpe.Codec(bpe.read_ranks(path), pattern)
    for t in ("qwxz plovv zzkq", "plovv brrt", "qwxz brrt plovv"):
        assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == encoding.encode_ordinary(t)


def test_round_trip_of_a_table(spark, documents, corpus, encoding):
    rows = [*corpus, corpus[0], (None, "no id")]
    got = sorted(map(tuple, bpe.round_trip(documents(rows), *tokenizer()).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encoding.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_encode_then_decode(spark, documents, corpus):
    encoded = bpe.encode(documents(corpus[:20]), *tokenizer())
    got = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, *tokenizer()).collect()}
    assert got == {i: (t or "").encode() for i, t in corpus[:20]}


def test_empty_table(spark, documents):
    assert bpe.round_trip(documents([(1, "x")]).limit(0), *tokenizer()).count() == 0


def test_bound_of_the_broadcast(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_RANKS", 10)
    with pytest.raises(ValueError):
        bpe.read_ranks(tokenizer()[0])


def test_slices_hold_words_of_like_length(monkeypatch):
    """A slice takes as many steps as its longest word, so short words don't share one with long ones."""
    codec = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}, r"\S+")
    words = [b"ab" * (1 + i % 2 * 39) for i in range(40)]
    taken, whole = [], codec._contract
    monkeypatch.setattr(bpe, "SLICE_BYTES", 60)
    monkeypatch.setattr(codec, "_contract", lambda part, query: taken.append(set(map(len, part))) or whole(part, query))
    made = codec._contracted(words, bpe.CONTRACT)
    assert [x.tolist() for x in made] == [[256] if len(w) == 2 else [257] * 20 for w in words]
    assert all(len(x) == 1 for x in taken)


def test_short_words_are_rows():
    """A step works on a row of each word and looks up the two pairs that are new, not all tokens of all words; leftmost places come first."""
    rng = random.Random(3)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 320:
        a, b = rng.choice([*ranks][256:] or [b"a"]), rng.choice([b"a", b"b", b"c", *[*ranks][256:]])
        ranks.setdefault(rng.choice([a + b, b + a, rng.choice([b"ab", b"bc", b"ca", b"aa"])]), len(ranks))
    words = [b"", b"a", b"z"] + [bytes(rng.choices(b"abc", k=rng.randint(1, 60))) for _ in range(300)]
    codec = bpe.Codec(ranks, r"\S+")

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while made := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]:
            i = min(made)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    assert [x.tolist() for x in codec._contracted(words, bpe.CONTRACT)] == list(map(plain, words))
    lengths = np.array(list(map(len, words)))
    assert codec._listed(np.frombuffer(b"".join(words), np.uint8), lengths).num_rows == len(words)
