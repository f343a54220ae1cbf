import hashlib
import re

import pytest

from tessera.llm import decontaminate as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    """n_words, hit positions, items: every window of every item at every place."""
    words = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        if not v:
            continue
        size = min(10, len(v))
        for i in range(len(v) - size + 1):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit |= set(range(j, j + size))
                    if name is not None:
                        found.add(str(name))
    return len(w), hit, sorted(found)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then runs away home"), (2, "a b c"), (10, "b c d e f g h i j k l m"), (3, ""), (4, None), (None, "nameless item here"), (2, "a b c"), (5, "x x x x x x x x x x x"), (6, "it")]
TEXTS = [
    "say: THE quick, brown fox jumps over the lazy dog and then runs away HOME now", "a b c d e f g h i j k l m n", "a b", "", None, "x " * 30, "it, a b c it", "quick brown fox jumps over the lazy dog and", "nameless item here", "é1 \x80 b c d e f g h i j k", "!!!",
    "the quick brown fox the quick brown fox jumps over the lazy dog and then",
]


@pytest.mark.parametrize("part_words", [d.PART_WORDS, 12, 5])
def test_equals_brute_force(spark, documents, part_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = list(enumerate(TEXTS)) + [(3, "a b c"), (3, "a b c"), (None, "a b c")]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in d.hits(documents(rows), items, part_words=part_words).collect()), key=repr)
    want = []
    for i, t in rows:
        n, hit, found = brute(t, ITEMS)
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1] = (spans[-1][0], p + 1)
            else:
                spans.append((p, p + 1))
        want.append((i, n, hit, found))
        assert all(any(a <= p < b for a, b in spans) for p in hit)
    covered = [(i, n, {p for a, b in s for p in range(a, b)}, f) for i, n, s, f in got]
    assert covered == sorted(want, key=repr)


def test_corpus_with_its_own_sentences(spark, documents, corpus):
    items = [(k, " ".join((t or "").split()[3:20])) for k, (_, t) in enumerate(corpus[:12])]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in d.report(documents(corpus), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in corpus:
        if t and len(t) > 5000:
            continue
        n, hit, found = brute(t, items)
        assert got[i] == (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)), i


def test_clean_cuts_passages_and_keeps_columns(spark, documents):
    passage = "the quick brown fox jumps over the lazy dog and then runs"
    docs = documents([(1, f"Before. {passage}, after!"), (2, "clean text"), (3, None), (4, passage), (5, "")])
    out = d.clean(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("Before. , after!", 16), 2: ("clean text", 10), 3: (None, None), 4: ("", 0), 5: ("", 0)}


def test_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert d.report(documents([(1, "x")]).limit(0), items).count() == 0
    assert d.report(documents([(1, "a b c")]), items.limit(0)).first()["contaminated"] is False
    assert d.clean(documents([(1, "a b c")]), items.limit(0)).first()["text"] == "a b c"


def test_clean_in_parts_equals_one_part(spark, documents):
    long, fill = "the quick brown fox jumps over the lazy dog and then runs", lambda n: " ".join(f"w{i}" for i in range(n))
    items = spark.createDataFrame([(1, "p q r s t u"), (2, "a b c d e f"), (3, long), (4, "dog and then runs far away from here to there at once")], "item_id long, text string")
    rows = [(1, f"p q r s t u {fill(88)} a b c d e f"), (2, f"x {long} far away from here to there at once y"), (3, f"{fill(94)} p q r s t u"), (4, None), (5, "clean text"), (6, f"{fill(40)} p q r s t u a b c d e f {fill(400)}")]
    one, several = ({r["doc_id"]: (r["text"], r["n_chars"]) for r in d.clean(documents(rows), items, part_words=n).collect()} for n in (d.PART_WORDS, 12))
    assert one == several and several[1][0] == f" {fill(88)} " and several[2][0] == "x  y" and several[3][0] == rows[2][1] and several[6][0] == f"{fill(40)}  {fill(400)}"
    by_item = {r["doc_id"]: r["text"] for r in d.clean(documents(rows), items, part_words=6).collect()}
    assert by_item == {i: t for i, (t, _) in one.items()}
