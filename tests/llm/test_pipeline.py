import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as brute_hits  # noqa: E402
from test_near_copies import brute as brute_components  # noqa: E402
from test_near_copies import words_to_cut  # noqa: E402

from tessera.llm import queries, toxicity  # noqa: E402

TABLES = "documents embeddings pages benchmark labels".split()


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def runs(flags):
    """The stretches of set flags."""
    return [(m.start(), m.end()) for m in re.finditer("1+", "".join("1" if f else "0" for f in flags))]


def brute_cut(text, gone):
    """The text without the words that go; a line that loses its end keeps its break, one that goes takes its break along."""
    places = [m.span() for m in re.finditer(r"[^ \t\n\r\f\v]+", text)] + [(len(text), len(text))]
    for a, b in reversed(runs(gone)):
        begin, end = places[a][0], places[b][0]
        starts_line = a == 0 or "\n" in text[places[a - 1][1] : begin]
        left, right = text[:begin] + ("\n" if not starts_line and "\n" in text[begin:end] else ""), text[end:]
        text = left + right if right or text.endswith("\n") else left.removesuffix("\n")
    return text


def brute_clean(text, items):
    n, hit, _ = brute_hits(text, items)
    spans = runs(k in hit for k in range(n))
    if not spans or not (max(b - a for a, b in spans) > 9 or len(hit) > 0.1 * n):
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    for a, b in reversed(spans):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text


def test_run_equals_brute_force(spark, corpus, tmp_path):
    import tiktoken
    from tessera.llm.bpe import read_ranks

    rng = random.Random(11)
    rows = [x for x in corpus if x[0] not in (505, 507)]
    prose = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(k, " ".join(rng.choice(prose).split()[2:20])) for k in range(6)]
    for k in range(60):  # toxic documents and documents with benchmark passages
        words = rng.choice(prose).split(" ")[: rng.randint(10, 60)]
        rng.shuffle(words)
        if k < 45:
            words[rng.randrange(len(words))] = rng.choice(["Grumble!", "snarl", "scoff."])
        else:
            words.insert(rng.randrange(len(words)), items[k % 6][1])
        rows.append((1000 + k, " ".join(words)))
    labels = [(i, 1, int(1000 <= i < 1045)) for i, _ in rows if i % 2 or i >= 1000]
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    for name, columns, table in (("documents", "doc_id text lang source n_chars", full), ("labels", "doc_id quality toxic", labels), ("benchmark", "item_id text", items)):
        pq.write_table(pa.table(dict(zip(columns.split(), map(list, zip(*table, strict=True)), strict=True))), tmp_path / f"{name}.parquet")

    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    assert {"grumble", "snarl", "scoff"} & set(model.weights)
    kept = [(i, t) for i, t in rows if model.score(t) < toxicity.THRESHOLD]
    assert len(rows) - len(kept) >= 10
    component = brute_components(kept)
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    gone = words_to_cut(kept, 50)
    assert any(g.any() for g in gone.values())
    kept = [(i, t if t is None or not gone[i].any() else brute_cut(t, gone[i])) for i, t in kept]
    clean = [(i, None if t is None else brute_clean(t, items)) for i, t in kept]
    assert clean != kept
    path, pattern = queries.tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encoding.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in clean]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
