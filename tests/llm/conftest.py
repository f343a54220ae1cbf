import random

import pytest

#: Columns that clash with names the operators use within.
EXTRA = "row long, item long, spans string, cuts string, size int, packed string, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """rows of (doc_id, text) -> a documents table with extra columns."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t), 1, 2, "x", "y", 3, "z", "l") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Prose with near copies, exact copies, a shared passage, empty and null texts, a null id, and one very long text."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßtrn") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    rows, texts = [], []
    for i in range(90):
        kind = i % 6
        if kind == 0 or not texts:
            t = "\n".join(prose(rng.randint(12, 50)) for _ in range(rng.randint(1, 4)))
        elif kind == 1:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        elif kind == 2:
            t = rng.choice(texts)
        elif kind == 3:
            t = prose(rng.randint(5, 30)) + "\n" + passage + "\n" + prose(rng.randint(5, 30))
        elif kind == 4:
            t = prose(rng.randint(1, 8))
        else:
            t = "\n".join(prose(rng.randint(20, 60)) for _ in range(3))
        texts.append(t)
        rows.append((i * 3 + 1, t))
    rows += [(500, ""), (501, None), (502, " \n\t "), (503, "as " * 300), (504, "as " * 300 + "end"), (505, prose(9000)), (506, "\n" * 50), (507, "=" * 3000), (508, "日本語 " * 40), (509, "a"), (510, "a")]
    return rows
