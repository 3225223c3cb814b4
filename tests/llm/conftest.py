import random

import pytest

WORDS = "lo mira tan sol peru vinta karo bel dost ume rapi gol nest arvi tollo bremma quist".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _doc string, found string, doc string"


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", "a", "en", "is"]))
        if i % 17 == 16:
            out[-1] += ".\n"
    return " ".join(out)


def rows_of():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and columns with clashing names."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(3, 160)) for _ in range(60)]
    shared = prose(rng, 30)
    texts += [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(8)]
    base = prose(rng, 200).split(" ")
    for k in range(12):
        words = list(base)
        for at in rng.sample(range(len(words)), k % 4):
            words[at] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[1], "  " + texts[2].replace(" ", "  "), "", None, " \n\t ", "one", "x" * 5000, prose(rng, 40_000)]
    rows = [(i, t, "ab"[i % 2], None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), "q", "w", "e", "r") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[3], None, None, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
