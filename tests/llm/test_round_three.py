"""Byte-level encoding, hard negatives and the filter audit against plain versions."""

import hashlib
import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revsieve.llm import byte_bpe, filter_audit, hard_negatives

# -- byte-level encoding --------------------------------------------------------------

PIECES = ["a", "B", "'s", "'re", "'", "9", "$", "-", " ", "  ", "\n", "\t", "　", "漢", "か", "、", "。", "é", "\x1c", "\x85",
          "​", "한", "\U0001f600", "٣", "²", "_", "`", "@", "x" * 30, " " * 70, "\n" * 60, "7" * 60, "́", "<|endoftext|>"]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding by its definition: the pair of least rank first, from the left."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[k] + parts[k + 1], math.inf), k) for k in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def rank_file():
    with open(byte_bpe.default_path(), "rb") as f:
        return f.read()


def test_cuts_change_nothing(rank_file):
    import public_tokenizers

    cut, whole = byte_bpe.Codec(rank_file, public_tokenizers.PATTERN, 50), byte_bpe.Codec(rank_file, public_tokenizers.PATTERN, 1 << 40)
    rng = random.Random(5)
    several = 0
    for _ in range(3000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 100)))
        ids = cut.encode(text)
        several += len(list(byte_bpe.parts(text, 50))) > 1
        assert ids.tolist() == whole.encode(text).tolist()
        assert cut.decode(ids) == text.encode()
    assert several > 1000


def test_ids_follow_the_definition(spark, odd, rank_file):
    import base64

    import public_tokenizers
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    pattern = regex.compile(public_tokenizers.PATTERN)
    rows = byte_bpe.decode(byte_bpe.encode(odd, byte_bpe.default_path()), byte_bpe.default_path()).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = r["text"] or ""
        assert bytes(r["decoded"]) == text.encode()
        if len(text) < 3000:
            assert r["ids"] == [i for m in pattern.findall(text) for i in merged(m.encode(), ranks)]


def test_very_long_runs(rank_file):
    import public_tokenizers

    codec = byte_bpe.Codec(rank_file, public_tokenizers.PATTERN)
    for text in (" " * 1_500_000, "a" + "\n" * 1_500_000 + "  b", "ab" * 300_000):
        assert codec.decode(codec.encode(text)) == text.encode()


def test_encoding_of_an_empty_table_and_columns(empty, odd):
    path = byte_bpe.default_path()
    assert byte_bpe.encode(empty, path).count() == 0
    assert byte_bpe.encode(odd, path).columns == [c for c in odd.columns if c != "ids"] + ["ids"]


def test_op11_contract(spark):
    import tiktoken  # noqa: F401
    from tokenizers import Tokenizer

    import public_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = byte_bpe.op11_tiktoken_bytes(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = other.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# -- hard negatives -------------------------------------------------------------------


def plain_mined(rows, every, positives, negatives, low, high):
    """All windows by comparing every anchor with every row."""
    kept = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            kept[i, label, tuple(math.floor(256 * x) for x in v)] = True
    out = []
    for a, label, v in kept:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in kept if i != a and len(w) == len(v)]
        scored.sort()
        for p, i, other in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, i, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(window[:negatives])]
    return sorted(out)


def vector_rows(seed=2, spread=0.05, size=6):
    """Clusters with ties, copies, repeated rows, one hot vector, odd components, several lengths and great values."""
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.4) for _ in range(size)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [c + rng.gauss(0, spread) for c in rng.choice(centers)]) for i in range(500)]
    rows += [(500 + i, 1 if i % 3 else 2, centers[0]) for i in range(200)]
    rows += [rows[0], rows[0], rows[10], (700, None, centers[1]), (701, 1, None), (702, 1, [None] * size), (703, 1, [float("nan")] * size),
             (705, 1, [float("inf")] + [0.0] * (size - 1)), (None, 1, centers[1]), (710, 1, []), (720, 1, []), (725, 2, []), (730, 0, [1.0]), (731, 1, [1.5]),
             (740, 0, [2e6] * size), (741, 0, [2.5e6] * size), (742, 1, [1.5e6] * size), (-10, 3, centers[2]), (750, 1, [0.0] * size)]
    return rows


@pytest.mark.parametrize("spread,block", [(0.05, 64), (0.002, 16), (0.3, 2048)])
def test_hard_negatives_are_whole(spark, spread, block):
    rows = vector_rows(spread=spread)
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").repartition(6)
    got = sorted(tuple(r) for r in hard_negatives.mined(df, F.col("id") % 10 == 0, block=block).collect())
    want = plain_mined(rows, 10, 5, 3, 50, 95)
    assert len(want) > 100
    assert got == want


def test_no_hard_negatives(spark):
    empty = spark.createDataFrame([], "id long, label int, vector array<float>")
    out = hard_negatives.mined(empty, F.col("id") % 50 == 0)
    assert out.count() == 0
    lone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "id long, label int, vector array<float>")
    assert hard_negatives.mined(lone, F.col("id") % 50 == 0).count() == 0


def test_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = np.lexsort(hard_negatives.hilbert(cells, 3).T[::-1])
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_limits_hold_every_row():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (20, 7))
    least, most = hard_negatives.limits(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = a @ x.T
    assert (scores >= least).all() and (scores <= most).all()


def test_tight_clusters_are_not_all_read(spark):
    """With clusters, the zone maps leave out most blocks."""
    rng = random.Random(4)
    centers = [[rng.choice((-1, 1)) * 0.3 for _ in range(8)] for _ in range(16)]
    rows = [(i, i % 3, [c + rng.gauss(0, 0.001) for c in centers[i % 16]]) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    vectors = hard_negatives.written(hard_negatives.vectors(df), "v")
    stored = hard_negatives.written(hard_negatives.blocks(vectors, 50), "b")
    zones = hard_negatives.zone_tiles(stored)
    ask = vectors.where("id % 50 = 0").withColumn("anchor", F.col("id")).withColumn("lows", F.array(F.lit(40_000).cast("long"))) \
        .withColumn("highs", F.array(F.lit(1 << 62)))
    slices = hard_negatives.chosen(hard_negatives.written(hard_negatives.anchor_tiles(ask), "t"), zones, True)
    pairs = sum(len(hard_negatives.longs(bytes(r["ids"]))) for r in slices.collect())
    assert 0 < pairs < 0.3 * 32 * stored.count()


# -- filter audit ---------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied document by document."""
    import re

    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    by_part = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and first[t] < i}
        by_part[part or ""].append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, rows in by_part.items():
        steps, shares = [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                steps.append((part, order, k + 1, len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows),
                              sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out += [(*s, shares[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_every_order(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)] + ["AB", "CDE", "x#", "a b"]
    docs = []
    for i in range(300):
        text = rng.choice([" ", "\n", "\x0b \t"]).join(rng.choices(words[: rng.choice([30, 304])], k=rng.choice([0, 20, 99, 100, 150])))
        docs.append((i, rng.choice([text, text.upper(), text + " $1"]), rng.choice(["de", "", None, "fr"])))
    docs += [(1000 + i, docs[i % 7][1], "de") for i in range(60)] + [(None, docs[3][1], "de"), (None, None, None), (2000, None, "fr"), (2001, "", "fr"), docs[5], docs[5]]
    docs.append((-5, docs[9][1], "it"))
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 2)] + [(1003, 1, 1), (4, 0, None), (4, 1, 1), (None, 1, 1), (999_999, 1, 1), (2000, 1, 0)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, lang string, mask string, part int").repartition(5)
    marks = filter_audit.marks_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = filter_audit.audit(filter_audit.measured(df), filter_audit.text_filters(), marks)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())
    assert got == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = filter_audit.marks_of(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert filter_audit.audit(filter_audit.measured(df), filter_audit.text_filters(), marks).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(df, {c: F.lit(True) for c in "abcdefg"}, marks)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_gives_shapley_values(n):
    rng = random.Random(n)
    v = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
    want = [0] * n
    for order in permutations(range(n)):
        seen = 0
        for f in order:
            want[f] += v[seen | 1 << f] - v[seen]
            seen |= 1 << f
    assert [sum(w * x for w, x in zip(row, v)) for row in filter_audit.shapley_weights(n)] == want
