"""Strongly connected parts and bounded walks against plain searches."""

import random
from collections import defaultdict

import pytest

from revsieve.operators import cycles
from tests.test_history import _trails


def plain_parts(edges):
    onward = defaultdict(set)
    for a, b in edges:
        onward[a].add(b)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            for b in onward[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    after = {n: reached(n) for e in edges for n in e}
    return {frozenset(m for m in after if m in after[n] and n in after[m]) for n in after if n in after[n]}


def parts_of(df):
    found = defaultdict(set)
    for r in cycles.strong_parts(df).collect():
        assert r.node not in found[r.part]
        found[r.part].add(r.node)
    assert sum(map(len, found.values())) == len(set().union(*found.values(), set()))
    return {frozenset(v) for v in found.values() if v}


@pytest.mark.parametrize("seed,n,m", [(1, 6, 9), (2, 9, 12), (3, 5, 8)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert parts_of(df) == plain_parts(edges)
    got = defaultdict(list)
    for r in cycles.import_cycles(df, 4, horizon=2).orderBy("start", "cycle_rank").collect():
        got[r.start].append(r.path)
    assert dict(got) == _trails(edges, 4)


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    """300 files in a row and a ring of 200: rounds grow with the logarithm."""
    edges = {(f"c{i:03}", f"c{i + 1:03}") for i in range(300)} | {(f"r{i:03}", f"r{(i + 1) % 200:03}") for i in range(200)}
    edges |= {("c300", "r000"), ("r005", "z"), ("z", "r006"), ("z", "z"), ("r100", "out"), ("s", "s")}
    made, real = [], cycles.cut
    monkeypatch.setattr(cycles, "cut", lambda df: made.append(1) or real(df))
    assert parts_of(spark.createDataFrame(sorted(edges), "src string, dst string")) == plain_parts(edges)
    assert len(made) < 80


def test_parts_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert cycles.strong_parts(none).count() == 0 and cycles.import_cycles(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), ("a", None), ("b", "b"), ("b", "b")], none.schema)
    assert [(r.start, r.path) for r in cycles.import_cycles(odd).collect()] == [("b", ["b", "b"])]
