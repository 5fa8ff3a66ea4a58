"""Components against plain union-find, and words that must not share a hash."""

import random

import numpy as np
import pyarrow as pa

from riskweave.llm import components
from riskweave.llm.textblocks import LONG_RUN, shingle_sets


def plain(edges):
    """Smallest reachable node of every node with an edge."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


def shapes():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(3000)]
    ids = list(range(10_000, 13_001))
    rng.shuffle(ids)
    mixed = [(ids[i], ids[i + 1]) for i in range(3000)]
    star = [(20_000, 20_001 + i) for i in range(2000)] + [(23_000, 21_000)]
    loose = [(rng.randrange(30_000, 31_000), rng.randrange(30_000, 31_000)) for _ in range(600)]
    far = [(-(2**63), 2**63 - 1), (-5, -6), (7_000_000, 7_000_000), (None, 3), (4, None)]
    edges = chain + mixed + star + loose + far + chain[:50]
    rng.shuffle(edges)
    return edges


def test_stars_equal_union_find():
    edges = [(a, b) for a, b in shapes() if a is not None and b is not None]
    got = components.stars(*(np.array(x) for x in zip(*edges, strict=True)))
    assert dict(zip(*(x.tolist() for x in got), strict=True)) == {x: r for x, r in plain(edges).items() if x != r}


def test_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK_EDGES", 300)  # so that the rounds have something to do
    edges = shapes()
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == plain(edges)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_words_of_like_structure_are_told_apart():
    """Thue-Morse words and their complements are equal under a polynomial modulo 2^64."""
    for n in (1024, LONG_RUN * 2, LONG_RUN * 4):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = one.translate(str.maketrans("ab", "ba"))
        a, b, c = shingle_sets(pa.array([f"w x {one} y z", f"w x {other} y z", f"w x {one.upper()} y z"]))
        assert a.tolist() != b.tolist() and a.tolist() == c.tolist()
