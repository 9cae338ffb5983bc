"""Components of dense rows, of which only pairs that are not connected yet are formed, against all pairs."""

import math
import random

import numpy as np
import pytest

from gridwise.operators import graph, near, spatial

SCHEMA = "id long, frame int, x double, y double, z double, nx double, ny double, nz double"
REACH = math.sqrt(0.4) * 1.000001


def fits(a, b):
    return spatial.normal_dot(a, b) >= 0.8


def unit(rng, around, spread):
    n = [x + rng.gauss(0, spread) for x in around]
    size = math.sqrt(sum(x * x for x in n))
    return [x / size for x in n]


def table(seed):
    """Crowds, chains of rows just within and just beyond the radius, the same places under other normals, equal rows, and
    rows that something is missing of."""
    rng, rows = random.Random(seed), []
    for _ in range(12):
        spot, normal = [rng.uniform(-2, 2) for _ in range(3)], unit(rng, (0, 0, 0), 1)
        rows += [(rng.randrange(2), *(x + rng.gauss(0, 0.12) for x in spot), *unit(rng, normal, rng.choice([0.05, 0.5]))) for _ in range(25)]
    for step in (0.2999, 0.3001):
        rows += [(2, i * step, step, 0.0, 0.0, 0.0, 1.0) for i in range(9)]
    for turn in (36.8, 36.95):  # cosines of 0.8007 and 0.7992
        rows += [(3, 0.0, 0.0, turn, math.cos(math.radians(i * turn)), math.sin(math.radians(i * turn)), 0.0) for i in range(5)]
    rows += [(4, 1.0, 1.0, 1.0, 0.6, 0.8, 0.0)] * 7
    rows += [(4, 1.0, 1.0, 1.0, float("nan"), 0.8, 0.0), (4, 1.0, 1.0, 1.0, None, 0.8, 0.0), (4, None, 1.0, 1.0, 0.6, 0.8, 0.0), (None, 1.0, 1.0, 1.0, 0.6, 0.8, 0.0)]
    rng.shuffle(rows)
    return [(i * 3 + 1, *r) for i, r in enumerate(rows)]


def plain(rows):
    label = {r[0]: r[0] for r in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[1] is not None and a[1] == b[1] and None not in (*a, *b) and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5], strict=True)) <= 0.09 and sum(p * q for p, q in zip(a[5:], b[5:], strict=True)) >= 0.8:
                x, y = sorted((root(a[0]), root(b[0])))
                label[y] = x
    return {x: root(x) for x in label}


@pytest.mark.parametrize("seed, held", [(1, 200_000), (2, 20)])
def test_joined_rows_equal_all_pairs(spark, monkeypatch, seed, held):
    """held: cubes are made as narrow as they get."""
    monkeypatch.setattr(near, "HELD", held)
    rows = table(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = near.joined(df, 0.3, lambda a, b: spatial.normal_dot(a, b) >= 0.8, "frame", ["nx", "ny", "nz"], REACH)
    got = {r["id"]: r["component"] for r in graph.components(df, found).collect()}
    assert got == plain(rows) and len(set(got.values())) > 12


@pytest.mark.parametrize("seed, pairs", [(3, 1_000_000), (4, 37), (5, 3)])
def test_rows_of_a_cube_equal_all_pairs(monkeypatch, seed, pairs):
    """pairs: they are formed a few at a time, and large groups row by row."""
    monkeypatch.setattr(near, "PAIRS", pairs)
    rows = [(r[0], 0, *r[2:]) for r in table(seed) if r[1] in (0, 1, 3)]
    columns = dict(zip(("x", "y", "z", "nx", "ny", "nz"), np.array([r[2:] for r in rows]).T, strict=True))
    label = near._unite(columns.__getitem__, len(rows), 0.3, fits, ["nx", "ny", "nz"], REACH)
    want = plain(rows)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(want[r[0]], i)
    assert label.tolist() == [first[want[r[0]]] for r in rows]


def test_dense_rows_form_few_pairs():
    """60,000 rows of one place have 10^8 pairs that fit; one pair a row and direction is enough."""
    rng = np.random.default_rng(3)
    p = rng.normal(0, 0.12, (3, 60_000))
    n = rng.normal(0, 1, (3, 60_000))
    n /= np.sqrt((n * n).sum(0))
    p[:, 0] = 5.0  # one row apart
    columns = dict(zip(("x", "y", "z", "nx", "ny", "nz"), (*p, *n), strict=True))
    formed = []

    def counted(a, b):
        formed.append(len(a("nx")))
        return fits(a, b)

    label = near._unite(columns.__getitem__, 60_000, 0.3, counted, ["nx", "ny", "nz"], REACH)
    assert label[0] == 0 and (label[1:] == 1).mean() > 0.999 and sum(formed) < 10_000_000
