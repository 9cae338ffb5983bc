"""Corners found scan by scan equal those found from table to table, whether a scan is held whole or not."""

import random

import pytest

from gridwise.operators import corners
from gridwise.plans import QUERIES, structure

EDGES = "scan long, edge long, a long, b long, sx double, sy double, sz double, ex double, ey double, ez double, confidence double, supported boolean"
PLANES = "scan long, plane long, nx double, ny double, nz double, k double"


def plain(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def room(scan, seed):
    """Lines whose ends crowd around some places, at planes some of which are missing, with what may be missing of them."""
    rng = random.Random(seed)
    spots = [tuple(rng.uniform(-3, 3) for _ in range(3)) for _ in range(9)]
    near = lambda p: tuple(x + rng.uniform(-0.06, 0.06) for x in p)
    planes = []
    for p in range(8):
        n = [0.0, 0.0, 0.0]
        n[p % 3] = 1.0
        spot = rng.choice(spots)
        planes.append((scan, p, *n, spot[p % 3] + rng.uniform(-0.02, 0.02)))
    edges = []
    for i in range(60):
        s, e = near(rng.choice(spots)), near(rng.choice(spots))
        a, b = rng.sample(range(9), 2)  # plane 8 is none
        end = [*s, *e]
        if i % 19 == 4:
            end[rng.randrange(6)] = (None, float("nan"))[rng.randrange(2)]
        edges.append((scan, i * 3 + 1, None if i == 7 else a, b, *end, None if i % 17 == 3 else rng.choice([0.0, 0.5, 0.9]), None if i % 23 == 2 else i % 11 > 0))
    return edges, planes


@pytest.mark.parametrize("held", [200_000, 100, 0])
def test_scan_by_scan_equals_table_to_table(spark, monkeypatch, held):
    monkeypatch.setattr(corners, "HELD", held)
    monkeypatch.setattr(corners, "ROWS", 30)
    edges, planes = [], []
    for scan in range(6):
        e, p = room(scan, 40 + scan)
        edges += e if scan else e + [(scan, r[1] + 1, *r[2:]) for r in e]  # the first room has twice the lines
        planes += p
    lines, faces = spark.createDataFrame(edges, EDGES).repartition(3), spark.createDataFrame(planes, PLANES)
    solved = corners.solve(lines, faces, corners.clusters(lines))
    got = corners.found(lines, faces)
    assert got.columns == solved.columns and plain(got) == plain(solved)
    merged, want = corners.found(lines, faces, same=0.12), corners.merged(solved)
    assert merged.columns == want.columns and plain(merged) == plain(want)
    assert len({r["reason"] for r in got.collect()}) > 1
    none = corners.found(lines.limit(0), faces)
    assert none.collect() == []


def test_corners_of_rooms_are_merged_alike(spark):
    lines, faces = structure._lines(spark, "/root/testdata/sf0.001")
    solved = corners.solve(lines, faces, corners.clusters(lines))
    assert plain(corners.found(lines, faces)) == plain(solved) and {r["reason"] for r in solved.collect()} >= {"solved", "fallback", "few"}
    want = corners.merged(solved)
    got = corners.found(lines, faces, same=corners.SAME)
    assert plain(got) == plain(want) and got.agg({"corners": "max"}).first()[0] > 1


def test_rooms_take_no_rounds(spark):
    """Components of ends do not go from table to table, each of whose rounds is shuffled and written."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    QUERIES["geo5_corners"](spark, "/root/testdata/sf0.001")
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 12
