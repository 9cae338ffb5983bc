"""Neighbours cube by cube against plain loops, on rows of very different density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import near, spatial
from gridwise.plans import QUERIES

SCHEMA = "id long, x double, y double, z double, w double"


def rows_of(seed, n=400):
    rng = np.random.default_rng(seed)
    close, wide = rng.normal(0, 0.01, (n // 2, 3)), rng.normal(0, 0.2, (n // 2, 3))
    at = np.round(np.concatenate([close, wide]), 3)  # with ties, and copies of one place
    at[:30] = at[0]
    return [(i, *map(float, p), float(rng.integers(0, 3))) for i, p in enumerate(at)] + [(n, None, 0.0, 0.0, 1.0), (n + 1, float("nan"), 0.0, 0.0, 1.0)]


def d2_of(a, b):
    return (b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2


@pytest.mark.parametrize("most", [8, 100_000])
@pytest.mark.parametrize("cells", [None, (0.06, 1)])
def test_nearest(spark, monkeypatch, most, cells):
    for name, value in (("MOST", most), ("ROWS", 50), ("PAIRS", 200)):
        monkeypatch.setattr(near, name, value)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fits = lambda left, right: left("w") != right("w")
    got = {r["l_id"]: [q["id"] for q in r["near"]] for r in near.nearest(df, df, 0.1, 5, fits, cells).collect()}
    far = lambda a, b: cells and any(abs(np.floor(p / cells[0]) - np.floor(q / cells[0])) > cells[1] for p, q in zip(a[1:4], b[1:4], strict=True))
    whole = rows[:-2]
    for a in whole:
        found = sorted((d2_of(a, b), *b[1:4], b[0]) for b in whole if a[0] != b[0] and a[4] != b[4] and d2_of(a, b) <= 0.1 * 0.1 and not far(a, b))
        assert got.pop(a[0]) == [b[-1] for b in found[:5]]
    assert not got


@pytest.mark.parametrize("name", ["jn7_knn", "jn8b_foreground_neighbours", "jn8c_domain_neighbours", "geo20_local_refinement", "cls7_confidence_smoothing", "agg22_spacing_histogram"])
def test_pairs_are_not_sorted(spark, name):
    """Pairs stay in the task that forms them: none go through a join on cells or a window by row."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "cx" not in plan and "MapInArrow" in plan


def test_ranks_are_places(spark):
    df = spark.createDataFrame(rows_of(2, 40)[:-2], SCHEMA)
    out = spatial.knn(df, df, 0.2, 0.2, 3).collect()
    assert {"l_id", "l_w", "r_id", "r_w", "d2", "rank"} <= set(out[0].asDict())
    places = {}
    for r in out:
        places.setdefault(r["l_id"], []).append((r["rank"], r["d2"]))
    assert all([k for k, _ in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: (x[1], x[0])) for v in places.values())


def test_best(spark, monkeypatch):
    for name, value in (("ROWS", 50), ("PAIRS", 200)):
        monkeypatch.setattr(near, name, value)
    rows = rows_of(3, 200)[:-2]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    judge = lambda a, b, d2: (b("w") > 0, d2 + a("w") * b("w"), b("w") == 2)
    for radius, cells in ((0.1, None), (0.1, (0.04, 1)), (1.0, (0.05, 0))):
        got = {r["l_id"]: r for r in near.best(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), radius, judge, cells).collect()}
        far = lambda a, b, cells=cells: cells and any(abs(np.floor(p / cells[0]) - np.floor(q / cells[0])) > cells[1] for p, q in zip(a[1:4], b[1:4], strict=True))
        for a in rows[::2]:
            found = [b for b in rows[1::2] if d2_of(a, b) <= radius * radius and not far(a, b)]
            first = min(((d2_of(a, b) + a[4] * b[4], b[0]) for b in found if b[4] > 0), default=(None, None))
            r = got.pop(a[0])
            assert (r["candidates"], r["flagged"], r["r_id"]) == (len(found), sum(b[4] == 2 for b in found), first[1])
            assert first[0] is None or r["score"] == pytest.approx(first[0], abs=1e-12)
        assert not got


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    for name, value in (("ROWS", 50), ("PAIRS", 200)):
        monkeypatch.setattr(near, name, value)
    rows = rows_of(4, 300)[:-2]
    df = spark.createDataFrame(rows, SCHEMA + "").repartition(3).withColumn("odd", F.col("id") % 2 == 1)
    out = near.links(df, 0.08, lambda a, b: a("w") == b("w"), counted="odd").collect()
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[4] == b[4] and d2_of(a, b) <= 0.08 * 0.08]
    edges = [(r["a"], r["b"]) for r in out if r["b"] is not None]
    assert len(edges) < len(pairs) / 8 and set(edges) <= {(p, q) for p in range(300) for q in range(300)}
    counts = {r["a"]: r["n"] for r in out if r["b"] is None}
    assert counts == {a[0]: sum(q % 2 for p, q in pairs if p == a[0]) for a in rows}

    def labels(edges):
        label = list(range(len(rows)))
        while True:
            before = list(label)
            for p, q in edges:
                label[p] = label[q] = min(label[p], label[q])
            if label == before:
                return label

    assert labels(edges) == labels(pairs)


def test_a_floor_at_zero_is_sent_about_once(spark):
    """Rows of a sheet at z = 0, where cubes used to begin, went out as query and up to eight times as point."""
    df = spark.createDataFrame([(i, 0.01 * (i % 20), 0.01 * (i // 20), 0.0, 0.0) for i in range(400)], SCHEMA)
    sent = near._blocked(df, df, 0.8, 0.1)
    assert sent.count() < 1.3 * 400 and sent.filter("_side != 1").count() == 400


def test_what_is_kept_and_written(spark, monkeypatch):
    """near holds what is asked for, and the checkpoints of narrow margins nothing for rows that go on."""
    monkeypatch.setattr(near, "MOST", 8)
    written = []
    monkeypatch.setattr(near, "EACH", 1)
    settled = near.settled
    monkeypatch.setattr(near, "settled", lambda df: written.append(settled(df)) or written[-1])
    df = spark.createDataFrame(rows_of(5)[:-2], SCHEMA)
    out = {r["l_id"]: r["near"] for r in near.nearest(df, df, 0.1, 5, keep=["id"], made={"dx": lambda a, b: b("x") - a("x")}).collect()}
    whole = {r["l_id"]: [(q["id"], q["x"] - r["l_x"]) for q in r["near"]] for r in near.nearest(df, df, 0.1, 5).collect()}
    assert {k: [tuple(q) for q in v] for k, v in out.items()} == whole and set(next(v for v in out.values() if v)[0].asDict()) == {"id", "dx"}
    assert any("near" in d.columns for d in written)
    assert all(d.filter("not _done and size(near) > 0").count() == 0 for d in written if "near" in d.columns)
