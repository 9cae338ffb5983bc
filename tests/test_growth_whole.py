"""Growth from hits scan by scan equals growth from table to table, whether a scan is held whole or not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import triangulation
from gridwise.operators.graph import settled
from gridwise.plans import QUERIES, stateful

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r["scan"], r["triangle"], r["step"]) for r in df.collect())


@pytest.fixture(scope="module")
def sheets(spark):
    """A few sheets with other surfaces, gaps and samples without a normal."""
    rows = stateful._sheets(spark, SF).filter("scan < 12")
    rows = rows.withColumn("nx", F.when(F.col("id") % 41 == 0, 0.0).otherwise(F.col("nx"))).withColumn("ny", F.when(F.col("id") % 41 == 0, 0.0).otherwise(F.col("ny"))).withColumn("nz", F.when(F.col("id") % 41 == 0, 0.0).otherwise(F.col("nz")))
    rows = rows.withColumn("x", F.when(F.col("id") % 37 == 0, None).otherwise(F.col("x"))).withColumn("barrier", F.when(F.col("id") % 29 == 0, None).otherwise(F.col("barrier")))
    flat = (F.col("scan") % 2).cast("double")
    return settled(rows.withColumns({"snx": 0.1 * flat, "sny": F.lit(0.0), "snz": F.lit(0.99), "sk": 0.012 + 0.1 * flat * F.col("scan") * 10}))


@pytest.fixture(scope="module")
def wanted(sheets):
    found = triangulation._named(triangulation.triangles(sheets).join(sheets.select(F.col("id").alias("a"), "scan"), "a"))
    cornered = settled(triangulation.with_corners(found, sheets))
    return rows(triangulation.grown_from_hits(cornered, triangulation.first_hits(cornered), sheets.select("scan", "snx", "sny", "snz", "sk").distinct()))


@pytest.mark.parametrize("large", [0, 2])
def test_growth_equals_that_from_table_to_table(sheets, wanted, monkeypatch, large):
    """large: so many scans have more samples than a task holds."""
    monkeypatch.setattr(triangulation, "ROWS", 10)
    if large:
        sizes = sorted(r["count"] for r in sheets.filter("x is not null").groupBy("scan").count().collect())
        monkeypatch.setattr(triangulation, "HELD", sizes[-large - 1])
    got = rows(triangulation.growth(sheets))
    assert got == wanted and max(step for _, _, step in got) > 1


def test_neighbours_are_chosen_in_between(monkeypatch):
    rng = np.random.default_rng(1)
    scan, p = np.sort(rng.integers(0, 3, 400)), rng.integers(0, 9, (3, 400)) * np.array([0.02, 0.02, 0.001])[:, None]
    n = np.array([[0.0], [0.0], [1.0]]).repeat(400, 1)
    want = triangulation._hoods(scan, p, n)
    monkeypatch.setattr(triangulation, "KEPT", 50)
    got = triangulation._hoods(scan, p, n)
    assert all((x == y).all() for x, y in zip(got, want, strict=True)) and len(want[0]) > 2000


def test_sheets_without_triangles_grow_nothing(sheets):
    assert triangulation.growth(sheets.filter("barrier")).count() == 0
    assert triangulation.growth(sheets.limit(0)).count() == 0


def test_sheets_take_no_rounds(spark):
    """Neither neighbours, corners nor growth go from table to table, each of which is shuffled and written."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    QUERIES["grp12_hit_growth"](spark, SF)
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 8
