"""Intersections of planes whose points lie on a lattice, so that a length is a whole number of bins but for its last bit."""

import compare
from pyspark.sql import functions as F

from gridwise.plans import ORACLE_SQL, QUERIES, structure

SF = "/root/testdata/sf0.1"
#: Rooms of the test tables repeated with keys shifted by 20,000 and 40,000: their first plane there, and the shift.
ROOMS = [(4433, 20_000), (4433, 40_000)]


def test_lengths_are_rounded_as_in_the_sql(spark, tmp_path):
    tables = {"part": ("p_partkey", []), "lineitem": ("l_partkey", [])}
    for table, (key, found) in tables.items():
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        for first, shift in ROOMS:
            found.append(rows.filter(F.col(key).between(first - 12, first + 24)).withColumn(key, F.col(key) + shift))
        found[0].union(found[1]).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = compare.duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert compare.differences(spark, con, str(tmp_path), QUERIES["geo4_intersections"], ORACLE_SQL["geo4_intersections"]) == ""


def test_pairs_are_formed_once(spark):
    """Their geometry is not written out again into the join that finds the points beside their lines."""
    planes, related = structure._related(spark, "/root/testdata/sf0.001")
    plan = related._jdf.queryExecution().optimizedPlan().toString()
    assert "ACOS" not in plan and "explode" in plan
    assert related.count() == QUERIES["cls3_relationships"](spark, "/root/testdata/sf0.001").count()
