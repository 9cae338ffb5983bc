"""Lengths of intersections that are a whole number of bins but for their last bit, which the SQL's cosines and quantiles decide."""

import compare
import pytest

from gridwise.plans import ORACLE_SQL, QUERIES

#: Two planes (key, size) and points on them (key, quantity, discount, tax).
COSINES = (
    [(115934, 7), (115942, 16)],
    [(115934, 1, 5, 6), (115934, 4, 4, 2), (115934, 6, 4, 4), (115934, 25, 4, 1), (115934, 25, 10, 3), (115934, 28, 5, 0), (115934, 32, 5, 8), (115934, 33, 8, 6), (115934, 38, 0, 0),
     (115942, 5, 10, 2), (115942, 7, 5, 3), (115942, 7, 7, 2), (115942, 31, 5, 7), (115942, 34, 2, 8), (115942, 35, 3, 6)],
)
QUANTILES = (
    [(176463, 13), (176472, 30)],
    [(176463, 2, 5, 0), (176463, 5, 0, 7), (176463, 33, 10, 8), (176463, 35, 0, 0), (176463, 42, 0, 2), (176463, 44, 7, 4), (176472, 14, 0, 4), (176472, 15, 3, 2), (176472, 18, 0, 3),
     (176472, 19, 6, 4), (176472, 22, 0, 4), (176472, 22, 9, 7), (176472, 24, 0, 7), (176472, 26, 7, 4), (176472, 43, 5, 3), (176472, 44, 0, 4)],
)


@pytest.mark.parametrize("planes, points", [COSINES, QUANTILES])
def test_places_along_a_line_are_those_of_the_sql(spark, tmp_path, planes, points):
    part = [(key, size, 900 + float(key % 1000)) for key, size in planes]
    lines = [(key, float(q), d / 100, t / 100) for key, q, d, t in points]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = compare.duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert compare.differences(spark, con, str(tmp_path), QUERIES["geo4_intersections"], ORACLE_SQL["geo4_intersections"]) == ""
