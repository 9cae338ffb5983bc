"""Queries on depth grids, consistency, coverage lookups, support and scan files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.operators import frames
from gridwise.operators.graph import settled
from gridwise.plans.registry import query
from gridwise.plans.tables import SAMPLES, read, samples
from gridwise.sources import scan_files

r = F.round
#: A frame a customer's last digits: 24 rows and 30 columns of depths.
_GRID = "g AS (SELECT o_custkey % 50 AS frame, o_orderkey // 7 % 24 AS row, o_orderkey // 3 % 30 AS col, min(o_totalprice) / 100000 AS depth, min(o_totalprice) > 3000 AS valid FROM orders GROUP BY ALL)"


def _grid(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("frame"), (F.floor(k / 7) % 24).alias("row"), (F.floor(k / 3) % 30).alias("col")).agg((F.min("o_totalprice") / 100000).alias("depth"), (F.min("o_totalprice") > 3000).alias("valid"))


_SIDES = """n AS (SELECT g.*, l.depth AS ld, l.valid AS lv, r.depth AS rd, r.valid AS rv, u.depth AS ud, u.valid AS uv, d.depth AS dd, d.valid AS dv FROM g LEFT JOIN g l ON l.frame = g.frame AND l.row = g.row AND l.col = g.col - 1
    LEFT JOIN g r ON r.frame = g.frame AND r.row = g.row AND r.col = g.col + 1 LEFT JOIN g u ON u.frame = g.frame AND u.col = g.col AND u.row = g.row - 1 LEFT JOIN g d ON d.frame = g.frame AND d.col = g.col AND d.row = g.row + 1)"""


@query("win2_grid_neighbours", f"WITH {_GRID}, {_SIDES} SELECT frame, row, col, round(ld, 7) AS l, round(rd, 7) AS r, round(ud, 7) AS u, round(dd, 7) AS d FROM n")
def win2(spark, sf):
    g = frames.grid_neighbours(_grid(spark, sf), "depth")
    return g.select("frame", "row", "col", *(r(f"{s}_depth", 7).alias(s[0]) for s in ("left", "right", "up", "down")))


_JUMP = lambda s: f"coalesce(({s}v AND abs(depth - {s}d) > greatest(.12, least(depth, {s}d) * .08))::INT, 0)"
_ODD = " + ".join(f"coalesce(({s}v AND abs(depth - {s}d) > greatest(.25, depth * .25))::INT, 0)" for s in "lrud")
_KNOWN = " + ".join(f"coalesce({s}v::INT, 0)" for s in "lrud")


@query("fil2b_depth_ratios", f"""WITH {_GRID}, {_SIDES}, v AS (SELECT * FROM n WHERE valid)
    SELECT frame, count(*) AS valid, round(sum({_JUMP('r')} + {_JUMP('d')}) / greatest(1, sum(coalesce(rv::INT, 0) + coalesce(dv::INT, 0))), 6) AS jump_ratio,
      round(count(*) FILTER ({_KNOWN} >= 3 AND {_ODD} >= 3) / greatest(1, count(*)), 6) AS outlier_ratio FROM v GROUP BY frame""")  # fmt: skip
def fil2b(spark, sf):
    return frames.depth_ratios(_grid(spark, sf)).select("frame", "valid", r("jump_ratio", 6).alias("jump_ratio"), r("outlier_ratio", 6).alias("outlier_ratio"))


_RELATED = f"""{SAMPLES}, p AS (SELECT * FROM s WHERE id % 2 = 0), q AS (SELECT * FROM s WHERE id % 2 = 1),
    k AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM p), c AS (SELECT * FROM k WHERE k % greatest(1, ceil(n / 256)) = 0),
    e AS (SELECT a.id, bool_or((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= .035**2 AND abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz) >= .8) AS same, bool_or(abs((a.x-b.x)*b.nx+(a.y-b.y)*b.ny+(a.z-b.z)*b.nz) >= .028 AND abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz) >= .94) AS beside
      FROM c a JOIN q b ON (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2 <= .12**2 GROUP BY a.id),
    f AS (SELECT c.*, CASE WHEN same THEN 'consistent' WHEN beside THEN 'duplicate' ELSE 'unknown' END AS relation FROM c LEFT JOIN e USING (id))"""


@query("fil3_frame_consistency", f"WITH {_RELATED} SELECT frame, count(*) AS considered, " + ", ".join(f"round(avg((relation = '{k}')::INT), 6) AS {k}" for k in ("consistent", "duplicate", "unknown")) + " FROM f GROUP BY frame")
def fil3(spark, sf):
    s = samples(spark, sf)
    out = frames.frame_consistency(s.filter("id % 2 = 0"), s.filter("id % 2 = 1"))
    return out.select("frame", "considered", *(r(k, 6).alias(k) for k in ("consistent", "duplicate", "unknown")))


@query("fil3b_relations", f"WITH {_RELATED} SELECT id, relation FROM f")
def fil3b(spark, sf):
    s = samples(spark, sf)
    return frames.established_relations(frames.strided(s.filter("id % 2 = 0"), "frame", ["id"], 256), s.filter("id % 2 = 1")).select("id", "relation")


@query("smp5_raw_capture", f"WITH {SAMPLES}, k AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS k FROM s) SELECT frame, id, round(x, 6) AS x FROM k WHERE k % greatest(1, ceil(n / 40)) = 0")
def smp5(spark, sf):
    """Forty a frame, as frames here are small."""
    return frames.strided(samples(spark, sf), "frame", ["id"], 40).select("frame", "id", r("x", 6).alias("x"))


_D2 = "(p.x-c.x)**2 + (p.y-c.y)**2 + (p.z-c.z)**2"
_SAME = " AND ".join(f"floor(p.{a} / .05) = floor(c.{a} / .05)" for a in "xyz")
_NEAR = " AND ".join(f"abs(floor(p.{a} / .05) - floor(c.{a} / .05)) <= 1" for a in "xyz")


@query("cls8_coverage_lookup", f"""WITH {SAMPLES}, p AS (SELECT * FROM s WHERE id % 3 = 0), c AS (SELECT *, seen AS state FROM s WHERE id % 3 = 1), g AS (SELECT *, seen AS state FROM s WHERE id % 12 = 2),
    o AS (SELECT p.id, arg_min(c.state, ({_D2}, c.id)) AS state FROM p JOIN c ON {_SAME} GROUP BY p.id),
    a AS (SELECT p.id, arg_min(c.state, ({_D2}, c.id)) AS state FROM p JOIN g c ON {_D2} <= .01 AND {_NEAR.replace('.05', '.1')} AND abs((p.x-c.x)*c.nx+(p.y-c.y)*c.ny+(p.z-c.z)*c.nz) <= .04 GROUP BY p.id),
    n AS (SELECT p.id, arg_min(c.state, ({_D2}, c.id)) AS state FROM p JOIN c ON {_NEAR} AND NOT ({_SAME}) AND {_D2} < .01 GROUP BY p.id)
    SELECT p.id, CASE WHEN o.id IS NOT NULL THEN 'exact' WHEN a.id IS NOT NULL OR n.id IS NOT NULL THEN 'neighbor' ELSE 'miss' END AS kind, coalesce(o.state, a.state, n.state) AS state
    FROM p LEFT JOIN o USING (id) LEFT JOIN a USING (id) LEFT JOIN n USING (id)""")  # fmt: skip
def cls8(spark, sf):
    s = samples(spark, sf).withColumn("state", F.col("seen"))
    return frames.coverage_lookup(s.filter("id % 3 = 0"), s.filter("id % 3 = 1"), s.filter("id % 12 = 2"))


_UV = "p AS (SELECT o_custkey AS patch, o_orderkey AS id, o_totalprice / 100000 AS u, o_orderkey % 100 / 40 AS v FROM orders)"


def _uv(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("patch"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("u"), (F.col("o_orderkey") % 100 / 40).alias("v"))


@query("geo6_trimmed_support", f"""WITH {_UV}, q AS (SELECT patch, count(*) AS n, quantile_cont(u, .05) AS u0, quantile_cont(u, .95) AS u1, quantile_cont(v, .05) AS v0, quantile_cont(v, .95) AS v1 FROM p GROUP BY patch),
    m AS (SELECT p.*, n, u BETWEEN u0 - 1e-9 AND u1 + 1e-9 AND v BETWEEN v0 - 1e-9 AND v1 + 1e-9 AS inside FROM p JOIN q USING (patch)), l AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY patch) AS kept FROM m)
    SELECT patch, id FROM l WHERE n < 8 OR kept < 3 OR inside""")  # fmt: skip
def geo6(spark, sf):
    return frames.trimmed_support(_uv(spark, sf), "patch").select("patch", "id")


@query("geo8_constraint_sides", f"""WITH {_UV}, l AS (SELECT c_custkey AS patch, k AS line, k * .4 + c_nationkey / 100 AS u0, 0.0::DOUBLE AS v0, CASE WHEN c_custkey % 50 = 0 THEN k * .4 + c_nationkey / 100 ELSE k * .4 + .3 END AS u1, CASE WHEN c_custkey % 50 = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS v1 FROM customer, (VALUES (0), (1), (2), (3)) t(k)),
    z AS (SELECT l.*, sqrt((u1-u0)**2 + (v1-v0)**2) AS size FROM l), o AS (SELECT z.patch, line, size, CASE WHEN size > 2.3e-16 THEN ((u1-u0)*(v-v0) - (v1-v0)*(u-u0)) / size END AS off FROM z LEFT JOIN p USING (patch)),
    c AS (SELECT patch, line, size, count(*) FILTER (off > .04) AS positive, count(*) FILTER (off < -.04) AS negative, count(*) FILTER (abs(off) <= .04) AS close FROM o GROUP BY ALL),
    d AS (SELECT *, CASE WHEN size <= 2.3e-16 THEN 'rejected' WHEN positive + negative = 0 THEN 'ambiguous' WHEN least(positive, negative) / (positive + negative) >= .18 THEN 'internal' WHEN greatest(positive, negative) / (positive + negative) < .72 OR positive = negative THEN 'ambiguous' ELSE 'boundary' END AS kind FROM c)
    SELECT patch, line, positive, negative, close, kind, CASE WHEN kind = 'boundary' THEN sign(positive - negative) ELSE 0 END::INT AS keep FROM d""")  # fmt: skip
def geo8(spark, sf):
    at, flat = F.col("line") * 0.4 + F.col("c_nationkey") / 100, F.col("c_custkey") % 50 == 0
    lines = read(spark, sf, "customer").withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.col("c_custkey").alias("patch"), "line", at.alias("u0"), F.lit(0.0).alias("v0"), F.when(flat, at).otherwise(F.col("line") * 0.4 + 0.3).alias("u1"), F.when(flat, 0.0).otherwise(2.0).alias("v1"))
    return frames.sidedness(_uv(spark, sf).drop("id"), lines)


@query("fil12_barrier", """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS triangle, max(l_orderkey) AS a, max(l_partkey) AS b, max(l_suppkey) AS c FROM lineitem GROUP BY ALL)
    SELECT triangle, bool_or(v % 7 = 0 OR v % 5 IN (2, 3)) AS barrier FROM (SELECT triangle, unnest([a, b, c]) AS v FROM t) GROUP BY triangle""")  # fmt: skip
def fil12(spark, sf):
    t = read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("triangle")).agg(F.max("l_orderkey").alias("a"), F.max("l_partkey").alias("b"), F.max("l_suppkey").alias("c"))
    ids = t.select(F.explode(F.array("a", "b", "c")).alias("id")).distinct()
    return frames.barred(t, ids.select("id", (F.col("id") % 7 == 0).alias("foreground"), (F.col("id") % 5).alias("class"))).select("triangle", "barrier")


@query("src1_json_exports", f"""WITH {SAMPLES} SELECT 'scan-' || frame AS scan_id, id, round(x, 6) AS x, round(nz, 6) AS nz, radius, round(least(1.0, red), 6) AS r, 0.0::DOUBLE AS b, round(green, 6) AS geometry_confidence, seen, greatest(1, views - 1) AS views
    FROM (SELECT *, .01 + id % 5 / 1000::DOUBLE AS radius FROM s)""")  # fmt: skip
def src1(spark, sf):
    """JSON exports of all scans, written and read again; colours and confidences are clamped, counts at least one."""
    s, folder = samples(spark, sf), scan_files.new_folder(spark, "exports")
    scan_files.write_exports(s.select(
        F.concat(F.lit("scan-"), F.col("frame").cast("string")).alias("scan_id"), "id", "x", "y", "z", "nx", "ny", "nz", (F.lit(0.01) + F.col("id") % 5 / 1000).alias("radius"),
        F.col("red").alias("r"), F.col("green").alias("g"), (-F.col("blue")).alias("b"), F.col("green").alias("geometry_confidence"), (F.col("blue") + 1).alias("color_confidence"),
        F.lit(3).alias("color_seen"), "seen", (F.col("views") - 1).alias("views"), F.lit(0.0).alias("first_ms"), F.lit(9.0).alias("last_ms")), folder)
    out = scan_files.read_exports(spark, folder)
    return out.select("scan_id", "id", r("x", 6).alias("x"), r("nz", 6).alias("nz"), "radius", r("r", 6).alias("r"), "b", r("geometry_confidence", 6).alias("geometry_confidence"), "seen", "views")


@query("src5_captures", f"""WITH {_GRID} SELECT f.frame AS sequence, i AS grid_index, f.frame * 250.0::DOUBLE AS ms, coalesce(valid, false) AS valid, round(coalesce(depth::FLOAT, 0)::DOUBLE, 5) AS depth FROM (SELECT DISTINCT frame FROM g) f CROSS JOIN range(720) t(i) LEFT JOIN g ON g.frame = f.frame AND g.row * 30 + g.col = i""")
def src5(spark, sf):
    """Binary captures of all frames, written and decoded again."""
    folder = scan_files.new_folder(spark, "captures")
    settled(scan_files.write_captures(_grid(spark, sf), 30, 24, folder))
    return scan_files.read_captures(spark, folder).select("sequence", "grid_index", "ms", "valid", r("depth", 5).alias("depth"))


_CHUNKS = f"""{SAMPLES}, o AS (SELECT *, (row_number() OVER (PARTITION BY frame ORDER BY id) - 1) AS k FROM s)"""
_FLOATS = ", ".join(f"round({c}::FLOAT::DOUBLE, 6) AS {c}" for c in ("x", "y", "z", "nx", "ny", "nz"))


@query("snk5_packed_surface", f"WITH {_CHUNKS} SELECT frame, k // 16 AS chunk, k % 16 AS place, {_FLOATS} FROM o")
def snk5(spark, sf):
    back = scan_files.unpacked_surface(scan_files.packed_surface(samples(spark, sf), "frame", 16), "frame")
    return back.select("frame", "chunk", "place", *(r(c, 6).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))


@query("snk3_prepared_surface", f"WITH {_CHUNKS} SELECT frame || '-' || lpad((k // 16)::VARCHAR, 6, '0') || '.surface' AS file, k % 16 AS place, {_FLOATS} FROM o")
def snk3(spark, sf):
    folder = scan_files.new_folder(spark, "prepared")
    settled(scan_files.write_prepared(scan_files.packed_surface(samples(spark, sf), "frame", 16), "frame", folder))
    return scan_files.read_prepared(spark, folder).select("file", "place", *(r(c, 6).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))


@query("snk4_finalized_counts", f"WITH {SAMPLES} SELECT frame, count(*) AS cells, count(*) FILTER (seen >= 3) AS captured, count(*) FILTER (seen = 2) AS partial, count(*) FILTER (seen >= 2) AS fused FROM s GROUP BY frame")
def snk4(spark, sf):
    return scan_files.finalized_counts(samples(spark, sf), "frame")


@query("sig1_snapshot_signature", "SELECT count(*) AS rows, true AS same, false AS changed FROM embeddings")
def sig1(spark, sf):
    """Whether the signature is the same for the same rows in another order, and for one changed row."""
    s = samples(spark, sf).select("id", "x", "y", "z")
    one = scan_files.snapshot_signature(s, "id", "x", "y", "z")
    turned = scan_files.snapshot_signature(s.repartition(5, "x"), "id", "x", "y", "z").select(F.col("signature").alias("turned"))
    other = scan_files.snapshot_signature(s.withColumn("x", F.when(F.col("id") == 1, F.col("x") + 1e-9).otherwise(F.col("x"))), "id", "x", "y", "z").select(F.col("signature").alias("other"))
    return one.join(F.broadcast(turned), F.lit(True)).join(F.broadcast(other), F.lit(True)).select("rows", (F.col("signature") == F.col("turned")).alias("same"), (F.col("signature") == F.col("other")).alias("changed"))
