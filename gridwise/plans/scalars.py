"""Queries on projections, row rules, windows, samples and sets."""

from __future__ import annotations


from pyspark.sql import Window, functions as F

from gridwise.functions import camera, colour, masks, numeric as num, rules, vector as vm
from gridwise.operators import graph
from gridwise.operators.ranks import running
from gridwise.plans.registry import query
from gridwise.plans.tables import LINE_ORDER, LINES, POSES, SAMPLES, lines, poses, read, samples

_ORDER = ", ".join(LINE_ORDER)
r = F.round

#: A pinhole projection (focal 1.5, 1.2), its inverse, and a camera two metres back, column-major.
PROJECTION = [1.5, 0, 0, 0, 0, 1.2, 0, 0, 0, 0, -1.002, -1.0, 0, 0, -0.2002, 0]
INVERSE = [1 / 1.5, 0, 0, 0, 0, 1 / 1.2, 0, 0, 0, 0, 0, 1 / -0.2002, 0, 0, -1.0, 1.002 / 0.2002]
VIEW = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, -2.0, 1.0]
CAMERA = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 2.0, 1.0]


def _m(values):
    return F.array(*(F.lit(float(x)) for x in values))


@query("prj1_unproject", """
    WITH d AS (SELECT o_orderkey, o_custkey % 100 / 100.0::DOUBLE AS u, o_orderkey % 90 / 89.0::DOUBLE AS v, o_totalprice / 100000 AS depth FROM orders)
    SELECT o_orderkey, round((2*u-1) / 1.5 * depth, 2) AS x, round((1-2*v) / 1.2 * depth, 2) AS y, round(2 - depth - 1e-7, 3) AS z FROM d""")  # fmt: skip
def prj1(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100 / 100.0).alias("u"), (F.col("o_orderkey") % 90 / 89.0).alias("v"), (F.col("o_totalprice") / 100000).alias("depth"))
    p = camera.unprojected(_m(INVERSE), _m(CAMERA), "u", "v", "depth")
    return d.select("o_orderkey", r(p[0], 2).alias("x"), r(p[1], 2).alias("y"), r(p[2] - 1e-7, 3).alias("z"))


@query("prj2_inverse_matrix", """SELECT o_orderkey % 50 + 1 AS k, round(1.0::DOUBLE / (o_orderkey % 50 + 1), 6) AS i0, round(-(o_orderkey % 50) / (o_orderkey % 50 + 1.0::DOUBLE), 6) AS i12 FROM orders GROUP BY ALL""")
def prj2(spark, sf):
    k = read(spark, sf, "orders").select((F.col("o_orderkey") % 50 + 1).alias("k")).distinct()
    m = F.array(F.col("k").cast("double"), *(F.lit(float(x)) for x in (0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)), (F.col("k") - 1).cast("double"), *(F.lit(float(x)) for x in (0, 0, 1)))
    return k.withColumn("m", camera.inverted(m)).select("k", r(F.get("m", F.lit(0)), 6).alias("i0"), r(F.get("m", F.lit(12)), 6).alias("i12"))


@query("prj3_matrix_source", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'depth' WHEN o_orderkey % 3 = 1 THEN 'view' ELSE 'missing' END AS source, count(*) AS n FROM orders GROUP BY ALL")
def prj3(spark, sf):
    k = F.col("o_orderkey") % 3
    _, source = camera.first_matrix(F.when(k == 0, _m(VIEW)), F.when(k == 1, _m(CAMERA)))
    return read(spark, sf, "orders").groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query("prj4_project_uv", f"""
    WITH {SAMPLES} SELECT id, CASE WHEN z - 2 < 0 THEN round((1.5*x / (2-z) + 1) / 2, 6) END AS u, CASE WHEN z - 2 < 0 THEN round((1 - 1.2*y / (2-z)) / 2, 6) END AS v FROM s""")  # fmt: skip
def prj4(spark, sf):
    u, v = camera.camera_uv(_m(VIEW), _m(PROJECTION), vm.v())
    return samples(spark, sf).select("id", r(u, 6).alias("u"), r(v, 6).alias("v"))


_UV = "t AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS cu, p_partkey % 97 / 96.0::DOUBLE AS cv, ['identity', 'vertical-flipped', 'horizontal-mirrored', 'rotated-180'][p_partkey % 4 + 1] AS o FROM part), q AS (SELECT *, CASE WHEN o IN ('horizontal-mirrored', 'rotated-180') THEN 1 - cu ELSE cu END AS tu, CASE WHEN o IN ('vertical-flipped', 'rotated-180') THEN cv ELSE 1 - cv END AS tv FROM t)"


def _parts_uv(spark, sf):
    names = F.array(*map(F.lit, camera.ORIENTATIONS))
    return read(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("cu"), (F.col("p_partkey") % 97 / 96.0).alias("cv"), F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("o"))


@query("prj6_copied_pixel", f"""
    WITH {_UV} SELECT p_partkey, CASE WHEN ok THEN least(639, greatest(0, floor((tu - .1::DOUBLE) / .8::DOUBLE * 640)))::BIGINT END AS px, CASE WHEN ok THEN least(479, greatest(0, floor((1 - (tv - .05::DOUBLE) / .9::DOUBLE) * 480)))::BIGINT END AS py
    FROM (SELECT *, tu BETWEEN .1::DOUBLE AND .1::DOUBLE + .8::DOUBLE AND tv BETWEEN .05::DOUBLE AND .05::DOUBLE + .9::DOUBLE AND cu BETWEEN 0 AND 1 AS ok FROM q)""")  # fmt: skip
def prj6(spark, sf):
    x, y = camera.copied_pixel("cu", "cv", F.col("o"), (F.lit(0.1), F.lit(0.05), F.lit(0.8), F.lit(0.9)), (F.lit(640), F.lit(480)))
    return _parts_uv(spark, sf).select("p_partkey", x.cast("long").alias("px"), y.cast("long").alias("py"))


@query("prj5_keyframe_subpixel", f"""
    WITH {_UV} SELECT p_partkey, round(CASE WHEN cu BETWEEN 0 AND 1 THEN tu * 640 - .5 END, 6) AS px, round(CASE WHEN cu BETWEEN 0 AND 1 THEN (1 - tv) * 480 - .5 END, 6) AS py FROM q""")  # fmt: skip
def prj5(spark, sf):
    x, y = camera.copied_pixel("cu", "cv", F.col("o"), (F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), (F.lit(640), F.lit(480)), snap=False)
    return _parts_uv(spark, sf).select("p_partkey", r(x, 6).alias("px"), r(y, 6).alias("py"))


@query("prj7_copy_dimensions", "SELECT p_partkey, greatest(1, floor((p_partkey + 100) * k))::BIGINT AS w, greatest(1, floor((p_size + 50) * k))::BIGINT AS h FROM (SELECT *, least(1.0::DOUBLE, 960.0::DOUBLE / greatest(p_partkey + 100, p_size + 50), sqrt(50000.0::DOUBLE / ((p_partkey + 100) * (p_size + 50)))) AS k FROM part)")
def prj7(spark, sf):
    w, h = camera.copy_dimensions(F.col("p_partkey") + 100, F.col("p_size") + 50, 960, 50000)
    return read(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"))


_LIN = "(CASE WHEN {0} <= .04045 THEN {0} / 12.92 ELSE pow(({0} + .055) / 1.055, 2.4) END)"


@query("prj9_colour_transfer", f"""WITH {SAMPLES} SELECT id, round({_LIN.format('red')}, 6) AS linear, round(CASE WHEN green <= .0031308 THEN green * 12.92 ELSE pow(green, 1 / 2.4::DOUBLE) * 1.055 - .055 END, 6) AS srgb FROM s""")
def prj9(spark, sf):
    return samples(spark, sf).select("id", r(colour.srgb_to_linear("red"), 6).alias("linear"), r(colour.linear_to_srgb("green"), 6).alias("srgb"))


@query("prj10_hex_colour", f"""
    WITH h AS (SELECT p_partkey, p_partkey % 256 AS i, p_size * 5 % 256 AS j FROM part) SELECT p_partkey, round({_LIN.format('(i / 255.0::DOUBLE)')}, 6) AS red, round({_LIN.format('(j / 255.0::DOUBLE)')}, 6) AS green FROM h""")  # fmt: skip
def prj10(spark, sf):
    text = F.format_string("#%02x%02x80", F.col("p_partkey") % 256, (F.col("p_size") * 5 % 256).cast("long"))
    red, green, _ = colour.hex_to_linear(text)
    return read(spark, sf, "part").select("p_partkey", r(red, 6).alias("red"), r(green, 6).alias("green"))


@query("prj11_chroma", f"""WITH {SAMPLES}, t AS (SELECT *, greatest(1e-6, red + green + blue) AS k FROM s)
    SELECT id, round(.2126*red + .7152*green + .0722*blue, 6) AS luminance, round(sqrt((red/k - 1/3.0::DOUBLE)**2 + (green/k - 1/3.0::DOUBLE)**2 + (blue/k - 1/3.0::DOUBLE)**2), 6) AS chroma FROM t""")  # fmt: skip
def prj11(spark, sf):
    return samples(spark, sf).select("id", r(colour.luminance("red", "green", "blue"), 6).alias("luminance"), r(colour.chroma_distance(("red", "green", "blue"), (1.0, 1.0, 1.0)), 6).alias("chroma"))


@query("prj12_vector_algebra", f"""WITH {SAMPLES} SELECT id, round(x*nx + y*ny + z*nz, 6) AS dot, round(y*nz - z*ny, 6) AS cx, round(z*nx - x*nz, 6) AS cy, round(x*ny - y*nx, 6) AS cz, round(x / sqrt(x*x+y*y+z*z), 6) AS ux FROM s""")
def prj12(spark, sf):
    c = vm.cross(vm.v(), vm.v("n"))
    return samples(spark, sf).select("id", r(vm.dot(vm.v(), vm.v("n")), 6).alias("dot"), *(r(x, 6).alias(k) for x, k in zip(c, ("cx", "cy", "cz"), strict=True)), r(vm.normalized(vm.v())[0], 6).alias("ux"))


@query("prj13_tangent_basis", f"""
    WITH {SAMPLES}, a AS (SELECT *, CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 1 ELSE 0 END AS a1, CASE WHEN abs(ny) < abs(nx) AND abs(ny) <= abs(nz) THEN 1 ELSE 0 END AS a2 FROM s),
    c AS (SELECT *, a2*nz - (1-a1-a2)*ny AS ux, (1-a1-a2)*nx - a1*nz AS uy, a1*ny - a2*nx AS uz FROM a)
    SELECT id, round((x*ux + y*uy + z*uz) / sqrt(ux*ux + uy*uy + uz*uz), 6) AS u,
      round((x*(ny*uz-nz*uy) + y*(nz*ux-nx*uz) + z*(nx*uy-ny*ux)) / sqrt(ux*ux + uy*uy + uz*uz), 6) AS v FROM c""")  # fmt: skip
def prj13(spark, sf):
    u, w = vm.tangent_basis(vm.v("n"))
    a, b = vm.to_local(vm.v(), vm.vec(0.0, 0.0, 0.0), u, w)
    return samples(spark, sf).select("id", r(a, 6).alias("u"), r(b, 6).alias("v"))


@query("prj15_cell_keys", f"""WITH {LINES} SELECT floor(x / .3)::BIGINT AS cx, floor(y / .3)::BIGINT AS cy, count(*) AS n, floor(avg(l_quantity) + .5)::BIGINT AS rounded FROM li GROUP BY ALL""")
def prj15(spark, sf):
    return lines(spark, sf).groupBy(num.cell("x", 0.3).alias("cx"), num.cell("y", 0.3).alias("cy")).agg(F.count("*").alias("n"), num.round_half_up(F.avg("l_quantity")).alias("rounded"))


@query("prj16_quality_weights", f"""
    WITH {SAMPLES}, t AS (SELECT *, CASE WHEN seen >= 3 THEN 'captured' WHEN seen >= 2 THEN 'partial' ELSE 'observed' END AS state FROM s)
    SELECT id, state, (CASE state WHEN 'captured' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END * least(3, greatest(1, seen)))::DOUBLE AS weight,
      round(CASE state WHEN 'captured' THEN 1.25 WHEN 'partial' THEN 1.1 ELSE 1 END * (1 + least(1, greatest(0, red))) * least(3, greatest(1, views)), 6) AS fused FROM t""")  # fmt: skip
def prj16(spark, sf):
    s = samples(spark, sf).withColumn("state", rules.coverage_state("seen"))
    return s.select("id", "state", rules.quality_weight("state", "seen").alias("weight"), r(rules.fused_weight("state", "red", "views"), 6).alias("fused"))


@query("prj17_orientation", f"""WITH {SAMPLES}, a AS (SELECT round(degrees(acos(least(1.0, abs(ny)))), 6) AS d FROM s)
    SELECT CASE WHEN d <= 20 THEN 'horizontal-like' WHEN d >= 70 THEN 'vertical-like' ELSE 'other' END AS kind, count(*) AS n FROM a GROUP BY ALL""")  # fmt: skip
def prj17(spark, sf):
    angle = r(F.degrees(F.acos(F.least(F.lit(1.0), F.abs("ny")))), 6)
    return samples(spark, sf).groupBy(rules.orientation(angle).alias("kind")).agg(F.count("*").alias("n"))


@query("prj19_guidance", "SELECT CASE WHEN l_quantity * 2 < 35 THEN 'keep-scanning' WHEN l_quantity * 2 < 75 THEN 'scan-from-side' ELSE 'move-on' END AS advice, count(*) AS n FROM lineitem GROUP BY ALL")
def prj19(spark, sf):
    return read(spark, sf, "lineitem").groupBy(rules.view_guidance(F.col("l_quantity") * 2).alias("advice")).agg(F.count("*").alias("n"))


@query("prj20_capture_guidance", """
    WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'recovering' ELSE 'healthy' END AS valid, p_size AS accepted, p_partkey % 5 AS total, p_partkey % 3 AS captured,
      CASE WHEN p_partkey % 11 = 0 THEN 'lost' ELSE 'active' END AS tracking, CASE WHEN p_partkey % 13 = 0 THEN 'move-slower' ELSE 'good' END AS advice, p_size * 2 AS view FROM part)
    SELECT k, CASE WHEN valid = 'invalid' THEN 'restart' WHEN tracking <> 'active' OR valid <> 'healthy' THEN 'hold-still' WHEN advice = 'move-slower' THEN 'slow-down' WHEN view >= 80 THEN 'move-to-unmarked' WHEN total > 0 THEN 'move-sideways' ELSE 'sweep' END AS message,
      CASE WHEN valid <> 'healthy' THEN 1 ELSE 0 END + CASE WHEN total = 0 THEN 1 ELSE 0 END + CASE WHEN total > captured THEN 1 ELSE 0 END + CASE WHEN accepted < 24 THEN 1 ELSE 0 END AS warnings FROM t""")  # fmt: skip
def prj20(spark, sf):
    k = F.col("p_partkey")
    t = read(spark, sf, "part").select(
        k.alias("k"), F.when(k % 7 == 0, "invalid").when(k % 7 == 1, "recovering").otherwise("healthy").alias("valid"), F.col("p_size").alias("accepted"), (k % 5).alias("total"), (k % 3).alias("captured"),
        F.when(k % 11 == 0, "lost").otherwise("active").alias("tracking"), F.when(k % 13 == 0, "move-slower").otherwise("good").alias("advice"), (F.col("p_size") * 2).alias("view"))
    message, warnings = rules.capture_guidance(*map(F.col, ("valid", "accepted", "total", "captured", "tracking", "advice", "view")))
    return t.select("k", message.alias("message"), F.size(warnings).alias("warnings"))


@query("prj21_pose_angle", f"""WITH {POSES}, q AS (SELECT event_id, user_id, t, cos(radians(yaw)/2) AS w, sin(radians(yaw)/2) AS y FROM p), d AS (SELECT event_id, abs(w * lag(w) OVER o + y * lag(y) OVER o) AS dot FROM q WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT event_id, round(degrees(2 * acos(least(1.0, round(dot, 9)))), 3) AS angle FROM d""")  # fmt: skip
def prj21(spark, sf):
    half = F.radians("yaw") / 2
    o = Window.partitionBy("user_id").orderBy("t", "event_id")
    q = poses(spark, sf).select("event_id", "user_id", "t", F.cos(half).alias("w"), F.sin(half).alias("y"))
    q = q.withColumn("w0", F.lag("w").over(o)).withColumn("y0", F.lag("y").over(o))
    dot = r(F.abs(F.col("w") * F.col("w0") + F.col("y") * F.col("y0")), 9)
    return q.select("event_id", r(vm.quaternion_angle_degrees((dot,), (F.lit(1.0),)), 3).alias("angle"))


@query("prj22_plane_normalisation", f"WITH {SAMPLES} SELECT id, round(nx, 6) AS nx, round((x + 1) / 3, 6) AS k FROM s")
def prj22(spark, sf):
    n, k = vm.normalized_plane(vm.scale(vm.v("n"), 3.0), F.col("x") + 1)
    return samples(spark, sf).select("id", r(n[0], 6).alias("nx"), r(k, 6).alias("k"))


@query("prj23_plane_lines", """
    WITH t AS (SELECT p_partkey AS id, (p_size - 25) / 50.0::DOUBLE AS a, p_partkey % 10 / 10.0::DOUBLE AS d FROM part)
    SELECT id, round(1 / sqrt(1 + a*a), 6) AS ux, round(-a / sqrt(1 + a*a), 6) AS uy, round(d*a / (1 + a*a), 6) AS ox, round(d / (1 + a*a), 6) AS oy, 0.5::DOUBLE AS oz, true AS exact FROM t""")  # fmt: skip
def prj23(spark, sf):
    a, d = (F.col("p_size") - 25) / 50.0, F.col("p_partkey") % 10 / 10.0
    size = F.sqrt(a * a + 1)
    first, second = (a / size, F.lit(1.0) / size, F.lit(0.0)), vm.vec(0.0, 0.0, 1.0)
    origin, along = vm.plane_plane_line(first, d / size, second, F.lit(0.5))
    error = vm.line_invariant_error(first, d / size, second, F.lit(0.5), origin, along)
    clean = lambda x: r(x, 6) + 0.0
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), clean(along[0]).alias("ux"), clean(along[1]).alias("uy"), clean(origin[0]).alias("ox"), clean(origin[1]).alias("oy"), clean(origin[2]).alias("oz"), (error <= 1e-6).alias("exact"))


@query("prj24_three_planes", "SELECT p_partkey AS id, round(p_size / 10.0::DOUBLE - p_partkey % 7, 6) AS x, (p_partkey % 7)::DOUBLE AS y, 2.0::DOUBLE AS z FROM part")
def prj24(spark, sf):
    d1, d2 = F.col("p_size") / 10.0, (F.col("p_partkey") % 7).cast("double")
    p = vm.three_plane_point(vm.vec(1.0, 1.0, 0.0), d1, vm.vec(0.0, 1.0, 0.0), d2, vm.vec(0.0, 0.0, 2.0), F.lit(4.0))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), *(r(x, 6).alias(n) for x, n in zip(p, "xyz", strict=True)))


@query("prj27_point_segment", f"""
    WITH {SAMPLES}, t AS (SELECT *, ((x + .1::DOUBLE) * .2::DOUBLE + y * .1::DOUBLE) / .05::DOUBLE AS t FROM s), k AS (SELECT *, least(1.0, greatest(0.0, t)) AS k FROM t)
    SELECT id, round(sqrt((x + .1 - .2*k)**2 + (y - .1*k)**2 + z**2), 6) AS distance, round(greatest(0, -t, t - 1) * sqrt(.05), 6) AS beyond FROM k""")  # fmt: skip
def prj27(spark, sf):
    d, _, beyond = vm.point_segment(vm.v(), vm.vec(-0.1, 0.0, 0.0), vm.vec(0.1, 0.1, 0.0))
    return samples(spark, sf).select("id", r(d, 6).alias("distance"), r(beyond, 6).alias("beyond"))


@query("prj28_segment_distance", f"""
    WITH {SAMPLES} SELECT id, round(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN -.5 AND .5 THEN abs(z) ELSE sqrt(greatest(0, -x, x-1)**2 + greatest(0, abs(y) - .5)**2 + z**2) END, 6) AS distance FROM s""")  # fmt: skip
def prj28(spark, sf):
    x, y, z = vm.v()
    d = vm.segment_segment_distance(vm.vec(0.0, 0.0, 0.0), vm.vec(1.0, 0.0, 0.0), (x, y - 0.5, z), (x, y + 0.5, z))
    return samples(spark, sf).select("id", r(d, 6).alias("distance"))


@query("prj29_polygon_status", f"""
    WITH {SAMPLES} SELECT id, (x > -.1::DOUBLE) <> (x > .15::DOUBLE) AND (y > -.1::DOUBLE) <> (y > .1::DOUBLE) AS inside, round(CASE WHEN x BETWEEN -.1 AND .15 AND y BETWEEN -.1 AND .1 THEN least(x + .1, .15 - x, y + .1, .1 - y) ELSE sqrt(greatest(0, -.1 - x, x - .15)**2 + greatest(0, abs(y) - .1)**2) END, 6) AS edge FROM s""")  # fmt: skip
def prj29(spark, sf):
    polygon = F.array(*(F.struct(F.lit(a).alias("u"), F.lit(b).alias("v")) for a, b in ((-0.1, -0.1), (0.15, -0.1), (0.15, 0.1), (-0.1, 0.1))))
    inside, edge = vm.polygon_status(F.col("x"), F.col("y"), polygon)
    return samples(spark, sf).select("id", inside.alias("inside"), r(edge, 6).alias("edge"))


@query("prj30_paint", "SELECT p_partkey, CASE WHEN p_size > 40 THEN '#123456' WHEN p_size % 3 = 0 THEN '#c8e1e4' WHEN p_size % 3 = 1 THEN '#c9e3cf' ELSE '#d8cceb' END AS colour FROM part")
def prj30(spark, sf):
    role = F.when(F.col("p_size") % 3 == 0, "wall").when(F.col("p_size") % 3 == 1, "floor").otherwise("ceiling")
    return read(spark, sf, "part").select("p_partkey", colour.paint_colour(role, F.when(F.col("p_size") > 40, "#123456")).alias("colour"))


@query("prj31_movement", """SELECT p_partkey, round(k * (sin(a) * f + cos(a) * s), 6) AS dx, round(k * (-cos(a) * f + sin(a) * s), 6) AS dz FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, p_partkey % 3 - 1.0::DOUBLE AS f, p_partkey % 2 AS s,
    CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 0 ELSE 1.4 * least(.1, p_size / 100.0::DOUBLE) * least(1, sqrt((p_partkey % 3 - 1)**2 + (p_partkey % 2)**2)) / sqrt((p_partkey % 3 - 1)**2 + (p_partkey % 2)**2) END AS k FROM part)""")  # fmt: skip
def prj31(spark, sf):
    k = F.col("p_partkey")
    x, z = rules.movement(F.col("p_size") / 10.0, k % 3 - 1.0, (k % 2).cast("double"), 1.4, F.col("p_size") / 100.0)
    return read(spark, sf, "part").select("p_partkey", (r(x, 6) + 0.0).alias("dx"), (r(z, 6) + 0.0).alias("dz"))


@query("prj32_footprint", """WITH t AS (SELECT p_partkey, greatest(a, b) + least(a, b) * .35 AS d FROM (SELECT p_partkey, abs(p_size - 25) / 25.0::DOUBLE AS a, p_partkey % 20 / 20.0::DOUBLE AS b FROM part)), k AS (SELECT *, least(1, greatest(0, (d - .72) / .28)) AS t FROM t)
    SELECT p_partkey, round(CASE WHEN d <= .72 THEN 1 WHEN 1 - t*t*(3-2*t) < .02 THEN 0 ELSE 1 - t*t*(3-2*t) END, 6) AS alpha FROM k""")  # fmt: skip
def prj32(spark, sf):
    return read(spark, sf, "part").select("p_partkey", r(rules.footprint_alpha((F.col("p_size") - 25) / 25.0, F.col("p_partkey") % 20 / 20.0), 6).alias("alpha"))


@query("prj33_visual_radius", """WITH t AS (SELECT p_partkey, least(.04, greatest(.004, p_size / 2000.0::DOUBLE)) AS b, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 50 / 500.0::DOUBLE END AS gap FROM part)
    SELECT p_partkey, round(least(.04, greatest(.004, CASE WHEN gap IS NULL THEN b ELSE greatest(b, least(.04, b * 1.8, gap / 1.6 * 1.1)) END)), 6) AS radius FROM t""")  # fmt: skip
def prj33(spark, sf):
    gap = F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 50 / 500.0)
    return read(spark, sf, "part").select("p_partkey", r(rules.visual_radius(F.col("p_size") / 2000.0, gap), 6).alias("radius"))


@query("fil1_valid_depth", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 0 AND value < 100 AND isfinite(value)")
def fil1(spark, sf):
    return read(spark, sf, "events").filter(num.finite("value") & (F.col("value") > 0) & (F.col("value") < 100)).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("fil7_appearance_decision", """SELECT CASE WHEN p_partkey % 9 = 0 THEN 'queue-pressure' WHEN p_partkey * 10 % 6000 >= 4000 AND p_size * 2 < 80 AND p_partkey % 70 < 65 THEN 'reserved-appearance-opportunity' WHEN p_size * 2 >= 48 THEN 'xr-timing-pressure' WHEN p_partkey % 70 >= 42 THEN 'processing-pressure' ELSE 'stable-opportunity' END AS decision, count(*) AS n FROM part GROUP BY ALL""")
def fil7(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").groupBy(rules.appearance_decision(F.when(k % 9 == 0, 1).otherwise(0), k * 10 % 6000, F.col("p_size") * 2, k % 70).alias("decision")).agg(F.count("*").alias("n"))


@query("fil10_same_matrices", "SELECT count(*) FILTER (p_size % 5 = 0 AND p_partkey % 2 = 0) AS same, count(*) AS n FROM part")
def fil10(spark, sf):
    a = F.array(F.col("p_size").cast("double"), F.lit(1.0))
    b = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_size") + F.when(F.col("p_size") % 5 == 0, 1e-7).otherwise(0.1), F.lit(1.0)))
    return read(spark, sf, "part").agg(F.count_if(camera.same_matrices(a, b)).alias("same"), F.count("*").alias("n"))


_LAG = f"""WITH {POSES}, d AS (SELECT *, greatest(.001, (t - lag(t) OVER o) / 1e6) AS dt, sqrt((px - lag(px) OVER o)**2 + (py - lag(py) OVER o)**2 + (pz - lag(pz) OVER o)**2) AS move FROM p WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id))"""


def _steps(spark, sf):
    o = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = poses(spark, sf)
    for k in ("t", "px", "py", "pz"):
        p = p.withColumn(f"{k}0", F.lag(k).over(o))
    return p.withColumn("dt", F.greatest(F.lit(0.001), (F.col("t") - F.col("t0")) / 1e6)).withColumn("move", F.sqrt(F.pow(F.col("px") - F.col("px0"), 2) + F.pow(F.col("py") - F.col("py0"), 2) + F.pow(F.col("pz") - F.col("pz0"), 2))).withColumn("dt", F.when(F.col("t0").isNotNull(), F.col("dt")))


@query("win1_pose_deltas", f"{_LAG} SELECT event_id, round(CASE WHEN move IS NOT NULL THEN dt END, 2) AS dt, round(move, 5) AS move, round(move / dt, 5) AS velocity FROM d")
def win1(spark, sf):
    return _steps(spark, sf).select("event_id", r("dt", 2).alias("dt"), r("move", 5).alias("move"), r(F.col("move") / F.col("dt"), 5).alias("velocity"))


@query("win3_history_percentile", """SELECT event_id, (list_sort(list(value) OVER w))[floor((count(*) OVER w - 1) * .95)::INT + 1] AS p95 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)""")
def win3(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-511, 0)
    values = F.sort_array(F.collect_list("value").over(w))
    return read(spark, sf, "events").withColumn("v", values).select("event_id", F.get("v", F.floor((F.size("v") - 1) * F.lit(0.95)).cast("int")).alias("p95"))


@query("win5_global_share", "SELECT s_suppkey, round(s_acctbal / max(s_acctbal) OVER (), 6) AS share FROM supplier")
def win5(spark, sf):
    s = read(spark, sf, "supplier")
    return s.join(F.broadcast(s.agg(F.max("s_acctbal").alias("top"))), F.lit(True)).select("s_suppkey", r(F.col("s_acctbal") / F.col("top"), 6).alias("share"))


@query("win7_first_last", "SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id")
def win7(spark, sf):
    return poses(spark, sf).groupBy("user_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min_by("event_type", F.struct("t", "event_id")).alias("first_type"))


@query("win8_elapsed_buckets", """WITH e AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 6e10 AS s FROM events)
    SELECT CASE WHEN s < 10 THEN '0-10' WHEN s < 20 THEN '10-20' WHEN s < 40 THEN '20-40' ELSE '40+' END AS bucket, count(*) AS n FROM e GROUP BY ALL""")  # fmt: skip
def win8(spark, sf):
    s = (F.col("t") - F.min("t").over(Window.partitionBy("user_id"))) / 6e10
    e = poses(spark, sf).withColumn("s", s)
    return e.groupBy(F.when(F.col("s") < 10, "0-10").when(F.col("s") < 20, "10-20").when(F.col("s") < 40, "20-40").otherwise("40+").alias("bucket")).agg(F.count("*").alias("n"))


@query("srt1_total_sort", "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def srt1(spark, sf):
    return graph.placed(read(spark, sf, "supplier"), "place", F.desc("s_acctbal"), F.col("s_suppkey").asc()).select("s_suppkey", "s_name", "place")


@query("srt2_top_k_per_key", "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def srt2(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("o_custkey", "o_orderkey", "k")


@query("srt3_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24")
def srt3(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(24).select("o_orderkey", "o_totalprice")


_NTH = f"WITH {LINES}, n AS (SELECT frame, l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY {_ORDER}) - 1 AS i FROM li)"


def _nth(spark, sf):
    placed = running(lines(spark, sf).select("frame", *LINE_ORDER), ["frame"], LINE_ORDER)
    return placed.select("frame", "l_orderkey", "l_linenumber", "l_partkey", F.col("total").alias("n"), F.col("before").alias("i"))


@query("smp1_stride", f"{_NTH} SELECT frame, l_orderkey, l_linenumber, l_partkey FROM n WHERE i % ceil(n / 256.0)::BIGINT = 0")
def smp1(spark, sf):
    return _nth(spark, sf).filter(F.col("i") % F.ceil(F.col("n") / 256.0) == 0).drop("n", "i")


@query("smp2_even_indices", f"{_NTH}, k AS (SELECT frame, floor(i * (n - 1) / 23.0 + .5)::BIGINT AS i FROM (SELECT DISTINCT frame, n FROM n), range(24) t(i)) SELECT DISTINCT frame, l_orderkey, l_linenumber, l_partkey, i FROM n JOIN k USING (frame, i)")
def smp2(spark, sf):
    n = _nth(spark, sf)
    wanted = n.select("frame", "n").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("frame", num.round_half_up(F.col("k") * (F.col("n") - 1) / 23.0).alias("i")).distinct()
    return n.drop("n").join(wanted, ["frame", "i"]).select("frame", "l_orderkey", "l_linenumber", "l_partkey", "i")


@query("smp4_capped_audit", "SELECT l_returnflag, least(count(*), 12000) AS kept, greatest(0, count(*) - 12000) AS omitted FROM lineitem GROUP BY l_returnflag")
def smp4(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.least(F.count("*"), F.lit(12000)).alias("kept"), F.greatest(F.lit(0), F.count("*") - 12000).alias("omitted"))


@query("set1_union_distinct", "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def set1(spark, sf):
    a = read(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("k"))
    return a.union(read(spark, sf, "orders").filter("o_totalprice > 400000").select("o_orderkey")).distinct()


@query("set2_intersection", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice > 250000)")
def set2(spark, sf):
    a = read(spark, sf, "lineitem").filter("l_quantity > 40").select("l_orderkey")
    return a.intersect(read(spark, sf, "orders").filter("o_totalprice > 250000").select("o_orderkey")).agg(F.count("*").alias("n"))


@query("set3_sorted_unique", "SELECT l_suppkey, list_sort(list_distinct(list(l_linenumber)))::VARCHAR AS numbers FROM lineitem GROUP BY l_suppkey")
def set3(spark, sf):
    out = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    return out.select("l_suppkey", F.concat(F.lit("["), F.array_join(F.col("n").cast("array<string>"), ", "), F.lit("]")).alias("numbers"))


@query("set4_difference", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def set4(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("set6_bit_sets", "SELECT l_suppkey, bit_count(bit_or(1::BIGINT << (l_linenumber % 60))) AS frames FROM lineitem GROUP BY l_suppkey")
def set6(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, l_linenumber % 60)"))).alias("frames"))


@query("set6_frame_masks", """
    WITH f AS (SELECT DISTINCT l_suppkey AS s, l_orderkey % 96 AS f FROM lineitem), n AS (SELECT s, count(*) AS frames FROM f GROUP BY s)
    SELECT n.s AS l_suppkey, n.frames, o.frames AS next_frames, o.frames - count(a.f) AS only_next, count(a.f) AS shared
    FROM n JOIN n o ON o.s = n.s + 1 JOIN f b ON b.s = o.s LEFT JOIN f a ON a.s = n.s AND a.f = b.f GROUP BY n.s, n.frames, o.frames""")  # fmt: skip
def set6_masks(spark, sf):
    """Each supplier's set of 96 frames beside the next one's: what the next adds, and what both have."""
    n = masks.words(95)
    of = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*(m.alias(w) for m, w in zip(masks.united(masks.bit(F.col("l_orderkey") % 96, n)), masks.names("m", n), strict=True)))
    following = of.select((F.col("l_suppkey") - 1).alias("l_suppkey"), *(F.col(w).alias("o_" + w) for w in masks.names("m", n)))
    a, b = masks.columns("m", n), masks.columns("m", n, "o_")
    return of.join(following, "l_suppkey").select("l_suppkey", masks.size(a).alias("frames"), masks.size(b).alias("next_frames"), masks.size(masks.less(b, a)).alias("only_next"), masks.size(masks.both(a, b)).alias("shared"))


@query("scores", f"""
    WITH {SAMPLES} SELECT id, round(least(1, .35 + .3*least(1, seen/6) + .2*least(1, views/2) + .15*red), 6) AS canonical, round(least(1, greatest(0, .45*seen/5 + .25*least(2, views)/2 + .2*red + .1*least(2000, id)/2000)), 6) AS dense,
      round(.55*least(1, id/3600) + .25*least(1, red/.45) + .2*least(1, green*90/35), 6) AS keyframe, round(least(1, greatest(0, .45*least(1, seen/48) + .35*red + .2*(1-least(1, blue/.035)))), 6) AS plane,
      round(seen*100 + CASE WHEN views > 1 THEN 20 ELSE 0 END + least(20, id/100), 6) AS retention, round(.45*red + .2*green + .2*blue + .1/(1+seen) + .05/(1+abs(x)), 6) AS view,
      CASE WHEN red >= .3 AND green*20 >= 5 THEN 3 WHEN red >= .08 OR green*20 >= 3 THEN 2 ELSE 1 END AS views3, round(.55*(1-red/2) + CASE WHEN views > 1 THEN .25 ELSE .15 END + .2*green, 6) AS patch FROM s""")  # fmt: skip
def scores(spark, sf):
    cols = {
        "canonical": rules.canonical_confidence("seen", "views", "red"), "dense": rules.dense_confidence("seen", "views", "red", "id"), "keyframe": rules.keyframe_quality("id", "red", F.col("green") * 90),
        "plane": rules.plane_confidence("seen", "red", "blue"), "retention": rules.retention_value("seen", F.col("views") > 1, "id"), "view": rules.view_rank("red", "green", "blue", "seen", "x"),
        "patch": rules.patch_association("red", F.lit(2.0), F.col("views") > 1, "green"),
    }
    return samples(spark, sf).select("id", *(r(v.cast("double"), 6).alias(k) for k, v in cols.items()), rules.canonical_views("red", F.col("green") * 20).alias("views3"))


@query("cls10_view_ranking", f"""WITH {SAMPLES}, v AS (SELECT frame, id, round(.45*red + .2*green + .2*abs(nz) + .1/(1+sqrt(x*x+y*y+z*z)) + .05/(1+abs(blue-.5)), 9) AS score FROM s)
    SELECT frame, id, k FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS k FROM v) WHERE k <= 4""")  # fmt: skip
def cls10(spark, sf):
    score = r(rules.view_rank("red", "green", F.abs("nz"), vm.length(vm.v()), F.col("blue") - 0.5), 9)
    w = Window.partitionBy("frame").orderBy(F.desc("score"), "id")
    return samples(spark, sf).withColumn("score", score).withColumn("k", F.row_number().over(w)).filter("k <= 4").select("frame", "id", "k")


