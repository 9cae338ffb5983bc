"""Coverage mapping against a plain version without buckets, and as a stream with restarts and late rows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gridwise.operators import coverage as cov
from gridwise.streaming.coverage import mapped_stream

COLUMNS = "scan long, ms double, id long, u double, v double, depth double, x double, y double, z double, cam_x double, cam_y double, cam_z double, dir_x double, dir_y double, dir_z double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def observations(seed, scans=3, ticks=14, w=6, h=5):
    """Frames of a grid over a floor and two walls a few centimetres apart, with gaps, noise, repeats and bad rows."""
    rng, rows, n = random.Random(seed), [], 0
    for scan in range(scans):
        ms, cam, yaw = 0.0, [0.0, 1.5, 0.0], 0.0
        for _ in range(ticks):
            ms += rng.choice([60, 150, 200, 400])
            cam = [c + rng.choice([0.0, 0.0, 0.02, 0.3]) for c in cam]
            yaw += rng.choice([0.0, 0.0, 0.1, 0.3])
            camera = cam if rng.random() > 0.08 else [None, cam[1], cam[2]]
            direction = [math.sin(yaw), 0.0, -math.cos(yaw)] if rng.random() > 0.15 else [None, None, None]
            start = (rng.uniform(0, 0.3), rng.uniform(0, 0.2), rng.choice([0.0, 0.0, 0.07]))
            tilt = rng.choice([0.0, 0.0, 1.2])
            for i in range(w):
                for j in range(h):
                    for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2])):
                        n += 1
                        a, b = i * 0.045 + rng.gauss(0, 0.004), j * 0.045 + rng.gauss(0, 0.004)
                        point = (start[0] + a, start[1] + b, -start[2] + tilt * a + rng.gauss(0, 0.003))
                        bad = rng.random()
                        u, depth = (1.2, 1.0) if bad < 0.02 else (i / (w - 1), None if bad < 0.04 else rng.choice([1.0, 1.0, 1.0, 1.0, 1.6]) if bad < 0.1 else 1.0)
                        rows.append((scan, ms, n, u, j / (h - 1), depth, *point, *camera, *direction))
    return rows


def plain_outcomes(rows, w, h):
    """The rules over all cells and regions of a scan, in order."""
    out = {}
    for scan in sorted({r[0] for r in rows}):
        cells, regions, last = [], [], None
        for ms in sorted({r[1] for r in rows if r[0] == scan}):
            tick = sorted((dict(zip(NAMES, r, strict=True)) for r in rows if r[0] == scan and r[1] == ms), key=lambda r: r["id"])
            say = lambda r, what: out.__setitem__(r["id"], what)
            if last is not None and ms - last < 140:
                [say(r, ("between ticks", None, None)) for r in tick]
                continue
            last = ms
            cam = [tick[0][f"cam_{a}"] for a in "xyz"]
            if None in cam:
                [say(r, ("no camera", None, None)) for r in tick]
                continue
            face = [tick[0][f"dir_{a}"] for a in "xyz"]
            face = None if None in face else face
            grid = {}
            for r in tick:
                if r["depth"] is None or not (0 <= r["u"] <= 1 and 0 <= r["v"] <= 1 and r["depth"] > 0):
                    say(r, ("invalid", None, None))
                    continue
                at = (round(r["v"] * (h - 1)), round(r["u"] * (w - 1)))
                if at in grid:
                    say(grid[at], ("replaced", None, None))
                grid[at] = r
            taken, keys, counted = set(), set(), set()
            xyz = lambda r: (r["x"], r["y"], r["z"])
            for (j, i), r in grid.items():
                p = xyz(r)
                here = tuple(math.floor(c / 0.05) for c in p)
                if here in taken:
                    say(r, ("same cell", None, None))
                    continue
                taken.add(here)
                four = [grid.get(a) for a in ((j, i - 1), (j, i + 1), (j - 1, i), (j + 1, i))]
                n = None
                if None not in four and max(abs(q["depth"] - r["depth"]) for q in four) <= 0.4:
                    a, b = ([s - t for s, t in zip(xyz(four[k + 1]), xyz(four[k]), strict=True)] for k in (0, 2))
                    if math.hypot(*a) <= 0.8 and math.hypot(*b) <= 0.8:
                        n = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
                        size = math.hypot(*n)
                        n = tuple(c / size for c in n) if size > 1e-6 else None
                        if n and sum(c * (k - q) for c, k, q in zip(n, cam, p, strict=True)) < 0:
                            n = tuple(-c for c in n)

                def near(entries, size, p=p, n=n):
                    found = []
                    for k, e in enumerate(entries):
                        d = [s - t for s, t in zip(e["p"], p, strict=True)]
                        dot = lambda s, t: sum(x * y for x, y in zip(s, t, strict=True))
                        if max(abs(s - math.floor(t / size)) for s, t in zip(e["home"], p, strict=True)) > 1 or dot(d, d) >= 0.01:
                            continue
                        if e["n"] and ((n and dot(n, e["n"]) < math.cos(math.radians(50))) or abs(dot(d, e["n"])) > 0.06):
                            continue
                        found.append((dot(d, d), k))
                    return min(found)[1] if found else None

                key = near(cells, 0.05)
                fresh, founded = key is None, False
                if fresh:
                    g = near(regions, 0.1)
                    if g is None:
                        founded, g = True, len(regions)
                        regions.append({"p": p, "n": n, "seen": 1, "cam": cam, "face": face, "home": [math.floor(c / 0.1) for c in p]})
                    key = len(cells)
                    cells.append({"p": p, "n": n, "region": g, "home": here})
                again = key in keys
                keys.add(key)
                g = cells[key]["region"]
                region = regions[g]
                if founded:
                    counted.add(g)
                    say(r, ("founded", 1, "observed"))
                elif again or g in counted:
                    say(r, ("same surface" if again else "same region", region["seen"], None))
                else:
                    counted.add(g)
                    cosine = region["face"] and face and max(-1, min(1, sum(s * t for s, t in zip(region["face"], face, strict=True)) / math.hypot(*region["face"]) / math.hypot(*face)))
                    if math.dist(region["cam"], cam) < 0.03 and not (cosine is not None and math.acos(cosine) >= math.radians(10)):
                        say(r, ("same viewpoint", region["seen"], None))
                        continue
                    region["seen"] += 1
                    region["cam"], region["face"] = cam, face
                    for e in (region, cells[key]):
                        e["p"] = tuple(s + (t - s) / region["seen"] for s, t in zip(e["p"], p, strict=True))
                        if n and e["n"]:
                            sign = -1 if sum(s * t for s, t in zip(e["n"], n, strict=True)) < 0 else 1
                            both = [s + sign * t for s, t in zip(e["n"], n, strict=True)]
                            size = math.hypot(*both)
                            e["n"] = tuple(c / size for c in both) if size > 1e-6 else e["n"]
                        else:
                            e["n"] = e["n"] or n
                    say(r, ("counted in a new cell" if fresh else "counted", region["seen"], {2: "partial", 3: "captured"}.get(region["seen"])))
    return out


def got(df):
    return {r["id"]: (r["outcome"], r["seen"], r["transition"]) for r in df.collect()}


def test_equals_plain(spark):
    seen = set()
    for seed in range(3):
        rows = observations(seed)
        want = plain_outcomes(rows, 6, 5)
        assert got(cov.mapped(spark.createDataFrame(rows, COLUMNS).repartition(5), ["id"], 6, 5)) == want
        seen |= {(o, t) for o, _, t in want.values()}
    names = {o for o, _ in seen}
    assert names == {"between ticks", "no camera", "invalid", "replaced", "same cell", "founded", "same surface", "same region", "same viewpoint", "counted", "counted in a new cell"}
    assert {t for _, t in seen} == {None, "observed", "partial", "captured"}


def test_regions(spark):
    out = cov.mapped(spark.createDataFrame(observations(1), COLUMNS), ["id"], 6, 5)
    regions = cov.regions_of(out).collect()
    assert {r["state"] for r in regions} == {"observed", "partial", "captured"}
    assert sum(r["seen"] for r in regions) == out.filter("outcome in ('founded', 'counted', 'counted in a new cell')").count()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_equals_batch(spark, tmp_path, rocks):
    """Ticks split over files, a restart from the checkpoint after each, and rows that come too late at the end."""
    rows = observations(5, scans=2, ticks=9)
    df = spark.createDataFrame(rows, COLUMNS)
    batch = got(cov.mapped(df, ["id"], 6, 5))
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    cuts = [0, len(order) // 3 + 4, 2 * len(order) // 3 + 5, len(order)]
    late = [(*order[0][:2], 10_000, *order[0][3:]), (*order[-40][:1], order[-40][1] - 1, 10_001, *order[-40][3:])]
    outcome = f"{COLUMNS}, {cov.SCHEMA}"
    parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [late]
    for k, part in enumerate(parts):  # a query of its own each: it begins with the state of the last
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
        q = mapped_stream(stream, ["id"], 6, 5, wait_ms=8_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        # with timers a trigger always has something to do, so the query is never at rest: wait for its input or output
        end = time.time() + 60
        while time.time() < end and q.isActive:
            taken = sum(p.numInputRows for p in q.recentProgress)
            if taken >= len(part) and (k < 2 or spark.read.schema(outcome).parquet(str(tmp_path / "out")).count() >= len(rows) + (2 if k == 3 else 0)):
                break
            time.sleep(0.3)
        assert q.exception() is None
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("outcome = 'late'").select("id").distinct().count() >= 2
    kept = got(out.filter(F.col("id") < 10_000))
    assert kept == batch and out.count() == len(rows) + 2
