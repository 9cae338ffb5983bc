"""Greedy selection of walls and competition of triads against plain versions, and in a room with two rival corners."""

import itertools
import math
import random
import statistics

from pyspark.sql import functions as F

from gridwise.operators import selection as sel, structure


def joined(edges):
    """Plain: sets of ids, each with the key of the edge that began it."""
    groups = []
    for _, a, b, key in sorted(edges):
        of = lambda x: next((g for g in groups if x in g["ids"]), None) or groups.append({"ids": [x], "key": None}) or groups[-1]
        g, h = of(a), of(b)
        if g is h or (g["key"] not in (None, key)) or (h["key"] not in (None, key)):
            continue
        g["ids"] += h["ids"]
        g["key"] = key
        groups.remove(h)
    return {x: g["ids"][0] for g in groups for x in g["ids"]}


def test_constrained_components(spark):
    rng, rows, want = random.Random(3), [], {}
    for scan in range(25):
        edges = [(i, rng.randrange(14), rng.randrange(14), rng.choice("xyz"[: 1 + scan % 3])) for i in range(rng.choice([1, 5, 20, 60]))]
        rows += [(scan, "anchor", *e) for e in edges]
        want |= {(scan, i): c for i, c in joined(edges).items()}
    df = spark.createDataFrame(rows, "scan long, kind string, place int, a long, b long, key string").repartition(7)
    assert {(r["scan"], r["id"]): r["component"] for r in sel.constrained_components(df).collect()} == want


def replay(walls, pairs, seed, triads):
    """Plain rounds: every choice looks at all facts anew."""
    fact = lambda x, y: next(p for p in pairs if {p["a"], p["b"]} == {x, y})
    wall = {w["plane"]: w for w in walls}
    apart = lambda x, y: fact(x, y)["offset"] >= 0.75 and fact(x, y)["gap"] >= 0.8 and wall[x]["envelope"] >= 0.72 and wall[x]["evident"]
    ok = [w["plane"] for w in walls if w["eligible"]]
    chosen, alternates, accepted = [], [], []
    cores = [p for p in pairs if p["core"] is not None]
    if cores:
        p = min(cores, key=lambda p: (-p["core"], -p["score"], p["a"], p["b"]))
        chosen += [p["a"], p["b"]]
    elif seed is not None:
        chosen.append(seed)
    while chosen:
        options = []
        for x in ok:
            if x not in chosen and x not in alternates:
                options += [(-fact(x, y)["score"], -wall[x]["final"], x) for y in chosen if fact(x, y)["edge"] and fact(x, y)["score"] >= 0.84]
        if not options:
            break
        x = min(options)[2]
        closest = min(fact(x, y)["angle"] for y in chosen)
        (alternates if closest <= 18 and not any(apart(x, y) for y in chosen) else chosen).append(x)
    if not chosen and ok:
        chosen.append(min(ok, key=lambda x: (-wall[x]["final"], x)))
    while True:
        options = []
        for x in ok:
            mine = [t for t in triads if t["a"] == x and t["b"] in chosen]
            if x in chosen or not mine or any(fact(x, y)["angle"] <= 18 and not apart(x, y) for y in chosen):
                continue
            t = min(mine, key=lambda t: (-t["coherence"], t["b"], t["h"]))
            if t["failed"] == "none":
                options.append((-t["coherence"], x, t))
        if not options:
            return chosen, alternates, accepted
        *_, x, t = min(options, key=lambda o: o[:2])
        chosen.append(x)
        accepted.append((t["a"], t["b"], t["h"]))


def test_rounds_equal_replay():
    rng, seen = random.Random(8), set()
    for case in range(400):
        n = rng.randrange(1, 9)
        cut = lambda k=1: round(rng.random(), k)  # noqa: E731  ties
        walls = [{"plane": x, "final": cut(), "envelope": 0.5 + cut() / 2, "evident": rng.random() < 0.7, "eligible": rng.random() < 0.85} for x in range(n)]
        pairs = []
        for a, b in itertools.combinations(range(n), 2):
            score = rng.choice([None, 0.5, 0.84, 0.9, 0.95])
            core = score * 0.8 if score and score >= 0.84 and walls[a]["eligible"] and walls[b]["eligible"] and rng.random() < 0.15 else None
            pairs.append({"a": a, "b": b, "angle": rng.choice([5.0, 18.0, 30.0, 60.0, 90.0]), "offset": cut() * 1.5, "gap": cut() * 1.5, "edge": score and rng.choice(["corner", "parallel-boundary"]), "score": score, "core": core})
        triads = [{"a": a, "b": b, "h": h, "coherence": cut(), "failed": rng.choice(["none", "none", "coherence"])} for a in range(n) for b in range(n) for h in (100, 101) if a != b and walls[a]["eligible"] and walls[b]["eligible"] and rng.random() < 0.5]
        seed = rng.choice([None, next((w["plane"] for w in walls if w["eligible"]), None)])
        w = sel._Walls(walls, pairs)
        sel._grow(w, seed)
        accepted = [(t["a"], t["b"], t["h"]) for t in sel._add_triads(w, rng.sample(triads, len(triads)))]
        want = replay(walls, pairs, seed, triads)
        assert (list(w.chosen), list(w.alternates), accepted) == want, case
        seen.add((bool(want[1]), bool(want[2]), len(want[0]) > 2))
    assert len(seen) >= 6


def test_overlaps_equal_plain(spark):
    rng = random.Random(4)
    planes, points = [], []
    for plane in range(6):
        n = [rng.gauss(0, 1), 0.1 * rng.gauss(0, 1), rng.gauss(0, 1)]
        size = math.sqrt(sum(x * x for x in n))
        n = [x / size for x in n]
        c = [rng.uniform(-0.3, 0.3) for _ in range(3)]
        planes.append((0, plane, *n, sum(x * y for x, y in zip(n, c, strict=True)), *c))
        points += [(0, plane, *(x + rng.gauss(0, 0.4) for x in c)) for _ in range([0, 1, 7, 40, 40, 25][plane])]
    p = spark.createDataFrame(planes, "scan long, plane long, nx double, ny double, nz double, k double, cx double, cy double, cz double")
    q = spark.createDataFrame(points, "scan long, plane long, x double, y double, z double")
    pairs = [(0, a, b) for a in range(6) for b in range(6) if a != b]
    got = {(r["p"], r["q"]): r for r in sel.support_overlaps(spark.createDataFrame(pairs, "scan long, p long, q long"), p, q).collect()}
    of = {k: [x[2:] for x in points if x[1] == k] for k in range(6)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for _, a, b in pairs:
        row, na, nb, c = got[a, b], planes[a][2:5], planes[b][2:5], planes[a][6:]
        assert math.isclose(row["angle"], math.degrees(math.acos(min(1, abs(dot(na, nb))))), abs_tol=1e-6)
        if not of[a] or not of[b]:
            assert row["cells"] == 0 and row["extent"] == 0 and row["centroids"] is None and row["support"] is None
            continue
        from_plane = lambda pts, n, k: statistics.median(abs(dot(n, x) - k) for x in pts)
        assert math.isclose(row["support"], max(from_plane(of[a], nb, planes[b][5]), from_plane(of[b], na, planes[a][5])), abs_tol=1e-9)
        mean = lambda pts: [statistics.fmean(x) for x in zip(*pts, strict=True)]
        assert math.isclose(row["centroids"], math.dist(mean(of[a]), mean(of[b])), abs_tol=1e-9)
        # tangents are any orthonormal pair by a fixed rule; take them from the library's and check their geometry
        t, s = spark.range(1).select(*(F.array(*v) for v in sel.vm.tangent_basis(sel.vm.vec(*map(F.lit, na))))).first()
        assert abs(dot(t, na)) < 1e-9 and abs(dot(t, s)) < 1e-9 and abs(dot(t, t) - 1) < 1e-9
        uv = {k: [(dot([x - y for x, y in zip(pt, c, strict=True)], t), dot([x - y for x, y in zip(pt, c, strict=True)], s)) for pt in of[k]] for k in (a, b)}
        cells = {k: {(math.floor(u / 0.15), math.floor(v / 0.15)) for u, v in uv[k]} for k in (a, b)}
        assert math.isclose(row["cells"], len(cells[a] & cells[b]) / len(cells[a] | cells[b]), abs_tol=1e-12)
        span = {k: [(min(x), max(x)) for x in zip(*uv[k], strict=True)] for k in (a, b)}
        shared = math.prod(max(0, min(span[a][i][1], span[b][i][1]) - max(span[a][i][0], span[b][i][0])) for i in (0, 1))
        smaller = min(math.prod(hi - lo for lo, hi in span[k]) for k in (a, b))
        assert math.isclose(row["extent"], min(1, shared / smaller) if smaller else 0, abs_tol=1e-9)


def room(scan, walls):
    """Planes and points of a floor and walls (plane, degrees, start) that leave the corner at 0 in a direction."""
    planes, points = [(scan, scan * 100, 0.0, 1.0, 0.0, 0.0, 1.5, 0.0, 1.5, 0.0, 3.0, -0.01, 0.01, 0.0, 3.0, 9.0, 400.0, 0.004)], []
    points += [(scan, scan * 100, i / 20, 0.0, j / 20) for i in range(60) for j in range(60)]
    for plane, degrees, start in walls:
        d = (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
        n = (-d[1], 0.0, d[0])
        ends = [(start + (3 - start) * f) for f in (0, 1)]
        x, z = sorted(d[0] * e for e in ends), sorted(d[1] * e for e in ends)
        planes.append((scan, scan * 100 + plane, *n, 0.0, sum(x) / 2, 1.2, sum(z) / 2, *x, 0.0, 2.4, *z, 7.2, 300.0, 0.005))
        points += [(scan, scan * 100 + plane, d[0] * (start + i / 20), j / 20, d[1] * (start + i / 20)) for i in range(59) for j in range(49)]
    return planes, points


def test_rival_corners(spark):
    """Wall 1 stands; 2 and 3 leave its corner 24 degrees apart and both make triads with it: the better one stays. Without
    a rival both others stay, and a wall that repeats a direction is an alternate."""
    rooms = [room(1, [(1, 90, 0.0), (2, -12, 0.03), (3, 12, 0.03)]), room(2, [(1, 90, 0.0), (2, 3, 0.03)]), room(3, [(1, 90, 0.0), (2, 0, 0.0), (3, 8, 0.0)])]
    columns = "scan long, plane long, nx double, ny double, nz double, k double, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, area double, support double, rms double"
    planes = spark.createDataFrame([p for a, _ in rooms for p in a], columns)
    points = spark.createDataFrame([p for _, b in rooms for p in b], "scan long, plane long, x double, y double, z double")
    related = structure.relationships(planes, points)
    judged = structure.roles(structure.contexts(planes, related))
    edges = structure.graph_edges(planes, judged, related)
    walls, triads = sel.selected_walls(planes, structure.with_graph(judged, edges), related, edges, points)
    state = {r["plane"]: (r["state"], r["reason"]) for r in walls.collect()}
    found = {r["a"]: r for r in triads.collect()}
    assert found[102]["b"] == found[103]["b"] == 101 and found[102]["anchor"] == found[103]["anchor"] is not None and found[102]["corner"] is None
    wins = [p for p in (102, 103) if found[p]["selected"]]
    assert len(wins) == 1 and found[wins[0]]["score"] == max(found[p]["score"] for p in (102, 103))
    loser = ({102, 103} - set(wins)).pop()
    assert state[101][0] == state[wins[0]][0] == "selected" and state[wins[0]][1] == "triad" and state[loser] == ("alternate", "rival wall")
    assert state[201][0] == state[202][0] == "selected"
    assert sorted(state[p][0] for p in (301, 302, 303)) == ["alternate", "selected", "selected"] and "alternate" in (state[302][0], state[303][0])


def test_rival_pairs_equal_plain(spark):
    """Both kinds of rivals by the rules, on overlaps as measured."""
    rng = random.Random(12)
    planes, points = [], []
    for plane in range(7):  # near copies of two walls, so that some correspond
        base = (1.0, 0.0, 0.1 * plane) if plane % 2 else (0.08 * plane, 0.0, 1.0)
        size = math.sqrt(sum(x * x for x in base))
        n = [x / size for x in base]
        c = [rng.gauss(0, 0.15) for _ in range(3)]
        planes.append((0, plane, *n, sum(x * y for x, y in zip(n, c, strict=True)), *c))
        points += [(0, plane, c[0] + rng.uniform(-1, 1) * n[2], c[1] + rng.uniform(-1, 1), c[2] - rng.uniform(-1, 1) * n[0]) for _ in range(60)]
    triads = [(0, a, b, h, *(rng.gauss(0, 0.15) for _ in range(3))) if rng.random() < 0.9 else (0, a, b, h, None, None, None) for a in range(7) for b in range(7) for h in (50, 51) if a != b and rng.random() < 0.6]
    p = spark.createDataFrame(planes, "scan long, plane long, nx double, ny double, nz double, k double, cx double, cy double, cz double")
    q = spark.createDataFrame(points, "scan long, plane long, x double, y double, z double")
    t = spark.createDataFrame(triads, "scan long, a long, b long, h long, px double, py double, pz double")
    pairs = spark.createDataFrame([(0, a, b) for a in range(7) for b in range(7) if a != b], "scan long, p long, q long")
    over = {(r["p"], r["q"]): r.asDict() for r in sel.support_overlaps(pairs, p, q).collect()}
    clip = lambda x: max(0.0, min(1.0, x))

    def fit(o):
        return clip(clip(1 - o["angle"] / 30) * 0.25 + clip(1 - o["support"] / 0.5) * 0.2 + max(o["cells"], o["extent"]) * 0.3 + clip(1 - o["centroids"] / 0.9) * 0.15 + clip(1 - o["offset"] / 0.75) * 0.1)

    want = {}
    for f, s in itertools.product(triads, triads):
        (_, fa, fb, h, *fp), (_, sa, sb, g, *sp) = f, s
        shared = {fa, fb} & {sa, sb}
        if h != g or (fa, fb) >= (sa, sb) or len(shared) == 2:
            continue
        corners = None if None in (*fp, *sp) else math.dist(fp, sp)
        if shared:
            (x,), (y,) = {fa, fb} - shared, {sa, sb} - shared
            o = over[x, y]
            near = corners is not None and corners <= 0.45 and o["centroids"] <= 0.75
            want[h, fa, fb, sa, sb] = (shared.pop(), o["angle"] <= 30 and (o["cells"] >= 0.2 or o["extent"] >= 0.35 or near))
        else:
            ways = [[over[fa, sa], over[fb, sb]], [over[fa, sb], over[fb, sa]]]
            best = max(ways, key=lambda w: round(sum(map(fit, w)), 9))
            alike = all(o["angle"] <= 30 and (o["cells"] >= 0.12 or o["extent"] >= 0.25) and o["support"] <= 0.5 and o["centroids"] <= 0.9 for o in best)
            want[h, fa, fb, sa, sb] = (None, alike and corners is not None and corners <= 0.35)
    got = {(r["h"], r["fa"], r["fb"], r["sa"], r["sb"]): (r["anchor"], r["competing"]) for r in sel.rival_pairs(t, p, q).collect()}
    assert got == want
    assert {(a is None, c) for a, c in want.values()} == {(x, y) for x in (True, False) for y in (True, False)}
