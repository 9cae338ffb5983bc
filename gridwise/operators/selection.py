"""Greedy selection of a scan's walls, and the competition of triads that propose the same corner.

Facts are joins: pairs of walls, triads of two walls with the chosen floor or ceiling, the overlap of two walls' supports.
What each choice leaves to choose is decided scan by scan, on lists of a scan's facts (as many as its planes, or pairs
of them, a scan having some dozens of planes); scans run in parallel. Ties go to the smaller plane.

Rounds: a seed (the best strong pair of walls, else the best strong wall on a floor or ceiling), growth along strong
edges, where a wall that only repeats a chosen direction becomes an alternate; then triads, one wall a round, each from
walls chosen so far; of triads that compete for one corner the best stays, and walls that only others proposed go; last
come walls that are strong enough alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions import vector as vm
from gridwise.functions.numeric import clamp
from gridwise.operators import structure
from gridwise.operators.graph import settled

#: Angles in degrees, lengths in metres, scores in [0, 1].
REDUNDANT_ANGLE, TRIAD_ANGLE, APART_ENVELOPE, LEAST_COHERENCE = 18.0, 45.0, 0.72, 0.62
#: A wall that is strong alone: confidence, upright, envelope, size, mass and extent at least, rms at most.
ALONE = {"confidence": 0.76, "upright": 0.82, "envelope": 0.68, "size": 0.58, "mass": 0.58, "extent": 0.48}
ALONE_RMS = 0.038
#: Rivals of one anchor: angle at most, shared cells or extent at least, or else corner and centroids this close.
RIVAL_ANGLE, RIVAL_CELLS, RIVAL_EXTENT, CELL, RIVAL_POINT, RIVAL_CENTROID = 30.0, 0.2, 0.35, 0.15, 0.45, 0.75
#: The same of two whole corners, whose walls also lie this close to the other's plane.
CORNER_POINT, CORNER_CELLS, CORNER_EXTENT, CORNER_SUPPORT, CORNER_CENTROID, CORNER_OFFSET = 0.35, 0.12, 0.25, 0.5, 0.9, 0.75
#: Weights of a triad's score: coherence; of either wall its quality, confidence, envelope, size and mass; line of the
#: walls, lines with the horizontal, fit, support of the point, determinant.
SCORE = {"coherence": 0.22, "quality": 0.08, "confidence": 0.05, "envelope": 0.06, "size": 0.04, "mass": 0.04, "ab": 0.07, "h": 0.05, "fit": 0.05, "around": 0.04, "det": 0.03}


# ---- facts ---------------------------------------------------------------------------------------


def nodes_of(final: DataFrame) -> DataFrame:
    """structure.with_graph() with quality, whether a plane is eligible, has evidence, and is strong alone."""
    c = F.col
    allowed = structure.eligible(final).select("scan", "plane", F.lit(True).alias("eligible"))
    alone = c("rms") <= ALONE_RMS
    for name, least in ALONE.items():
        alone &= c(name) >= least
    out = structure.node_quality(final).join(allowed, ["scan", "plane"], "left").fillna({"eligible": False})
    return out.withColumns({"evident": (c("relation") >= 0.32) | structure.large_wall(), "alone": (c("role") == "wall") & alone})


def horizontals(nodes: DataFrame) -> DataFrame:
    """(scan, plane, role): the best eligible floor and ceiling of each scan."""
    best = F.max_by("plane", F.struct(F.round("final", 9), -F.col("plane")))
    return nodes.filter("eligible and role in ('floor', 'ceiling')").groupBy("scan", "role").agg(best.alias("plane"))


def wall_pairs(nodes: DataFrame, related: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan, a, b) of walls with their angle, offset and gap, the kind and score of an edge that they share as walls, and
    the joint score of a strong edge of eligible ones."""
    walls = nodes.filter("role = 'wall'")
    side = lambda p: walls.select("scan", F.col("plane").alias(p), F.col("quality").alias(f"{p}_quality"), F.col("eligible").alias(f"{p}_eligible"))
    shared = edges.filter("kind in ('corner', 'parallel-boundary')").select("scan", "a", "b", F.col("kind").alias("edge"), "score", "strength")
    out = related.select("scan", "a", "b", "angle", "offset", "gap").join(side("a"), ["scan", "a"]).join(side("b"), ["scan", "b"]).join(shared, ["scan", "a", "b"], "left")
    core = F.when((F.col("strength") == "strong") & F.col("a_eligible") & F.col("b_eligible"), clamp(F.col("score") * F.sqrt(F.col("a_quality") * F.col("b_quality"))))
    return out.select("scan", "a", "b", "angle", "offset", "gap", "edge", F.round("score", 9).alias("score"), F.round(core, 9).alias("core"))


def horizontal_seed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan, seed): the wall of the best strong edge of an eligible wall with an eligible floor or ceiling."""
    good = nodes.filter("eligible")
    side = lambda p: good.select("scan", F.col("plane").alias(p), F.col("role").alias(f"{p}_role"), F.col("quality").alias(f"{p}_quality"))
    strong = edges.filter("kind = 'wall-horizontal' and strength = 'strong'").join(side("a"), ["scan", "a"]).join(side("b"), ["scan", "b"])
    joint = F.round(clamp(F.col("score") * F.sqrt(F.col("a_quality") * F.col("b_quality"))), 9)
    wall = F.when(F.col("a_role") == "wall", F.col("a")).otherwise(F.col("b"))
    return strong.groupBy("scan").agg(F.max_by(wall, F.struct(joint, F.round("score", 9), -F.col("a"), -F.col("b"))).alias("seed"))


def all_triads(planes: DataFrame, nodes: DataFrame, related: DataFrame, points: DataFrame) -> DataFrame:
    """Every (scan, a, b, h) of an eligible wall a, an eligible wall b at a wide angle and the chosen floor or ceiling, both
    supported on it: coherence, first gate that fails or none, point, and what a triad's score is made of."""
    walls = nodes.filter("role = 'wall' and eligible").select("scan", "plane")
    flat = horizontals(nodes).select("scan", "plane")
    few = nodes.join(walls.union(flat), ["scan", "plane"], "left_semi")
    return structure.triads(planes, few, related, points, walls)


def best_of_each(triads: DataFrame) -> DataFrame:
    """The most coherent triad of each wall a."""
    best = Window.partitionBy("scan", "a").orderBy(F.desc(F.round("coherence", 9)), "b", "h")
    return triads.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("scan").agg(F.collect_list(F.struct(*columns)).alias(name))


# ---- choice by choice ----------------------------------------------------------------------------


class _Walls:
    """A scan's walls and pairs of walls, and what is chosen of them."""

    def __init__(self, walls, pairs):
        self.wall = {w["plane"]: w for w in walls}
        self.pair = {(x, y): p for p in pairs for x, y in ((p["a"], p["b"]), (p["b"], p["a"]))}
        self.chosen: dict[int, str] = {}
        self.alternates: dict[int, str] = {}

    def angle(self, x: int, y: int) -> float:
        return self.pair[x, y]["angle"]

    def apart(self, x: int, chosen: int) -> bool:
        """x stands apart from a chosen wall in parallel, with evidence of its own."""
        p, w = self.pair[x, chosen], self.wall[x]
        return p["offset"] >= structure.LIMITS.apart_offset and p["gap"] >= structure.LIMITS.apart_gap and w["envelope"] >= APART_ENVELOPE and w["evident"]

    def repeats(self, x: int) -> bool:
        """The chosen wall closest in direction is as good as parallel, and x stands apart from none."""
        closest = min((self.angle(x, y) for y in self.chosen), default=None)
        return closest is not None and closest <= REDUNDANT_ANGLE and not any(self.apart(x, y) for y in self.chosen)

    def best_first(self, planes) -> list[int]:
        return sorted(planes, key=lambda x: (-self.wall[x]["final"], x))


def _grow(w: _Walls, seed: int | None) -> None:
    free = {x for x, row in w.wall.items() if row["eligible"]}
    cores = sorted((p for (x, y), p in w.pair.items() if x < y and p["core"] is not None), key=lambda p: (-p["core"], -p["score"], p["a"], p["b"]))
    if cores:
        w.chosen |= {x: f"core {cores[0]['edge']}" for x in (cores[0]["a"], cores[0]["b"])}
    elif seed is not None:
        w.chosen[seed] = "on a horizontal"
    while w.chosen:
        edges = [(max((w.pair[x, y] for y in w.chosen if w.pair[x, y]["edge"]), key=lambda p: p["score"], default=None), x) for x in free - w.chosen.keys() - w.alternates.keys()]
        strong = sorted((-p["score"], -w.wall[x]["final"], x, p["edge"]) for p, x in edges if p and p["score"] >= structure.LIMITS.strong_edge)
        if not strong:
            break
        *_, x, kind = strong[0]
        if w.repeats(x):
            w.alternates[x] = "repeats a direction"
        else:
            w.chosen[x] = kind
    if not w.chosen and free:
        w.chosen[w.best_first(free)[0]] = "best of all"


def _add_triads(w: _Walls, triads) -> list[dict]:
    """The triads accepted, one a round: of each wall that is not chosen its most coherent triad with a chosen one, then
    the most coherent of those that pass all gates."""
    order = sorted(triads, key=lambda t: (-t["coherence"], t["b"], t["h"]))
    accepted = []
    while True:
        best = {}
        for t in order:
            if t["a"] not in w.chosen and t["b"] in w.chosen:
                best.setdefault(t["a"], t)
        passing = [t for x, t in best.items() if t["failed"] == "none" and not any(w.angle(x, y) <= REDUNDANT_ANGLE and not w.apart(x, y) for y in w.chosen)]
        if not passing:
            return accepted
        t = min(passing, key=lambda t: (-t["coherence"], t["a"]))
        accepted.append(t)
        w.chosen[t["a"]] = "triad"


def _state(w: _Walls) -> tuple[list[dict], list[dict]]:
    return tuple([{"plane": x, "reason": r} for x, r in rows.items()] for rows in (w.chosen, w.alternates))


def _first_rounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for scan, walls, pairs, triads, seed in zip(pdf["scan"], pdf["walls"], pdf["pairs"], pdf["triads"], pdf["seed"], strict=True):
            w = _Walls(walls, [] if pairs is None else pairs)
            _grow(w, None if pd.isna(seed) else int(seed))
            accepted = _add_triads(w, [] if triads is None else triads)
            chosen, alternates = _state(w)
            out.append((scan, chosen, alternates, [{"a": t["a"], "b": t["b"], "h": t["h"], "place": i} for i, t in enumerate(accepted)]))
        yield pd.DataFrame(out, columns=["scan", "chosen", "alternates", "accepted"])


_STATE = "array<struct<plane: long, reason: string>>"


def first_rounds(nodes: DataFrame, pairs: DataFrame, edges: DataFrame, triads: DataFrame | None) -> DataFrame:
    """A row a scan: chosen and alternate walls after growth and triads, in order, and the triads accepted."""
    walls = nodes.filter("role = 'wall'").withColumn("final", F.round("final", 9))
    rows = _listed(walls, "walls", "plane", "final", "envelope", "evident", "eligible")
    rows = rows.join(_listed(pairs, "pairs", "a", "b", "angle", "offset", "gap", "edge", "score", "core"), "scan", "left")
    if triads is None:
        rows = rows.withColumn("triads", F.lit(None).cast("array<struct<a: long, b: long, h: long, coherence: double, failed: string>>"))
    else:
        rows = rows.join(_listed(triads.withColumn("coherence", F.round("coherence", 9)), "triads", "a", "b", "h", "coherence", "failed"), "scan", "left")
    rows = rows.join(horizontal_seed(nodes, edges), "scan", "left").select("scan", "walls", "pairs", "triads", "seed")
    return rows.mapInPandas(_first_rounds, f"scan long, chosen {_STATE}, alternates {_STATE}, accepted array<struct<a: long, b: long, h: long, place: int>>")


# ---- competition ---------------------------------------------------------------------------------


def support_overlaps(pairs: DataFrame, planes: DataFrame, points: DataFrame) -> DataFrame:
    """For (scan, p, q) of walls, on p's tangents: the shared part of both supports' cells and of the smaller extent, the
    distance of the centroids, and how far either support's median point lies from the other plane."""
    c = F.col
    side = lambda p: planes.select("scan", c("plane").alias(p), *(c(x).alias(f"{p}_{x}") for x in ("nx", "ny", "nz", "k", "cx", "cy", "cz")))
    both = pairs.select("scan", "p", "q").distinct().join(side("p"), ["scan", "p"]).join(side("q"), ["scan", "q"])
    dot = vm.dot(vm.v("p_n"), vm.v("q_n"))
    both = settled(both.withColumn("angle", F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot))))).withColumn("offset", F.abs(c("p_k") - F.when(dot < 0, -c("q_k")).otherwise(c("q_k")))))
    ends = both.withColumn("plane", F.explode(F.array("p", "q"))).join(points.select("scan", "plane", "x", "y", "z"), ["scan", "plane"])
    t, s = vm.tangent_basis(vm.v("p_n"))
    u, v = vm.to_local(vm.v(), vm.v("p_c"), t, s)
    far = F.abs(F.when(c("plane") == c("p"), vm.plane_residual(vm.v(), vm.v("q_n"), c("q_k"))).otherwise(vm.plane_residual(vm.v(), vm.v("p_n"), c("p_k"))))
    ends = settled(ends.select("scan", "p", "q", (c("plane") == c("p")).alias("first"), "x", "y", "z", u.alias("u"), v.alias("v"), far.alias("far")))
    key = ["scan", "p", "q"]
    cells = ends.groupBy(*key, F.floor(c("u") / CELL).alias("i"), F.floor(c("v") / CELL).alias("j")).agg(F.count_distinct("first").alias("sides"))
    cells = cells.groupBy(*key).agg((F.count_if(c("sides") == 2) / F.count("*")).alias("cells"))
    one = ends.groupBy(*key, "first").agg(*(f(x).alias(f"{n}_{x}") for x in "uv" for n, f in (("lo", F.min), ("hi", F.max))), *(F.avg(x).alias(f"m{x}") for x in "xyz"), F.median("far").alias("far"))
    names = [x for x in one.columns if x not in (*key, "first")]
    of = lambda x, first: F.max(F.when(c("first") == first, c(x)))
    one = one.groupBy(*key).agg(*(of(x, f).alias(f"{'a' if f else 'b'}_{x}") for x in names for f in (True, False)))
    shared = [F.greatest(F.lit(0.0), F.least(f"a_hi_{x}", f"b_hi_{x}") - F.greatest(f"a_lo_{x}", f"b_lo_{x}")) for x in "uv"]
    area = lambda p: (c(f"{p}_hi_u") - c(f"{p}_lo_u")) * (c(f"{p}_hi_v") - c(f"{p}_lo_v"))
    smaller = F.least(area("a"), area("b"))
    met = c("a_far").isNotNull() & c("b_far").isNotNull()
    out = both.select(*key, "angle", "offset").join(cells, key, "left").join(one, key, "left")
    return out.select(
        *key, "angle", "offset", F.coalesce("cells", F.lit(0.0)).alias("cells"), F.when(met & (smaller > 0), clamp(shared[0] * shared[1] / smaller)).otherwise(0.0).alias("extent"),
        F.when(met, vm.distance(vm.v("a_m"), vm.v("b_m"))).alias("centroids"), F.when(met, F.greatest("a_far", "b_far")).alias("support"),
    )


def triad_scores(triads: DataFrame, nodes: DataFrame) -> DataFrame:
    """triads with the score by which they compete."""
    c = F.col
    side = lambda p: nodes.select("scan", c("plane").alias(p), *(c(x).alias(f"{p}_{x}") for x in ("confidence", "envelope", "size", "mass", "rms")))
    out = triads.join(side("a"), ["scan", "a"]).join(side("b"), ["scan", "b"])
    total = c("coherence") * SCORE["coherence"] + c("ab") * SCORE["ab"] + (c("ah") + c("bh")) / 2 * SCORE["h"] + c("around") * SCORE["around"] + clamp(F.abs("det")) * SCORE["det"]
    for p in "ab":
        fit = 1 - clamp(c(f"{p}_rms") / structure.LIMITS.worst_rms)
        total += sum((c(f"{p}_{x}") * SCORE[x] for x in ("quality", "confidence", "envelope", "size", "mass")), fit / 2 * SCORE["fit"])
    return out.withColumn("score", F.round(clamp(total), 9))


def _compatible() -> Column:
    """How well two walls of different corners correspond."""
    c, at_most = F.col, lambda x, most: F.coalesce(clamp(1 - F.col(x) / most), F.lit(0.0))
    return clamp(at_most("angle", RIVAL_ANGLE) * 0.25 + at_most("support", CORNER_SUPPORT) * 0.2 + F.greatest(c("cells"), c("extent")) * 0.3 + at_most("centroids", CORNER_CENTROID) * 0.15 + at_most("offset", CORNER_OFFSET) * 0.1)


def rival_pairs(triads: DataFrame, planes: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of triads of one horizontal, the first before the second by (a, b, h), that share a wall (anchor) or none
    (anchor null): whether they compete."""
    c = F.col
    side = lambda p: triads.select("scan", "h", *(c(x).alias(f"{p}{x}") for x in ("a", "b", "px", "py", "pz")))
    pairs = side("f").join(side("s"), ["scan", "h"]).filter(F.struct("fa", "fb") < F.struct("sa", "sb"))
    held = {x: (c(x) == c("sa")) | (c(x) == c("sb")) for x in ("fa", "fb")}
    pairs = pairs.withColumn("anchor", F.when(held["fa"], c("fa")).when(held["fb"], c("fb"))).filter(~(held["fa"] & held["fb"]))
    other = lambda p: F.when(c(f"{p}a") == c("anchor"), c(f"{p}b")).otherwise(c(f"{p}a"))
    key = ["scan", "h", "fa", "fb", "sa", "sb"]
    points_apart = vm.distance(vm.v("fp"), vm.v("sp"))
    pairs = settled(pairs.select(*key, "anchor", points_apart.alias("corners"), other("f").alias("x"), other("s").alias("y")))

    one = pairs.filter("anchor is not null").select(*key, "anchor", "corners", c("x").alias("p"), c("y").alias("q"), F.lit(0).alias("way"))
    ways = F.array(*(F.struct(F.lit(w).alias("way"), c(p).alias("p"), c(q).alias("q")) for w, p, q in ((0, "fa", "sa"), (0, "fb", "sb"), (1, "fa", "sb"), (1, "fb", "sa"))))
    two = pairs.filter("anchor is null").select(*key, "anchor", "corners", F.explode(ways).alias("w")).select(*key, "anchor", "corners", "w.p", "w.q", "w.way")
    met = settled(one.unionByName(two))
    met = met.join(support_overlaps(met, planes, points), ["scan", "p", "q"])

    near = F.coalesce((c("corners") <= RIVAL_POINT) & (c("centroids") <= RIVAL_CENTROID), F.lit(False))
    anchored = met.filter("anchor is not null").select(*key, "anchor", "corners", ((c("angle") <= RIVAL_ANGLE) & ((c("cells") >= RIVAL_CELLS) | (c("extent") >= RIVAL_EXTENT) | near)).alias("competing"))
    alike = (c("angle") <= RIVAL_ANGLE) & ((c("cells") >= CORNER_CELLS) | (c("extent") >= CORNER_EXTENT)) & F.coalesce((c("support") <= CORNER_SUPPORT) & (c("centroids") <= CORNER_CENTROID), F.lit(False))
    whole = met.filter("anchor is null").withColumn("fit", _compatible()).groupBy(*key, "corners", "way").agg(F.sum("fit").alias("fit"), F.bool_and(alike).alias("alike"))
    whole = whole.groupBy(*key, "corners").agg(F.max_by("alike", F.struct(F.round("fit", 9), -c("way"))).alias("alike"))
    whole = whole.select(*key, F.lit(None).cast("long").alias("anchor"), "corners", (c("alike") & F.coalesce(c("corners") <= CORNER_POINT, F.lit(False))).alias("competing"))
    return anchored.unionByName(whole)


def constrained_components(edges: DataFrame) -> DataFrame:
    """(scan, kind, id, component) of the ends of edges(scan, kind, place, a, b, key), which join in the order of place
    where no side belongs to another key already; a component has the key of its first edge and the name of the end that
    began it. Labels can't spread: whether an edge joins depends on all before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, key = {}, {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for a, b, k in pdf.sort_values("place")[["a", "b", "key"]].itertuples(index=False):
            a, b = top(a), top(b)
            if a != b and key.get(a, k) == k and key.get(b, k) == k:
                root[b], key[a] = a, k
        ids = list(root)
        return pd.DataFrame({"scan": pdf["scan"].iloc[0], "kind": pdf["kind"].iloc[0], "id": ids, "component": [top(x) for x in ids]})

    kind = dict(edges.dtypes)
    return edges.groupBy("scan", "kind").applyInPandas(run, f"scan {kind['scan']}, kind {kind['kind']}, id {kind['a']}, component {kind['a']}")


def competition(triads: DataFrame, nodes: DataFrame, planes: DataFrame, points: DataFrame) -> DataFrame:
    """Accepted triads (scan, a, b, h) with their score, the groups in which they compete (by anchor, by whole corner;
    null if alone), and whether they win a group or have none."""
    c = F.col
    names = F.concat_ws("/", *(F.format_string("%020d", c(x).cast("long")) for x in "abh"))  # ordered like (a, b, h)
    scored = settled(triad_scores(triads, nodes).withColumn("id", names))
    rivals = rival_pairs(scored, planes, points).filter("competing")
    name = lambda p: F.concat_ws("/", *(F.format_string("%020d", c(x).cast("long")) for x in (f"{p}a", f"{p}b", "h")))
    edges = rivals.select("scan", F.when(c("anchor").isNull(), "corner").otherwise("anchor").alias("kind"), name("f").alias("a"), name("s").alias("b"), F.concat_ws("/", F.coalesce(c("anchor").cast("string"), F.lit("")), c("h").cast("string")).alias("key"))
    joined = constrained_components(edges.withColumn("place", F.concat_ws("|", "a", "b")))
    groups = settled(joined.join(scored.select("scan", "id", "score"), ["scan", "id"]))
    first = Window.partitionBy("scan", "kind", "component").orderBy(F.desc("score"), "id")
    groups = groups.withColumn("wins", F.row_number().over(first) == 1).withColumn("of", F.count("*").over(Window.partitionBy("scan", "kind", "component"))).filter("of > 1")
    by = groups.groupBy("scan", "id").agg(*(F.max(F.when(c("kind") == k, c("component"))).alias(k) for k in ("anchor", "corner")), F.bool_or("wins").alias("wins"))
    return scored.join(by, ["scan", "id"], "left").withColumn("selected", F.coalesce("wins", F.lit(True))).drop("wins")


# ---- the last rounds -----------------------------------------------------------------------------


def _suppress(w: _Walls, triads: list) -> None:
    of = {x: [t for t in triads if x in (t["a"], t["b"])] for t in triads for x in (t["a"], t["b"])}
    kept = {x for t in triads if t["selected"] for x in (t["a"], t["b"])}
    rivals = {x for t in triads if t["corner"] is not None for x in (t["a"], t["b"])}
    added = {t["a"] for t in triads}
    for t in triads:
        if t["selected"]:
            continue
        whole = t["corner"] is not None
        for x in (t["a"], t["b"]) if whole else (t["a"],):
            others = [y for y in w.chosen if y != x and y not in rivals]
            needed = any(w.pair[x, y]["core"] is not None or w.apart(x, y) for y in others)
            goes = not any(o["selected"] for o in of[x]) if whole else x in added
            if goes and not needed and x not in kept and x in w.chosen:
                del w.chosen[x]
                w.alternates[x] = "rival corner" if whole else "rival wall"


def _add_alone(w: _Walls) -> None:
    for x in w.best_first(x for x, row in w.wall.items() if row["alone"] and x not in w.chosen and x not in w.alternates):
        if w.repeats(x):
            w.alternates[x] = "strong, repeats a direction"
        else:
            w.chosen[x] = "strong alone"


def _last_rounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for scan, walls, pairs, chosen, alternates, triads in zip(*(pdf[x] for x in ("scan", "walls", "pairs", "chosen", "alternates", "triads")), strict=True):
            w = _Walls(walls, [] if pairs is None else pairs)
            w.chosen, w.alternates = ({x["plane"]: x["reason"] for x in rows} for rows in (chosen, alternates))
            _suppress(w, sorted([] if triads is None else triads, key=lambda t: t["place"]))
            _add_alone(w)
            out += [(scan, x, state, n, reason) for state, rows in (("selected", w.chosen), ("alternate", w.alternates)) for n, (x, reason) in enumerate(rows.items())]
        yield pd.DataFrame(out, columns=["scan", "plane", "state", "place", "reason"])


def selected_walls(planes: DataFrame, final: DataFrame, related: DataFrame, edges: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walls, triads): each wall with its state (selected, alternate, other), place and reason, and its final score with
    the coherence of its triads; and the accepted triads with their competition."""
    nodes = settled(nodes_of(final))
    pairs = settled(wall_pairs(nodes, related, edges))
    triads = settled(all_triads(planes, nodes, related, points))
    first = settled(first_rounds(nodes, pairs, edges, triads))
    accepted = first.select("scan", F.explode("accepted").alias("t")).select("scan", "t.*").join(triads, ["scan", "a", "b", "h"])
    judged = settled(competition(accepted, nodes, planes, points))
    rows = _listed(nodes.filter("role = 'wall'").withColumn("final", F.round("final", 9)), "walls", "plane", "final", "envelope", "evident", "alone")
    rows = rows.join(_listed(pairs, "pairs", "a", "b", "angle", "offset", "gap", "core"), "scan", "left").join(first.select("scan", "chosen", "alternates"), "scan")
    rows = rows.join(_listed(judged, "triads", "a", "b", "place", "corner", "selected"), "scan", "left")
    state = rows.mapInPandas(_last_rounds, "scan long, plane long, state string, place int, reason string")
    coherent = judged.groupBy("scan", F.col("a").alias("plane")).agg(F.max("coherence").alias("coherence"))
    walls = nodes.filter("role = 'wall'").select("scan", "plane", "final").join(state, ["scan", "plane"], "left").join(coherent, ["scan", "plane"], "left")
    final_score = F.when(F.col("coherence") > 0, clamp(F.col("final") * 0.8 + F.col("coherence") * 0.2)).otherwise(F.col("final"))
    return walls.select("scan", "plane", F.coalesce("state", F.lit("other")).alias("state"), "place", "reason", final_score.alias("final")), judged
