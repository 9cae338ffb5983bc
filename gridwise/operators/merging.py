"""Agglomerative merging of a scan's planes: layers of one surface into families, families into consensus surfaces.

Supports are read once: for planes that chains of similar ones connect, the cells and ranges of each one's points on each
other's tangents. A cluster's cells on any member are the union of its members' cells there, so that merging needs no
point again. In each of at most PASSES passes the first compatible pair of clusters, in order, becomes one; that order is
part of the rule, so a scan's clusters (as many as its planes at most) are merged one after another, scans in parallel.

A plane without points has no cells and overlaps nothing. Ties of representatives go to the earlier member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridwise.functions import vector as vm
from gridwise.operators.graph import components, settled

PASSES, CELL = 8, 0.1
#: Layers of a family: degrees, offset, thickness, shared part of the smaller support, or else axis overlap and gap.
FAMILY_ANGLE, FAMILY_OFFSET, FAMILY_THICKNESS, FAMILY_OVERLAP, ADJACENT_OVERLAP, ADJACENT_GAP = 7.0, 0.1, 0.22, 0.35, 0.05, 0.3
#: Families of a surface: degrees, offset, thickness, shared part of both supports, of each, and of their areas.
SURFACE_ANGLE, SURFACE_OFFSET, SURFACE_THICKNESS, SURFACE_IOU, SURFACE_COVERAGE, SURFACE_AREA = 8.0, 0.16, 0.32, 0.35, 0.55, 0.4


def projections(planes: DataFrame, points: DataFrame) -> DataFrame:
    """(scan, r, m, cells, u0, u1, v0, v1): plane m's points on r's tangents, for planes that chains of pairs connect which
    could be of one surface."""
    c = F.col
    side = lambda p: planes.select("scan", c("plane").alias(p), *(c(x).alias(f"{p}_{x}") for x in ("nx", "ny", "nz", "k")))
    dot = vm.dot(vm.v("a_n"), vm.v("b_n"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot))))
    offset = F.abs(c("a_k") - F.when(dot < 0, -c("b_k")).otherwise(c("b_k")))
    similar = side("a").join(side("b"), "scan").filter("a < b").filter((angle <= max(FAMILY_ANGLE, SURFACE_ANGLE)) & (offset <= max(FAMILY_OFFSET, SURFACE_OFFSET)))
    group = settled(components(planes.select(c("plane").alias("id")), similar.select("a", "b")).join(planes.select("scan", c("plane").alias("id")), "id"))
    pairs = group.select("scan", "component", c("id").alias("r")).join(group.select("scan", "component", c("id").alias("plane")), ["scan", "component"])
    on = planes.select("scan", c("plane").alias("r"), *(c(x) for x in ("nx", "ny", "nz", "cx", "cy", "cz")))
    there = pairs.join(on, ["scan", "r"]).join(points.select("scan", "plane", "x", "y", "z"), ["scan", "plane"])
    u, v = vm.to_local(vm.v(), vm.v("c"), *vm.tangent_basis(vm.v("n")))
    there = there.select("scan", "r", c("plane").alias("m"), u.alias("u"), v.alias("v"))
    cell = F.shiftleft(F.floor(c("u") / CELL), 32) + F.floor(c("v") / CELL)
    return there.groupBy("scan", "r", "m").agg(F.collect_set(cell).alias("cells"), *(f(x).alias(f"{x}{n}") for x in "uv" for n, f in ((0, F.min), (1, F.max))))


class _Scan:
    """A scan's planes, their projections, and the rules of both merges."""

    def __init__(self, planes, projected):
        self.plane = {p["plane"]: p for p in planes}
        self.on = {(x["r"], x["m"]): x for x in projected}
        self.sets = {key: frozenset(map(int, x["cells"])) for key, x in self.on.items()}

    def dot(self, a: int, b: int) -> float:
        p, q = self.plane[a], self.plane[b]
        return p["nx"] * q["nx"] + p["ny"] * q["ny"] + p["nz"] * q["nz"]

    def angle(self, a: int, b: int) -> float:
        return math.degrees(math.acos(min(1.0, abs(self.dot(a, b)))))

    def aligned(self, plane: int, reference: int) -> float:
        return self.plane[plane]["k"] * (-1 if self.dot(plane, reference) < 0 else 1)

    def apart(self, a: int, b: int) -> float:
        return abs(self.plane[a]["k"] - self.aligned(b, a))

    def cells(self, reference: int, members: list[int]) -> frozenset:
        return frozenset().union(*(self.sets.get((reference, m), ()) for m in members))

    def representative(self, members: list[dict], sure: float) -> int:
        """The place of the member that agrees best with the others, by their support."""
        def score(i: int) -> float:
            own, others = members[i], members[:i] + members[i + 1 :]
            weights = [max(1, o["owned"]) for o in others]
            off = sum(w * (self.apart(own["plane"], o["plane"]) + math.radians(self.angle(own["plane"], o["plane"])) * 0.05) for w, o in zip(weights, others, strict=True))
            p = self.plane[own["plane"]]
            return (off / sum(weights) if weights else 0.0) + p["rms"] * 0.1 - own["owned"] * 1e-5 - p["confidence"] * sure

        return min(range(len(members)), key=score)

    def merged(self, clusters: list[dict], compatible, sure: float) -> list[dict]:
        """clusters after at most PASSES merges, each of the first compatible pair."""
        for _ in range(PASSES):
            pair = next(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)) if compatible(clusters[i], clusters[j])), None)
            if pair is None:
                break
            i, j = pair
            members = clusters[i]["members"] + clusters[j]["members"]
            clusters[i] = {"members": members, "of": members[self.representative(members, sure)], "planes": clusters[i]["planes"] + clusters[j]["planes"]}
            del clusters[j]
        return clusters

    def layers(self, a: int, b: int) -> bool:
        """Two planes may be layers of one family."""
        if self.angle(a, b) > FAMILY_ANGLE or self.apart(a, b) > FAMILY_OFFSET:
            return False
        p, q = self.on.get((a, a)), self.on.get((a, b))
        if p is None or q is None:
            return False
        shared = len(self.sets[a, a] & self.sets[a, b])
        if shared / min(len(self.sets[a, a]), len(self.sets[a, b])) >= FAMILY_OVERLAP:
            return True
        both, gaps = [], []
        for x in "uv":
            lo, hi = max(p[x + "0"], q[x + "0"]), min(p[x + "1"], q[x + "1"])
            span = min(p[x + "1"] - p[x + "0"], q[x + "1"] - q[x + "0"])
            both.append(max(0.0, hi - lo) / span if span > 0 else 0.0)
            gaps.append(max(0.0, lo - hi))
        return max(both) >= ADJACENT_OVERLAP and max(gaps) <= ADJACENT_GAP

    def one_family(self, a: dict, b: dict) -> bool:
        offsets = [self.aligned(m["plane"], a["of"]["plane"]) for m in a["members"] + b["members"]]
        return max(offsets) - min(offsets) <= FAMILY_THICKNESS and any(self.layers(m["plane"], n["plane"]) for m in a["members"] for n in b["members"])

    def offsets(self, cluster: dict, reference: int) -> list[float]:
        out = []
        for m in cluster["members"]:
            sign = -1 if self.dot(reference, m["plane"]) < 0 else 1
            out += [m["low"] * sign, m["high"] * sign]
        return out

    def one_surface(self, a: dict, b: dict) -> bool:
        r, s = a["of"]["plane"], b["of"]["plane"]
        if self.angle(r, s) > SURFACE_ANGLE or all(self.apart(m["plane"], n["plane"]) > SURFACE_OFFSET for m in a["members"] for n in b["members"]):
            return False
        offsets = self.offsets(a, r) + self.offsets(b, r)
        if max(offsets) - min(offsets) > SURFACE_THICKNESS:
            return False
        first, second = self.cells(r, a["planes"]), self.cells(r, b["planes"])
        if not first or not second:
            return False
        shared = len(first & second)
        return (
            shared / len(first | second) >= SURFACE_IOU and min(shared / len(first), shared / len(second)) >= SURFACE_COVERAGE
            and min(len(first), len(second)) / max(len(first), len(second)) >= SURFACE_AREA
        )

    def families(self) -> list[dict]:
        single = [{"plane": p, "owned": row["n"]} for p, row in sorted(self.plane.items())]
        found = self.merged([{"members": [m], "of": m, "planes": [m["plane"]]} for m in single], self.one_family, 0.0)
        for f in found:
            offsets = [self.aligned(m["plane"], f["of"]["plane"]) for m in f["members"]]
            f |= {"low": min(offsets), "high": max(offsets)}
        return found

    def surfaces(self, families: list[dict]) -> list[dict]:
        members = [{"plane": f["of"]["plane"], "owned": sum(m["owned"] for m in f["members"]), "low": f["low"], "high": f["high"], "planes": f["planes"]} for f in families]
        return self.merged([{"members": [m], "of": m, "planes": m["planes"]} for m in members], self.one_surface, 0.001)


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for scan, planes, projected in zip(pdf["scan"], pdf["planes"], pdf["projected"], strict=True):
            s = _Scan(planes, [] if projected is None else projected)
            families = s.families()
            of = {p: (i, f["of"]["plane"], f["high"] - f["low"]) for i, f in enumerate(families, 1) for p in f["planes"]}
            for i, surface in enumerate(s.surfaces(families), 1):
                offsets, best = s.offsets(surface, surface["of"]["plane"]), surface["of"]["plane"]
                area = len(s.cells(best, surface["planes"])) * CELL**2
                out += [(scan, p, *of[p], i, best, max(offsets) - min(offsets), area) for p in surface["planes"]]
        yield pd.DataFrame(out, columns=["scan", "plane", "family", "family_plane", "family_thickness", "surface", "surface_plane", "surface_thickness", "area"])


def merged_planes(planes: DataFrame, points: DataFrame) -> DataFrame:
    """Each of planes(scan, plane, normal, k, centroid, rms, confidence) with its family and its consensus surface: number in
    the scan, the plane that represents it, thickness, and the surface's occupied area. Plane ids are one space."""
    n = points.groupBy("scan", "plane").agg(F.count("*").alias("n"))
    listed = planes.join(n, ["scan", "plane"], "left").fillna({"n": 0}).groupBy("scan").agg(F.collect_list(F.struct("plane", "nx", "ny", "nz", "k", "rms", "confidence", "n")).alias("planes"))
    on = projections(planes, points).groupBy("scan").agg(F.collect_list(F.struct("r", "m", "cells", "u0", "u1", "v0", "v1")).alias("projected"))
    schema = "scan long, plane long, family int, family_plane long, family_thickness double, surface int, surface_plane long, surface_thickness double, area double"
    return listed.join(on, "scan", "left").select("scan", "planes", "projected").mapInPandas(_merge, schema)
