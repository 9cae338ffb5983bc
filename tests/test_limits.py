"""Distances at a limit are the ones that SQL computes."""

import duckdb

from gridwise.operators import gates


def test_a_viewpoint_at_the_limit():
    a, b = (0.8955753946414917, 0.5, 0.8), (1.7730718333807038, 0.3, 0.8)
    pose = lambda p: dict(zip(("px", "py", "pz"), p, strict=True), yaw=0.0)
    walk = gates.Novelty(0.9, 400.0)
    got = [walk.step(pose(p))["novel"] for p in (a, b)]
    (want,) = duckdb.execute("SELECT sqrt((?::DOUBLE - ?::DOUBLE)**2 + (?::DOUBLE - ?::DOUBLE)**2 + (?::DOUBLE - ?::DOUBLE)**2) >= .9", [x for p in zip(b, a, strict=True) for x in p]).fetchone()
    assert got == [True, want] and want
