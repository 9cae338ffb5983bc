"""Weights, categories, guidance, gates and scores: row rules as Column expressions.

The numbers in this module are fixed values of the workload.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridwise.functions.numeric import c, clamp


def coverage_state(observations) -> Column:
    n = c(observations)
    return F.when(n >= 3, "captured").when(n >= 2, "partial").otherwise("observed")


def quality_weight(state, observations) -> Column:
    s = c(state)
    return F.when(s == "captured", 3.0).when(s == "partial", 2.0).otherwise(1.0) * clamp(observations, 1.0, 3.0)


def fused_weight(state, confidence, weight) -> Column:
    s = c(state)
    return F.when(s == "captured", 1.25).when(s == "partial", 1.1).otherwise(1.0) * (clamp(confidence) + 1) * clamp(weight, 1.0, 3.0)


def orientation(angle_degrees) -> Column:
    a = c(angle_degrees)
    return F.when(a <= 20, "horizontal-like").when(a >= 70, "vertical-like").otherwise("other")


def view_guidance(coverage_percent) -> Column:
    p = c(coverage_percent)
    return F.when(p.isNull(), "none").when(p < 35, "keep-scanning").when(p < 75, "scan-from-side").otherwise("move-on")


def capture_guidance(valid: Column, accepted: Column, total: Column, captured: Column, tracking: Column, advice: Column, view: Column) -> tuple[Column, Column]:
    """What to do next, and the warnings that hold, for a row of capture totals."""
    healthy = valid == "healthy"
    message = (
        F.when(valid == "invalid", "restart")
        .when((tracking != "active") | ~healthy, "hold-still")
        .when(advice == "move-slower", "slow-down")
        .when(advice == "scan-again", "revisit")
        .when(view >= 80, "move-to-unmarked")
        .when(total > 0, "move-sideways")
        .otherwise("sweep")
    )
    missing = F.greatest(F.lit(0), total - F.greatest(F.lit(0), F.least(total, captured)))
    warnings = F.array_compact(F.array(F.when(~healthy, "tracking"), F.when(total == 0, "no-coverage"), F.when(missing > 0, "needs-angles"), F.when(accepted < 24, "few-frames")))
    return message, warnings


def appearance_decision(queued, since_ms, interval_ms, processing_ms) -> Column:
    """Whether a photo may be taken, and why."""
    queued, since, interval, work = map(c, (queued, since_ms, interval_ms, processing_ms))
    return (
        F.when(queued > 0, "queue-pressure")
        .when((since >= 4000) & (interval < 80) & (work < 65), "reserved-appearance-opportunity")
        .when(interval >= 48, "xr-timing-pressure")
        .when(work >= 42, "processing-pressure")
        .otherwise("stable-opportunity")
    )


def movement(yaw, forward, strafe, speed, seconds) -> tuple[Column, Column]:
    """x and z of a walking step; at most a tenth of a second, at most full speed."""
    yaw, forward, strafe, speed = map(c, (yaw, forward, strafe, speed))
    size = F.sqrt(forward * forward + strafe * strafe)
    k = F.when(size <= 2.220446049250313e-16, 0.0).otherwise(speed * clamp(seconds, 0.0, 0.1) * F.least(F.lit(1.0), size) / size)
    return (F.sin(yaw) * forward + F.cos(yaw) * strafe) * k, (-F.cos(yaw) * forward + F.sin(yaw) * strafe) * k


def footprint_alpha(x, y, rounding=0.35, core=0.72, start=0.72, end=1.0, least=0.02) -> Column:
    """Opacity of a cell's footprint: full in the core, a smooth edge, nothing below least."""
    ax, ay = F.abs(c(x)), F.abs(c(y))
    d = F.greatest(ax, ay) + F.least(ax, ay) * rounding
    t = clamp((d - start) / (end - start))
    a = F.lit(1.0) - t * t * (F.lit(3.0) - t * 2)
    return F.when(d <= core, 1.0).when(a < least, 0.0).otherwise(a)


def visual_radius(radius, spacing, scale=1.0, low=0.004, high=0.04, minor=0.8, margin=1.1, most=1.8) -> Column:
    """A splat's radius, widened towards its nearest neighbour."""
    base = clamp(F.greatest(F.lit(1e-6), c(radius)) * scale, low, high)
    wide = F.least(F.lit(high), base * most, c(spacing) / (2 * minor) * margin)
    return clamp(F.when(c(spacing).isNull(), base).otherwise(F.greatest(base, wide)), low, high)


def tracking_quality(velocity, angular) -> Column:
    return F.greatest(F.lit(0.5), F.lit(1.0) - F.least(F.lit(1.0), c(velocity) / 3) * 0.3 - F.least(F.lit(1.0), c(angular) / 240) * 0.2)


def sudden(translation, velocity, rotation, angular, dt, gap=False) -> Column:
    """A pose that cannot follow the one before: a jump ('pose-discontinuity'), else too fast a motion, else none."""
    t, v, r, w, dt = map(c, (translation, velocity, rotation, angular, dt))
    jump = (dt < 0.75) & (((t > 0.45) & (v > 1)) | ((r > 75) & (w > 180)))
    jump = jump | (c(gap) & ((t > 0.45) | (r > 75)))
    fast = (dt < 0.5) & (((t > 0.35) & (v > 2.8)) | ((r > 48) & (w > 220)))
    return F.when(jump, "pose-discontinuity").when(fast, "motion").otherwise("none")


def stable(seen, span_ms, tracking, position_variance, depth_variance, duplicate, views) -> Column:
    """Enough agreeing observations of a sample."""
    return (
        (c(seen) >= 3) & (c(span_ms) >= 250) & (F.coalesce(c(tracking), F.lit(1.0)) >= 0.55)
        & (F.sqrt(F.coalesce(c(position_variance), F.lit(0.0))) <= 0.02) & (F.sqrt(F.coalesce(c(depth_variance), F.lit(0.0))) <= 0.016)
        & (~c(duplicate) | (c(views) >= 2))
    )


# Scores.


def canonical_confidence(seen, views, tracking) -> Column:
    return clamp(F.least(F.lit(1.0), c(seen) / 6) * 0.3 + F.least(F.lit(1.0), c(views) / 2) * 0.2 + c(tracking) * 0.15 + 0.35)


def dense_confidence(seen, views, tracking, span_ms) -> Column:
    return clamp(c(seen) / 5 * 0.45 + F.least(F.lit(2.0), c(views)) / 2 * 0.25 + c(tracking) * 0.2 + F.least(F.lit(2000.0), c(span_ms)) / 2000 * 0.1)


def keyframe_quality(valid, translation, rotation) -> Column:
    one = lambda x: F.least(F.lit(1.0), x)
    return one(c(valid) / 3600) * 0.55 + one(c(translation) / 0.45) * 0.25 + one(c(rotation) / 35) * 0.2


def plane_confidence(points, area, rms) -> Column:
    return clamp(clamp(c(points) / 48) * 0.45 + clamp(c(area)) * 0.35 + (F.lit(1.0) - clamp(c(rms) / 0.035)) * 0.2)


def retention_value(unique_cells, unique_viewpoint, gap_ms) -> Column:
    return c(unique_cells) * 100 + F.when(c(unique_viewpoint), 20).otherwise(0) + F.least(F.lit(20.0), c(gap_ms) / 100)


def view_rank(quality, valid, incidence, distance, scale_difference) -> Column:
    return c(quality) * 0.45 + c(valid) * 0.2 + c(incidence) * 0.2 + F.lit(0.1) / (c(distance) + 1) + F.lit(0.05) / (F.abs(c(scale_difference)) + 1)


def canonical_views(baseline, degrees) -> Column:
    return F.when((c(baseline) >= 0.30) & (c(degrees) >= 5), 3).when((c(baseline) >= 0.08) | (c(degrees) >= 3), 2).otherwise(1)


def patch_association(distance, tolerance, inside, dot) -> Column:
    return (F.lit(1.0) - c(distance) / c(tolerance)) * 0.55 + F.when(c(inside), 0.25).otherwise(0.15) + F.coalesce(c(dot), F.lit(0.8)) * 0.2
