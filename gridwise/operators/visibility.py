"""What cameras saw: nearest samples a pixel, and free space that contradicts samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridwise.functions import vector as vm
from gridwise.functions.camera import element, times
from gridwise.operators.planes import small


def front_samples(samples: DataFrame, pixel: list[str], tolerance: float) -> DataFrame:
    """Samples (depth, pixel columns) no more than tolerance behind the nearest of their pixel."""
    near = samples.groupBy(*pixel).agg(F.min("depth").alias("near"))
    return samples.join(near, pixel).filter(F.col("depth") <= F.col("near") + tolerance)


def contradictions(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Of samples (id, position, normal) against at most a few dozen frames (frame, ms, camera cam_x/y/z, view and
    projection matrices, columns, rows, u0, v0, du, dv, depths array with null where invalid): each comparison as
    support, contradiction (the measured surface lies behind) or occlusion. Ambiguous ones are left out."""
    pairs = samples.join(small(frames), F.lit(True))
    x, y, z, _ = times(F.col("view"), vm.v())
    m = F.col("projection")
    w = element(m, 3) * x + element(m, 7) * y + element(m, 11) * z + element(m, 15)
    u = (element(m, 0) * x + element(m, 4) * y + element(m, 8) * z + element(m, 12)) / w * 0.5 + 0.5
    v = F.lit(0.5) - (element(m, 1) * x + element(m, 5) * y + element(m, 9) * z + element(m, 13)) / w * 0.5
    seen = pairs.withColumn("z_", z).withColumn("w_", w).withColumn("u_", u).withColumn("v_", v).filter("w_ > 0 and z_ < 0 and u_ > 0.02 and u_ < 0.98 and v_ > 0.02 and v_ < 0.98")
    ray = vm.sub(vm.v("cam_"), vm.v())
    seen = seen.filter(F.abs(vm.dot(ray, vm.v("n"))) >= vm.length(ray) * 0.35)
    seen = seen.withColumn("col_", F.floor((F.col("u_") - F.col("u0")) / F.col("du")).cast("int")).withColumn("row_", F.floor((F.col("v_") - F.col("v0")) / F.col("dv")).cast("int"))
    seen = seen.filter("col_ >= 0 and row_ >= 0 and col_ + 1 < columns and row_ + 1 < rows")
    i = F.col("row_") * F.col("columns") + F.col("col_")
    block = F.array(*(F.get("depths", i + k) for k in (F.lit(0), F.lit(1), F.col("columns"), F.col("columns") + 1)))
    seen = seen.withColumn("block", block).filter(F.forall("block", lambda d: F.coalesce(d > 0, F.lit(False))))
    near, far = F.array_min("block"), F.array_max("block")
    seen = seen.withColumn("near", near).withColumn("far", far).filter(F.col("far") - F.col("near") <= F.greatest(F.lit(0.025), F.col("near") * 0.015))
    slack = F.greatest(F.lit(0.035), F.col("near") * 0.02)
    relation = F.when(-F.col("z_") < F.col("near") - slack, "contradiction").when(-F.col("z_") > F.col("far") + slack, "occluded").otherwise("support")
    return seen.select("id", "frame", "ms", "cam_x", "cam_y", "cam_z", relation.alias("relation"))


def visible(samples: DataFrame, frames: DataFrame, least: int = 3, baseline: float = 0.06, span_ms: float = 220) -> DataFrame:
    """Samples without those that repeated, diverse free-space evidence rejects: contradictions at least `least` and
    three times the support, from cameras baseline apart from the first contradicting one and span_ms later."""
    facts = contradictions(samples, frames)
    against = facts.filter("relation = 'contradiction'")
    first = against.groupBy("id").agg(F.min_by(F.struct("ms", "cam_x", "cam_y", "cam_z"), F.struct("ms", "frame")).alias("first"))
    away = vm.length(tuple(F.col(f"cam_{a}") - F.col(f"first.cam_{a}") for a in "xyz"))
    diverse = against.join(first, "id").groupBy("id").agg(F.max(away >= baseline).alias("diverse"), F.max(F.abs(F.col("ms") - F.col("first.ms"))).alias("span"))
    votes = facts.groupBy("id").agg(F.count_if(F.col("relation") == "support").alias("support"), F.count_if(F.col("relation") == "contradiction").alias("against"))
    gone = votes.join(diverse, "id").filter((F.col("against") >= F.greatest(F.lit(least), F.col("support") * 3)) & F.col("diverse") & (F.col("span") >= span_ms))
    return samples.join(gone.select("id"), "id", "left_anti")
