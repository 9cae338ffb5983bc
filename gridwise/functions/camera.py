"""Camera geometry: 4x4 matrices (column-major arrays of 16), unprojection, projection and copied pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from gridwise.functions.numeric import c, finite
from gridwise.functions.vector import Vec

EPSILON = 1e-6
MATRIX_EPSILON, NUMBER_EPSILON = 1e-8, 2.220446049250313e-16


def element(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def times(m: Column, p: tuple[Column, Column, Column], w=1.0) -> tuple[Column, Column, Column, Column]:
    """m * (x, y, z, w)."""
    return tuple(element(m, r) * p[0] + element(m, r + 4) * p[1] + element(m, r + 8) * p[2] + element(m, r + 12) * c(w) for r in range(4))


@pandas_udf(ArrayType(DoubleType()))
def inverted(m: pd.Series) -> pd.Series:
    """Inverse of each matrix (one a frame); null where it is singular or incomplete."""

    def one(x):
        if x is None or len(x) != 16 or not np.isfinite(np.asarray(x, float)).all():
            return None
        a = np.asarray(x, float).reshape(4, 4)
        return None if abs(np.linalg.det(a)) < MATRIX_EPSILON else np.linalg.inv(a).reshape(-1)

    return m.map(one)


def first_matrix(preferred: Column, fallback: Column) -> tuple[Column, Column]:
    """The matrix that is there, and where it came from."""
    return F.coalesce(preferred, fallback), F.when(preferred.isNotNull(), "depth").when(fallback.isNotNull(), "view").otherwise("missing")


def unprojected(inverse_projection: Column, transform: Column, u, w, depth) -> Vec:
    """World point of a depth sample; null when u or v leave [0, 1], the depth is not positive, or the ray does
    not point forward."""
    u, w, depth = c(u), c(w), c(depth)
    x, y, z, k = times(inverse_projection, (u * 2 - 1, F.lit(1.0) - w * 2, F.lit(-1.0)))
    x, y, z = (F.when(F.abs(k) > MATRIX_EPSILON, a / k) for a in (x, y, z))
    good = u.between(0, 1) & w.between(0, 1) & finite(depth) & (depth > 0) & (z < -MATRIX_EPSILON)
    s = depth / -z
    out = times(transform, (x * s, y * s, z * s))
    return tuple(F.when(good & (F.abs(out[3]) > MATRIX_EPSILON), a / out[3]) for a in out[:3])


def camera_uv(view: Column, projection: Column, p: Vec) -> tuple[Column, Column]:
    """Camera u and v of a world point; null behind the camera or without a positive w."""
    x, y, z, w = times(view, p)
    cx, cy, _, cw = times(projection, (x, y, z))
    good = (z < 0) & (cw > NUMBER_EPSILON) & finite(x) & finite(y) & finite(w)
    return F.when(good, (cx / cw + 1) / 2), F.when(good, (F.lit(1.0) - cy / cw) / 2)


ORIENTATIONS = ("identity", "vertical-flipped", "horizontal-mirrored", "rotated-180")


def copied_pixel(u, w, orientation: Column, crop: tuple, size: tuple, snap: bool = True) -> tuple[Column, Column]:
    """The pixel of a copied image for camera u and v, through orientation and crop (x, y, width, height)."""
    u, w = c(u), c(w)
    x0, y0, cw, ch = map(c, crop)
    width, height = map(c, size)
    mirrored = orientation.isin("horizontal-mirrored", "rotated-180")
    flipped = orientation.isin("vertical-flipped", "rotated-180")
    tu = F.when(mirrored, F.lit(1.0) - u).otherwise(u)
    tv = F.when(flipped, w).otherwise(F.lit(1.0) - w)
    good = u.between(0, 1) & w.between(0, 1) & tu.between(x0, x0 + cw) & tv.between(y0, y0 + ch)
    a, b = (tu - x0) / cw, F.lit(1.0) - (tv - y0) / ch
    if not snap:
        return F.when(good, a * width - 0.5), F.when(good, b * height - 0.5)
    pixel = lambda t, n: F.least(n - 1, F.greatest(F.lit(0), F.floor(t * n)))
    return F.when(good, pixel(a, width)), F.when(good, pixel(b, height))


def copy_dimensions(width, height, longest: float, most_pixels: float) -> tuple[Column, Column]:
    """Width and height of a copy under limits of edge and area."""
    width, height = c(width), c(height)
    k = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height), F.sqrt(F.lit(float(most_pixels)) / (width * height)))
    return F.greatest(F.lit(1), F.floor(width * k)), F.greatest(F.lit(1), F.floor(height * k))


def same_matrices(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Both there, equally long, and equal within tolerance."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def flip_rows(rgba: bytes, width: int, height: int) -> bytes:
    """Bottom-left RGBA rows as top-left RGB rows."""
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[::-1, :, :3].tobytes()
