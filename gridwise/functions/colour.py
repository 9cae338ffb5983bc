"""Colour transfer, distances and paint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridwise.functions.numeric import c, clamp


def srgb_to_linear(x) -> Column:
    x = c(x)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x) -> Column:
    x = clamp(x)
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def hex_to_linear(text) -> tuple[Column, Column, Column]:
    """Linear r, g, b of '#rrggbb'; null for any other text."""
    text = c(text)
    good = text.rlike("^#[0-9a-fA-F]{6}$")
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("double") / 255
    return tuple(F.when(good, srgb_to_linear(part(i))) for i in (2, 4, 6))


def luminance(r, g, b) -> Column:
    return c(r) * 0.2126 + c(g) * 0.7152 + c(b) * 0.0722


def chroma_distance(a: tuple, b: tuple) -> Column:
    """Distance of two colours' shares of r, g and b."""
    shares = lambda t: [x / F.greatest(F.lit(1e-6), sum(map(c, t), F.lit(0.0))) for x in map(c, t)]
    return F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(shares(a), shares(b), strict=True)), F.lit(0.0)))


#: Paint by role where nothing was chosen.
ROLE_COLOURS = {"wall": "#c8e1e4", "ceiling": "#d8cceb", "floor": "#c9e3cf"}


def paint_colour(role, chosen) -> Column:
    """The chosen colour of a surface, else its role's."""
    preset = F.create_map(*[F.lit(x) for kv in ROLE_COLOURS.items() for x in kv])
    return F.coalesce(c(chosen), preset[c(role)])
