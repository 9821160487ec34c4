"""Colors: conversions, quantized styles, difference images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import COLOR_STEP, FAINT_OPACITY, TRACEABLE_ALPHA, VECTOR_FLOOR_ALPHA


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"))


def from_gray(gray: Column) -> Column:
    return rgb(gray, gray, gray)


def from_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Null where a component is outside 0 to 1."""
    valid = F.lit(True)
    for v in (c, m, y, k):
        valid = valid & (v >= 0) & (v <= 1)
    return F.when(valid, rgb(*(1 - F.least(F.lit(1.0), v + k) for v in (c, m, y))))


def quantize(channel: Column) -> Column:
    return F.least(F.lit(255), ((channel.cast("int") + COLOR_STEP // 2) / COLOR_STEP).cast("int") * COLOR_STEP)


def quantize_opacity(alpha: Column) -> Column:
    return F.when(alpha < TRACEABLE_ALPHA, FAINT_OPACITY).otherwise(255)


def style(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Quantized (r, g, b, opacity) of a sample, null below the vector floor."""
    values = (("r", quantize(r)), ("g", quantize(g)), ("b", quantize(b)), ("opacity", quantize_opacity(a)))
    return F.when(a >= VECTOR_FLOOR_ALPHA, F.struct(*(v.alias(n) for n, v in values)))


def packed_color(r: Column, g: Column, b: Column) -> Column:
    """The quantized color as one number."""
    return quantize(r) * 65536 + quantize(g) * 256 + quantize(b)


def difference(left: Column, right: Column) -> Column:
    """A channel of the difference image."""
    return F.least(F.lit(255), F.abs(left.cast("int") - right.cast("int")) * 4)
