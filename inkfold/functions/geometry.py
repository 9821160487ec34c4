"""Matrices, points and rectangles as struct columns. The left matrix of a product is applied first; board y points down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import CAPTURE_HEIGHT, CAPTURE_WIDTH, SIMILARITY_TOLERANCE, UNITS_PER_INCH

MATRIX_FIELDS = ("a", "b", "c", "d", "e", "f")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def matrix(*values: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(MATRIX_FIELDS, values, strict=True)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """m, then n."""
    rows = [(m["a"], m["b"]), (m["c"], m["d"]), (m["e"], m["f"])]
    cells = [(x * n["a"] + y * n["c"], x * n["b"] + y * n["d"]) for x, y in rows]
    (a, b), (c, d), (e, f) = cells
    return matrix(a, b, c, d, e + n["e"], f + n["f"])


def apply(m: Column, p: Column) -> Column:
    return point(m["a"] * p["x"] + m["c"] * p["y"] + m["e"], m["b"] * p["x"] + m["d"] * p["y"] + m["f"])


def to_board(p: Column, height: Column) -> Column:
    """A page point, y up, as a board point."""
    return point(p["x"], height - p["y"])


def board_matrix(m: Column, height: Column) -> Column:
    return matrix(m["a"], -m["b"], m["c"], -m["d"], m["e"], height - m["f"])


def image_matrix(m: Column) -> Column:
    """The one flip of the image's unit square, whose y points up on a page."""
    return matrix(m["a"], m["b"], -m["c"], -m["d"], m["e"] + m["c"], m["f"] + m["d"])


def rect_to_board(corners: Column, height: Column) -> Column:
    """A rectangle from two corners [x1, y1, x2, y2] in any order."""
    x1, y1, x2, y2 = (corners[i] for i in range(4))
    high = F.abs(y2 - y1)
    return F.struct(F.least(x1, x2).alias("x"), (height - (F.least(y1, y2) + high)).alias("y"), F.abs(x2 - x1).alias("width"), high.alias("height"))


def page_size(corners: Column) -> Column:
    """(width, height, error) of a page from the corners [x1, y1, x2, y2] of its box, in this order."""
    width, height = corners[2] - corners[0], corners[3] - corners[1]
    error = F.when(F.coalesce((width <= 0) | (height <= 0), F.lit(True)), "page dimensions must be positive")
    return F.struct(F.when(error.isNull(), width).alias("width"), F.when(error.isNull(), height).alias("height"), error.alias("error"))


def command(kind: str, end: Column | None = None, first: Column | None = None, second: Column | None = None) -> Column:
    none = F.lit(None).cast("struct<x:double,y:double>")
    return F.struct(F.lit(kind).alias("kind"), *((none if p is None else p).alias(n) for n, p in (("first", first), ("second", second), ("end", end))))


def rectangle_commands(x: Column, y: Column, w: Column, h: Column, m: Column, height: Column) -> Column:
    """The five commands of a rectangle, transformed."""
    corners = [to_board(apply(m, point(px, py)), height) for px, py in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return F.array(command("move", corners[0]), *(command("line", c) for c in corners[1:]), command("close"))


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def similarity_scale(m: Column) -> Column:
    """The factor of a non-singular similarity, null for any other matrix."""
    first, second = m["a"] * m["a"] + m["b"] * m["b"], m["c"] * m["c"] + m["d"] * m["d"]
    even = F.abs(first - second) <= SIMILARITY_TOLERANCE * F.greatest(first, second)
    square = F.abs(m["a"] * m["c"] + m["b"] * m["d"]) <= SIMILARITY_TOLERANCE * F.sqrt(first * second)
    return F.when((determinant(m) != 0) & even & square, F.sqrt(first))


def placed(path: Column, m: Column) -> Column:
    """Contours of an image's unit square, y down, as commands of the board under the image's matrix."""

    def contour(c: Column) -> Column:
        lines = F.transform(c["segments"], lambda s: F.struct(F.when(s["first"].isNull(), "line").otherwise("curve").alias("kind"), *(F.when(s[n].isNotNull(), apply(m, s[n])).alias(n) for n in ("first", "second")), apply(m, s["end"]).alias("end")))
        return F.concat(F.array(command("move", apply(m, c["start"]))), lines, F.array(command("close")))

    return F.flatten(F.transform(path, contour))


def signed_area(points: Column) -> Column:
    """Twice the area of a closed polygon; of no points 0."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def capture_tiles(width: Column, height: Column) -> Column:
    """An array of (x, y, width, height), row by row; empty unless both sides are positive."""

    def row(y: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), width - 1, F.lit(CAPTURE_WIDTH)),
            lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(CAPTURE_WIDTH), width - x).alias("width"), F.least(F.lit(CAPTURE_HEIGHT), height - y).alias("height")),
        )

    empty = F.array().cast("array<struct<x:int,y:int,width:int,height:int>>")
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(height, F.lit(1)) - 1, F.lit(CAPTURE_HEIGHT)), row))
    return F.when((width > 0) & (height > 0), whole).otherwise(empty)


def scaled_pixels(size: Column, dpi: Column) -> Column:
    return F.ceil(size * dpi / UNITS_PER_INCH).cast("int")


def clip_region(region: Column, width: Column, height: Column) -> Column:
    """A region cut at the board's edges, null if it lies outside."""
    inside = (region["x"] < width) & (region["y"] < height)
    return F.when(inside, F.struct(region["x"].alias("x"), region["y"].alias("y"), F.least(region["width"], width - region["x"]).alias("width"), F.least(region["height"], height - region["y"]).alias("height")))


def unit_point(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A point in source pixels in the image's unit square."""
    return point(x / width, y / height)
