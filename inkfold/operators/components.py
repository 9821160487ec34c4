"""Connected components of visible pixels, their statistics, and how each can be drawn.

Pixels are labeled in tiles of bounded size; only the pixels along tile borders meet to join labels across tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.constants import HALF_COVERAGE, RECONSTRUCTION_PEAK, THIN_WIDTH, UNTRACED_INK, VECTOR_FLOOR_ALPHA
from inkfold.functions import colors
from inkfold.operators.connected import roots
from inkfold.operators.groups import map_groups
from inkfold.tables import materialize as cut

TILE = 256


def _local_labels(tile: int):
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The first pixel of each 8-connected component within its tile, for many tiles at once."""
        n, side = len(pdf), tile + 2
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        place = (group * side + y % tile + 1) * side + x % tile + 1
        order = np.argsort(place)  # row by row within each tile
        code = place[order]
        links = []
        for step in (1, side - 1, side, side + 1):
            at = np.minimum(np.searchsorted(code, code + step), n - 1)
            hit = np.flatnonzero(code[at] == code + step)
            links.append((hit, at[hit]))
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        root = np.arange(n)
        while True:
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            np.minimum.at(root, before, root)
            root = root[root]
            if (root == before).all():
                break
        first = np.empty(n, np.int64)
        first[order] = order[root]
        return pdf.assign(ly=y[first], lx=x[first])[["image_id", "x", "y", "r", "g", "b", "a", "ly", "lx"]]

    return run


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, ties: list[str] | None = None, first: int = 0) -> DataFrame:
    """rows with `name`: the number of each among those of its keys, by the order and then the ties, from `first` on.

    Rows are dealt out by ranges of the order and counted by range; no task has all rows of a large key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    offsets = counts.select(*keys, "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order, *(ties or [])))
    found = dealt.withColumn(name, own).join(offsets, [*keys, "__range"])
    return found.withColumn(name, (F.col(name) + F.col("__before") + (first - 1)).cast("int")).drop("__range", "__before")


def label_components(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Visible pixels with `label`: 8-connected components of an image, numbered from 1 by their first pixel in row order."""
    seen = pixels.where("a > 0").select("image_id", "x", "y", "r", "g", "b", "a")
    tiles = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in ("x", "y")]
    tiled = seen.withColumns({"tx": tiles[0], "ty": tiles[1]})
    local = cut(map_groups(tiled, ["image_id", "tx", "ty"], _local_labels(tile), "image_id string, x int, y int, r int, g int, b int, a int, ly int, lx int"))
    node = F.struct("image_id", "ly", "lx")
    edge = local.where(F.pmod("x", F.lit(tile)).isin(0, tile - 1) | F.pmod("y", F.lit(tile)).isin(0, tile - 1)).select("image_id", "x", "y", node.alias("n"))
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))))
    reach = edge.withColumn("d", F.explode(near)).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("n").alias("a"))
    links = reach.join(edge.withColumnRenamed("n", "b"), ["image_id", "x", "y"]).where("a <> b").select("a", "b").distinct()
    joined = roots(links)
    nodes = local.select(node.alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    numbers = numbered(nodes.select("root.*").distinct(), ["image_id"], ["ly", "lx"], "label", first=1)
    named = nodes.join(numbers.select(F.struct("image_id", "ly", "lx").alias("root"), "label"), "root").select("node.*", "label")
    return local.join(named, ["image_id", "ly", "lx"]).select("image_id", "x", "y", "r", "g", "b", "a", "label")


def _covered_around(level: Column) -> Column:
    """All four neighbors are there and at least at the level. Rows need not be adjacent, so coordinates are compared."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")

    def at(window, step: int, axis: str) -> Column:
        near = F.lag(F.struct(axis, "a"), step).over(window)
        return F.coalesce((F.abs(near[axis] - F.col(axis)) == 1) & (near["a"] >= level), F.lit(False))

    return at(row, 1, "x") & at(row, -1, "x") & at(column, 1, "y") & at(column, -1, "y")


def component_stats(labeled: DataFrame) -> DataFrame:
    """image_id, label, ink, untraced, covered, boundary, n_colors, color (packed, null unless there's one)."""
    packed = F.when(F.col("a") >= VECTOR_FLOOR_ALPHA, colors.packed_color(F.col("r"), F.col("g"), F.col("b")))
    covered = F.col("a") >= HALF_COVERAGE
    rows = labeled.withColumns({"inner": _covered_around(F.lit(HALF_COVERAGE)), "color": packed})
    found = rows.groupBy("image_id", "label").agg(
        F.sum("a").alias("ink"),
        F.sum(F.when(F.col("a") < VECTOR_FLOOR_ALPHA, F.col("a")).otherwise(0)).alias("untraced"),
        F.count_if(covered).alias("covered"),
        F.count_if(covered & ~F.col("inner")).alias("boundary"),
        F.min("color").alias("low"),
        F.max("color").alias("high"),
    )
    one = F.col("low") == F.col("high")
    return found.select("image_id", "label", "ink", "untraced", "covered", "boundary", F.when(F.col("low").isNull(), 0).when(one, 1).otherwise(2).alias("n_colors"), F.when(one, F.col("low")).alias("color"))


def stroke_colors(labeled: DataFrame) -> DataFrame:
    """image_id, label, stroke_color (packed, or null): of narrow strokes of one color, at half of their own peak."""
    peaks = labeled.groupBy("image_id", "label").agg(F.max("a").alias("peak"))
    rows = labeled.join(peaks, ["image_id", "label"]).withColumn("half", ((F.col("peak") + 1) / 2).cast("int"))
    # A neighbor at the level is visible and so has the same label and half.
    rows = rows.withColumn("inner", _covered_around(F.col("half"))).where("a >= half").withColumn("color", colors.packed_color(F.col("r"), F.col("g"), F.col("b")))
    found = rows.groupBy("image_id", "label").agg(F.max("peak").alias("peak"), F.count("*").alias("n"), F.count_if(~F.col("inner")).alias("edge"), F.min("color").alias("low"), F.max("color").alias("high"))
    narrow = (F.col("peak") >= RECONSTRUCTION_PEAK) & (2 * F.col("n") < THIN_WIDTH * F.col("edge")) & (F.col("low") == F.col("high"))
    return found.select("image_id", "label", F.when(narrow, F.col("low")).alias("stroke_color"))


def component_kinds(labeled: DataFrame) -> DataFrame:
    """The statistics with stroke_color and kind: reconstructed, residual, smooth or pixel."""
    both = component_stats(labeled).join(stroke_colors(labeled), ["image_id", "label"])
    kind = (
        F.when((F.col("untraced") > UNTRACED_INK * F.col("ink")) & F.col("stroke_color").isNotNull(), "reconstructed")
        .when(F.col("untraced") > UNTRACED_INK * F.col("ink"), "residual")
        .when((F.col("covered") > 0) & (2 * F.col("covered") < THIN_WIDTH * F.col("boundary")) & (F.col("n_colors") == 1), "smooth")
        .otherwise("pixel")
    )
    return both.withColumn("kind", kind)


def partition_artwork(labeled: DataFrame, kinds: DataFrame) -> DataFrame:
    """Labeled pixels with the kind of their component: the parts of each image."""
    return labeled.join(kinds.select("image_id", "label", "kind"), ["image_id", "label"])


def artwork_parts(images: DataFrame, kinds: DataFrame) -> DataFrame:
    """image_id, part: the parts that aren't empty. An image without components is one pixel part."""
    found = kinds.select("image_id", F.col("kind").alias("part")).distinct()
    none = images.select("image_id").distinct().join(found, "image_id", "left_anti").withColumn("part", F.lit("pixel"))
    return found.unionByName(none)
