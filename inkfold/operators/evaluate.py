"""Comparing two renderings pixel by pixel, ranking the worst regions, and deciding what passes.

renderings(board_id, dpi, x, y, r, g, b), one table for each side. Sums are integers until the last division, so results
don't depend on how rows are spread.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.constants import DETAIL_DPIS, INK_LIMITS, MEAN_LIMIT, PIXEL_TOLERANCE, REGION_SIDE, REGIONS, SCALE_DPIS, WITHIN_LIMIT
from inkfold.functions import colors, geometry

KEY = ["board_id", "dpi", "x", "y"]
REGION = ["board_id", "dpi", "tx", "ty"]
CHANNELS = ("r", "g", "b")
SIZES_DIFFER = "reference and generated screenshots have different dimensions"
REPEATED = "a screenshot has several samples of one pixel"


def overlaid(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """A row for each place that a side has: its region's corner tx, ty; held and gheld, how many rows each side has there; r, g, b
    and, of the generated side, gr, gg, gb. Of several rows of a side at one place the greatest counts.

    Both sides are dealt out by region, which is at most REGION_SIDE squared places. Whatever is counted by place or region
    after that stays where it is. The greatest is that of a struct, so places are grouped by sorting: hash tables of all pixels of
    a partition take more memory and spill more.
    """
    corner = [(F.floor(F.col(c) / REGION_SIDE) * REGION_SIDE).cast("int").alias(f"t{c}") for c in ("x", "y")]
    rows = [side.select(*KEY, *corner, *CHANNELS, F.lit(name).alias("generated")) for side, name in ((reference, False), (generated, True))]
    by_region = rows[0].unionAll(rows[1]).repartition(*REGION)
    sides = (("", ~F.col("generated")), ("g", F.col("generated")))
    found = [c for p, of in sides for c in (F.count_if(of).alias(f"{p}held"), F.max(F.when(of, F.struct(*CHANNELS))).alias(f"{p}color"))]
    places = by_region.groupBy(*REGION, "x", "y").agg(*found)
    return places.select(*REGION, "x", "y", "held", "gheld", *(F.col(f"{p}color.{c}").alias(f"{p}{c}") for p, _ in sides for c in CHANNELS))


def _known() -> Column:
    return reduce(and_, (F.col(c).isNotNull() for c in KEY))


def _paired() -> Column:
    """Whether both sides have a place; none that is not known."""
    return (F.col("held") > 0) & (F.col("gheld") > 0) & _known()


def paired(reference: DataFrame, generated: DataFrame) -> DataFrame:
    """Pixels at the same place, generated ones as gr, gg, gb; and the corner of their region."""
    return overlaid(reference, generated).where(_paired()).drop("held", "gheld")


def _gap(channel: str) -> Column:
    return F.abs(F.col(channel).cast("int") - F.col(f"g{channel}").cast("int"))


def _ranked_by(pair: Column) -> list[Column]:
    """What worst_regions ranks a region by, from its pixels: its score from those with neutral reference ink, its size from all."""
    neutral = pair & (F.col("r") < 255) & (F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))
    gap = sum((_gap(c) for c in CHANNELS), F.lit(0))
    return [F.count_if(neutral).alias("neutral"), F.sum(F.when(neutral, gap)).alias("score"), *(F.max(F.when(pair, F.col(c))).alias(f"m{c}") for c in ("x", "y"))]


def regions(reference: DataFrame, generated: DataFrame, tolerance: int = PIXEL_TOLERANCE) -> DataFrame:
    """A row for each region of each board and scale, with all that scales and worst_regions need, from one exchange of pixels.

    n, gap, near, ink, other_ink: counts and sums over pairs; neutral, score, mx, my: what regions are ranked by; width, height,
    g_width, g_height: how far each side reaches; repeated: whether a side has a place more than once.
    """
    pair, gaps = _paired(), [_gap(c) for c in CHANNELS]
    ink = [sum((255 - F.col(f"{p}{c}").cast("long") for c in CHANNELS), F.lit(0)) for p in ("", "g")]
    sums = [F.sum(F.when(pair, v)).alias(name) for name, v in (("gap", sum(gaps, F.lit(0))), ("ink", ink[0]), ("other_ink", ink[1]))]
    counts = [F.count_if(pair).alias("n"), F.count_if(pair & (F.greatest(*gaps) <= tolerance)).alias("near")]
    reach = [(F.max(F.when(F.col(f"{p}held") > 0, F.col(c))) + 1).alias(f"{side}{name}") for p, side in (("", ""), ("g", "g_")) for c, name in (("x", "width"), ("y", "height"))]
    repeated = F.bool_or((F.greatest("held", "gheld") > 1) & _known()).alias("repeated")
    return overlaid(reference, generated).groupBy(*REGION).agg(*counts, *sums, *_ranked_by(pair), *reach, repeated)


def scales(found: DataFrame) -> DataFrame:
    """regions(...) -> the metrics of each board and scale, or an error, as compare gives them."""
    whole = found.groupBy("board_id", "dpi").agg(*(F.sum(c).alias(c) for c in ("n", "gap", "near", "ink", "other_ink")), *(F.max(c).alias(c) for c in ("width", "height", "g_width", "g_height")), F.bool_or("repeated").alias("repeated"))
    same = F.col("width").eqNullSafe(F.col("g_width")) & F.col("height").eqNullSafe(F.col("g_height")) & F.col("board_id").isNotNull() & F.col("dpi").isNotNull()
    error = F.when(~same, SIZES_DIFFER).when(F.col("repeated"), REPEATED)
    n = F.nullif(F.col("n"), F.lit(0))
    ratio = F.when(F.col("ink") != 0, F.col("other_ink") / F.nullif(F.col("ink"), F.lit(0))).when(F.col("other_ink") == 0, 1.0).otherwise(0.0)
    judged = whole.select("board_id", "dpi", (F.col("gap") / (n * 765)).alias("mean_error"), (F.col("near") / n).alias("within_tolerance"), F.when(n.isNotNull(), ratio).alias("ink_ratio"), error.alias("error"))
    passed = (F.col("mean_error") <= MEAN_LIMIT) & (F.col("within_tolerance") >= WITHIN_LIMIT) & F.col("ink_ratio").between(*INK_LIMITS)
    good = F.col("error").isNull()
    return judged.select("board_id", "dpi", *(F.when(good, F.col(c)).alias(c) for c in ("mean_error", "within_tolerance", "ink_ratio")), F.coalesce(passed & good, F.lit(False)).alias("passed"), "error")


def compare(reference: DataFrame, generated: DataFrame, tolerance: int = PIXEL_TOLERANCE) -> DataFrame:
    """The metrics of each board and scale, or an error where the two sides' sizes differ, one is missing or has a place more than once."""
    return scales(regions(reference, generated, tolerance))


def aggregate_scales(found: DataFrame, order: tuple[int, ...] = SCALE_DPIS) -> DataFrame:
    """The worst of each metric over a board's scales. Of equally distant ink ratios the earlier scale's counts."""
    rank = F.coalesce(*(F.when(F.col("dpi") == dpi, i) for i, dpi in enumerate(order)), F.lit(len(order)))
    key = F.struct(F.abs(F.col("ink_ratio") - 1), -rank, -F.col("dpi"))
    return found.groupBy("board_id").agg(F.max("mean_error").alias("mean_error"), F.min("within_tolerance").alias("within_tolerance"), F.max_by("ink_ratio", key).alias("ink_ratio"), F.bool_and("passed").alias("passed"))


def difference_image(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, *(colors.difference(F.col(c), F.col(f"g{c}")).alias(c) for c in CHANNELS))


def worst_regions(found: DataFrame, dpi: int = SCALE_DPIS[0], most: int = REGIONS) -> DataFrame:
    """regions(...) -> board_id, number, x, y, width, height, score: regions with neutral reference ink that differ most; ties by row."""
    best = Window.partitionBy("board_id").orderBy(F.desc("score"), "ty", "tx")
    ranked = found.where((F.col("dpi") == dpi) & (F.col("neutral") > 0)).withColumn("number", F.row_number().over(best)).where(F.col("number") <= most)
    return ranked.select("board_id", "number", F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("mx") - F.col("tx") + 1).alias("width"), (F.col("my") - F.col("ty") + 1).alias("height"), "score")


def detail_regions(pairs: DataFrame, dpi: int = SCALE_DPIS[0], most: int = REGIONS) -> DataFrame:
    """worst_regions from paired(...), where no metrics are needed."""
    return worst_regions(pairs.where(F.col("dpi") == dpi).groupBy(*REGION).agg(*_ranked_by(F.lit(True))), dpi, most)


def detail_plan(regions: DataFrame, base: int = SCALE_DPIS[0], dpis: tuple[int, ...] = DETAIL_DPIS) -> DataFrame:
    """Each region at each detail scale, with the suffix of its files."""
    scaled = regions.withColumn("dpi", F.explode(F.array(*map(F.lit, dpis)))).withColumn("f", (F.col("dpi") / base).cast("int"))
    return scaled.select("board_id", "number", "dpi", *((F.col(c) * F.col("f")).alias(c) for c in ("x", "y", "width", "height")), F.format_string("-detail-%d-%d", "number", "dpi").alias("suffix"))


def capture_plan(images: DataFrame) -> DataFrame:
    """images(board_id, width, height in pixels) -> the tiles to capture."""
    return images.select("board_id", F.explode(geometry.capture_tiles(F.col("width").cast("int"), F.col("height").cast("int"))).alias("t")).select("board_id", "t.*")


def stitch_status(images: DataFrame, captured: DataFrame) -> DataFrame:
    """images(board_id, width, height); captured(board_id, x, y, width, height, pixel_width, pixel_height) -> board_id, error."""
    plan = capture_plan(images).withColumn("planned", F.lit(True))
    key = ["board_id", "x", "y", "width", "height"]
    both = plan.join(captured.withColumn("held", F.lit(True)), key, "full_outer")
    found = both.groupBy("board_id").agg(F.bool_or(F.col("planned").isNull() | F.col("held").isNull()).alias("off"), F.bool_or((F.col("pixel_width") != F.col("width")) | (F.col("pixel_height") != F.col("height"))).alias("sized"))
    error = F.when((F.col("w") <= 0) | (F.col("h") <= 0), "stitched image dimensions must be positive").when(F.coalesce("off", F.lit(False)), "captured tiles do not match the expected grid").when(F.coalesce("sized", F.lit(False)), "captured tile dimensions do not match the tile plan")
    return images.select("board_id", F.col("width").alias("w"), F.col("height").alias("h")).join(found, "board_id", "left").select("board_id", error.alias("error"))


def stitch(captured_pixels: DataFrame) -> DataFrame:
    """Pixels of tiles(board_id, tile_x, tile_y, x, y, ...) at their places in the whole image."""
    return captured_pixels.withColumns({"x": F.col("x") + F.col("tile_x"), "y": F.col("y") + F.col("tile_y")}).drop("tile_x", "tile_y")
