"""Images by their alpha: raster, low-alpha raster, or to be traced; highlighters. pixels(image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.constants import HIGHLIGHTER_ASPECT, HIGHLIGHTER_CHROMA, RASTER_TRANSPARENCY, TRACE_TRANSPARENCY, TRACEABLE_ALPHA


def classify_images(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """images(image_id, masked) -> image_id, disposition, error. An image without a mask stays raster."""
    stats = pixels.groupBy("image_id").agg(F.max("a").alias("high"), F.count_if(F.col("a") < 255).alias("clear"), F.count("*").alias("n"))
    both = images.select("image_id", "masked").join(stats, "image_id", "left")
    share = F.col("clear") / F.nullif(F.col("n"), F.lit(0))
    masked = F.col("masked")
    error = (
        F.when(masked & F.col("n").isNull(), "soft mask is empty")
        .when(masked & (F.col("high") == 0), "soft mask contains no visible artwork")
        .when(masked & (F.col("high") >= TRACEABLE_ALPHA) & (share > RASTER_TRANSPARENCY) & (share < TRACE_TRANSPARENCY), "soft-masked image is too opaque to classify safely")
    )
    kind = F.when(~masked, "raster").when(F.col("high") < TRACEABLE_ALPHA, "low_alpha_raster").when(share <= RASTER_TRANSPARENCY, "raster").otherwise("trace")
    return both.select("image_id", F.when(error.isNull(), kind).alias("disposition"), error.alias("error"))


def image_profiles(pixels: DataFrame) -> DataFrame:
    """Of the visible pixels: number, chromatic ones, bounds (right and bottom exclusive), whether any is translucent."""
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    seen = pixels.where("a > 0").groupBy("image_id")
    return seen.agg(
        F.count("*").alias("visible"),
        F.count_if(spread >= HIGHLIGHTER_CHROMA).alias("chromatic"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") + 1).alias("right"),
        (F.max("y") + 1).alias("bottom"),
        F.bool_or(F.col("a") < 255).alias("translucent"),
    )


def highlighters(profiles: DataFrame) -> DataFrame:
    """image_id of long, colored, translucent images."""
    sides = (F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
    long = F.greatest(*sides) >= HIGHLIGHTER_ASPECT * F.greatest(F.lit(1), F.least(*sides))
    return profiles.where((F.col("visible") > 0) & (F.col("chromatic") * 20 >= F.col("visible") * 19) & F.col("translucent") & long).select("image_id")


def make_opaque(pixels: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Visible samples of highlighters among the low-alpha rasters get full alpha; all else is unchanged."""
    low = dispositions.where("disposition = 'low_alpha_raster'").select("image_id")
    own = highlighters(image_profiles(pixels.join(low, "image_id", "left_semi"))).withColumn("lit", F.lit(True))
    return pixels.join(own, "image_id", "left").withColumn("a", F.when(F.col("lit") & (F.col("a") > 0), 255).otherwise(F.col("a"))).drop("lit")
