"""Counts of scenes and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("image", "vector-artwork", "path", "text", "link", "svg-document")


def scene_summary(boards: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """board_id, width, height, assets, and a count for each kind of node."""
    counts = nodes.groupBy("board_id").agg(*(F.count_if(F.col("kind") == k).alias(k.replace("-", "_") + "_nodes") for k in KINDS))
    files = assets.groupBy("board_id").agg(F.count("*").alias("assets"))
    both = boards.select("board_id", "width", "height").join(files, "board_id", "left").join(counts, "board_id", "left")
    return both.fillna(0, [c for c in both.columns if c not in ("board_id", "width", "height")])


def document_summary(documents: DataFrame, operators: DataFrame, resources: DataFrame, links: DataFrame) -> DataFrame:
    """documents(board_id, file, pages, width, height) with counts and the text shown for a document.

    A document that hasn't exactly one page has an error instead of a text.
    """
    used = resources.groupBy("board_id").agg(F.count("*").alias("images"), F.count_if(F.col("kind").isin("vector", "mixed")).alias("vectors"), F.count_if(F.col("kind").isin("raster", "mixed")).alias("rasters"))
    both = documents.join(operators.groupBy("board_id").agg(F.count("*").alias("operators")), "board_id", "left").join(used, "board_id", "left")
    both = both.join(links.groupBy("board_id").agg(F.count("*").alias("links")), "board_id", "left").fillna(0, ["operators", "images", "vectors", "rasters", "links"])
    error = F.when(F.col("pages") != 1, F.concat(F.lit("PDF must contain exactly one page, found "), F.col("pages")))
    text = F.format_string("File: %s\nFormat: PDF\nPages: %d\nBoard: %s x %s pt\nOperators: %d\nImages: %d\nVector artworks: %d\nRaster images: %d\nLinks: %d\n", "file", "pages", F.col("width").cast("string"), F.col("height").cast("string"), "operators", "images", "vectors", "rasters", "links")
    return both.select("board_id", "pages", "operators", "images", "vectors", "rasters", "links", F.when(error.isNull(), text).alias("summary"), error.alias("error"))
