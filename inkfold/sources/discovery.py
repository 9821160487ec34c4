"""Source documents: which files are boards, and whether a root has exactly one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.constants import IGNORED_FOLDERS


def format_of(path: Column) -> Column:
    """`pdf` or `svg` by the extension, ASCII case ignored; else null."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(extension == ".pdf", "pdf").when(extension == ".svg", "svg")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(root, path, is_symlink) of all files under a folder. Spark's file source follows no links and sees none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.lit(root).alias("root"), "path", F.lit(False).alias("is_symlink"))


def discover(manifest: DataFrame, ignored: tuple[str, ...] = IGNORED_FOLDERS) -> DataFrame:
    """manifest(root, path, is_symlink) -> sources(root, path, format). Order is the writer's: by path."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = manifest.where(~F.coalesce("is_symlink", F.lit(False)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))))
    return kept.select("root", "path", format_of(F.col("path")).alias("format")).where("format IS NOT NULL")


def single_source(roots: DataFrame, sources: DataFrame) -> DataFrame:
    """roots(root) -> root, path, format, error: exactly one source, or an error with their number."""
    found = sources.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("path", "format")).alias("first"))
    one = roots.select("root").distinct().join(found, "root", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    error = F.when(F.col("n") != 1, F.concat(F.lit("expected exactly one PDF or SVG source file, found "), F.col("n")))
    return one.select("root", F.when(F.col("n") == 1, F.col("first.path")).alias("path"), F.when(F.col("n") == 1, F.col("first.format")).alias("format"), error.alias("error"))
