"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.tables import materialize


def roots(links: DataFrame) -> DataFrame:
    """links(a, b) of orderable ids -> (node, root): the least id of its component for each id that isn't the least itself.

    Each round is a few shuffles of the links by id, with partial minima before; the number of rounds grows with the
    logarithm of the longest path. Links of an id with itself, repeated links and nulls change nothing; no link, no row.
    It ends when every component is a star: no id has two links, and no root has one.
    """
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), instead_of=links)
        as_node, as_root = links.groupBy("a").agg(F.count("*").alias("n")), links.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(True))
        if as_node.join(as_root, "a", "left").where("n > 1 or root").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
