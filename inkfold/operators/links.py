"""Link nodes from annotations(board_id, annot_seq, subtype, action, uri BINARY, rect ARRAY<DOUBLE>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions import geometry
from inkfold.functions.links import GameRule, classify


def extract_links(annotations: DataFrame, boards: DataFrame, rule: GameRule) -> tuple[DataFrame, DataFrame]:
    """(links, errors): link annotations with their target and bounds on the board; one error row for each bad one."""
    rows = annotations.where("subtype = 'Link'").join(boards.select("board_id", "height"), "board_id")
    rows = rows.withColumn("url", F.decode("uri", "ISO-8859-1"))
    target = classify(F.col("url"), rule)
    rows = rows.withColumn("target", target)
    error = (
        F.when(~F.col("action").eqNullSafe("URI"), "link action is not a URI")
        .when(F.col("uri").isNull(), "URI is not a PDF string")
        .when(F.col("target.error").isNotNull(), F.col("target.error"))
        .when(~F.coalesce(F.size("rect") == 4, F.lit(False)), "annotation Rect must contain four numbers")
    )
    kind = F.when(F.col("action").eqNullSafe("URI") & F.col("uri").isNotNull() & F.col("target.error").isNull(), "invalid_structure").otherwise("invalid_url")
    rows = rows.withColumns({"error": error, "error_kind": kind})
    good = rows.where("error IS NULL")
    links = good.select("board_id", "annot_seq", F.struct("target.kind", "target.video_id", "target.url").alias("target"), geometry.rect_to_board(F.col("rect"), F.col("height")).alias("bounds"))
    return links, rows.where("error IS NOT NULL").select("board_id", "annot_seq", "error_kind", "error")
