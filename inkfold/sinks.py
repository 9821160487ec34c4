"""What is written: scene JSON, used rasters, published boards, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SVG_PREFIX = "data:image/svg+xml;base64,"


def svg_data_uri(content: Column) -> Column:
    """base64() breaks lines; a data URI has none."""
    return F.concat(F.lit(SVG_PREFIX), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def node_json(nodes: DataFrame) -> DataFrame:
    """board_id, node_seq, json: a row for each node; absent payloads are left out."""
    payload = F.struct(*(F.col(c) for c in nodes.columns if c not in ("board_id", "node_seq")))
    return nodes.select("board_id", "node_seq", F.to_json(payload).alias("json"))


def scene_json(boards: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """board_id, json: whole scenes, on request only, as a scene is one value; nodes in paint order."""
    content = node_json(nodes).groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("node_seq", "json"))).alias("n"))
    files = assets.groupBy("board_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("asset_id", "file", "width", "height")))).alias("a"))
    text = F.concat(F.lit('{"width":'), F.col("width"), F.lit(',"height":'), F.col("height"), F.lit(',"assets":'), F.coalesce("a", F.lit("[]")), F.lit(',"content":['), F.coalesce(F.array_join(F.transform("n", lambda x: x["json"]), ","), F.lit("")), F.lit("]}"))
    return boards.join(files, "board_id", "left").join(content, "board_id", "left").select("board_id", text.alias("json"))


def used_assets(assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assets that an image node refers to."""
    return assets.join(nodes.where("kind = 'image'").select("board_id", "asset_id"), ["board_id", "asset_id"], "left_semi")


def by_name(resources: DataFrame) -> DataFrame:
    """Resources in the order in which they are written: by board and name, names by code point."""
    return resources.orderBy("board_id", "name")


def publishable(nodes: DataFrame, *gates: DataFrame) -> DataFrame:
    """Nodes of boards that every gate(board_id, passed) passes."""
    for gate in gates:
        nodes = nodes.join(gate.where("passed").select("board_id"), "board_id", "left_semi")
    return nodes


_PUBLISHED = "board_id string, node_seq bigint, json string"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The number of the last promoted manifest (0: none), and the version that holds each bucket; under -1, the number of buckets."""
    folder, files = _file_system(spark, f"{path}/manifests")
    numbers = [int(x.getPath().getName()) for x in files.listStatus(folder) if x.getPath().getName().isdigit()] if files.exists(folder) else []
    if not numbers:
        return 0, {}
    rows = spark.read.text(f"{path}/manifests/{max(numbers)}").collect()
    return max(numbers), {int(k): v for k, v in json.loads(rows[0].value).items()}


def _promote(spark: SparkSession, path: str, number: int, versions: dict[int, str]) -> None:
    """Write a manifest beside the others and rename it to its number, which is one step and fails if another has taken it."""
    staged, files = _file_system(spark, f"{path}/manifests/staged-{uuid.uuid4().hex}")
    out = files.create(staged, False)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    if not (free := not files.exists(at := _file_system(spark, f"{path}/manifests/{number}")[0])) or not files.rename(staged, at):
        files.delete(staged, False)
        raise RuntimeError(f"{path} was published by another job meanwhile" if not free else f"manifest {number} of {path} can't be written")


def published(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """board_id, node_seq, json of all published boards, or of those in some buckets."""
    _, versions = _manifest(spark, path)
    folders = [f"{path}/data/{version}/bucket={k}" for k, version in sorted(versions.items()) if k >= 0 and (buckets is None or k in buckets)]
    return spark.read.schema(_PUBLISHED).parquet(*folders) if folders else spark.createDataFrame([], _PUBLISHED)


def publish(nodes: DataFrame, path: str, buckets: int = 64, boards: DataFrame | None = None) -> None:
    """Publish the node JSON of the boards at hand anew; all other boards stay.

    Buckets that hold any of these boards are merged with their other boards into a new version, which no reader sees until
    a manifest names it: a job that dies before leaves the old state, and what it has written is removed by vacuum. boards:
    board_id of those to replace, for boards that have no node any more. The manifest has a line for each bucket; `buckets`
    is fixed by the first publication.
    """
    spark = nodes.sparkSession
    number, versions = _manifest(spark, path)
    count = int(versions.pop(-1, buckets))
    bucket = F.pmod(F.xxhash64("board_id"), F.lit(count)).cast("int").alias("bucket")
    rows = node_json(nodes).withColumn("board_id", F.col("board_id").cast("string"))
    at_hand = rows.select("board_id")
    if boards is not None:
        at_hand = at_hand.union(boards.select(F.col("board_id").cast("string")))
    at_hand = at_hand.distinct()
    touched = [r.bucket for r in at_hand.select(bucket).distinct().collect()]
    kept = published(spark, path, touched).join(at_hand, "board_id", "left_anti")
    version = uuid.uuid4().hex
    merged = rows.select("board_id", "node_seq", "json").union(kept).select("*", bucket)
    merged.repartition("bucket").sortWithinPartitions("board_id", "node_seq").write.partitionBy("bucket").parquet(f"{path}/data/{version}")
    for k in touched:
        if _exists(spark, f"{path}/data/{version}/bucket={k}"):
            versions[k] = version
        else:
            versions.pop(k, None)
    _promote(spark, path, number + 1, versions | {-1: str(count)})


def _exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the versions that the last manifest doesn't name, and older manifests; how many versions went. Not while another job publishes or reads."""
    number, versions = _manifest(spark, path)
    gone = 0
    folder, files = _file_system(spark, f"{path}/data")
    for x in files.listStatus(folder) if files.exists(folder) else []:
        if x.getPath().getName() not in versions.values():
            gone += files.delete(x.getPath(), True)
    folder, files = _file_system(spark, f"{path}/manifests")
    for x in files.listStatus(folder) if files.exists(folder) else []:
        if x.getPath().getName() != str(number):
            files.delete(x.getPath(), False)
    return gone


def evaluation_report(scales: DataFrame, totals: DataFrame, details: DataFrame) -> DataFrame:
    """board_id, json, html: the totals of a board with its scales and details."""
    metrics = F.struct("dpi", "mean_error", "within_tolerance", "ink_ratio", "passed")
    per_scale = scales.groupBy("board_id").agg(F.array_sort(F.collect_list(metrics)).alias("scales"))
    per_detail = details.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("number", "dpi", "x", "y", "width", "height"))).alias("details"))
    whole = totals.join(per_scale, "board_id", "left").join(per_detail, "board_id", "left")
    json = F.to_json(F.struct("mean_error", "within_tolerance", "ink_ratio", "passed", "scales", "details"))
    html = F.format_string("<p>%s</p><ul>%s</ul>", F.when(F.col("passed"), "passed").otherwise("failed"), F.array_join(F.transform("scales", lambda s: F.format_string("<li>%d DPI: mean error %.6f, within tolerance %.6f, ink ratio %.6f</li>", s["dpi"], s["mean_error"], s["within_tolerance"], s["ink_ratio"])), ""))
    return whole.select("board_id", json.alias("json"), html.alias("html"))
