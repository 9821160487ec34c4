"""Boards, images, renderings and operator streams derived from the given tables, each by one projection.

Numbers are scaled by powers of two and floored, so that every engine gets the same ones. Each derivation is there as a
DataFrame and, for comparison, as a SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(value: Column) -> Column:
    return F.least(F.lit(255), F.floor(F.abs(value.cast("double")) * 1024).cast("int"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 image for each vector. Faint samples are cleared, so that images have several components; every fifth image is
    far fainter, every seventh a wide colored band."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    at = lambda k: _level(F.element_at("embedding", (F.col("i") + k) % 64 + 1))
    alpha = F.when(at(0) < 60, 0).when(F.col("vec_id") % 5 == 0, (at(0) / 3).cast("int")).otherwise(at(0))
    band = F.col("vec_id") % 7 == 0
    y = (F.col("i") / 8).cast("int")
    alpha = F.when(band, F.when(y == 3, 80).otherwise(0)).otherwise(alpha)
    rgb = [F.when(band, F.lit(v)).otherwise(at(k)) for k, v in ((1, 255), (2, 192), (3, 0))]
    return e.select(F.col("vec_id").cast("string").alias("image_id"), (F.col("i") % 8).alias("x"), y.alias("y"), rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"), alpha.alias("a"))


def _sql_level(k: int) -> str:
    return f"CAST(least(255, floor(abs(CAST(embedding[(i + {k}) % 64 + 1] AS DOUBLE)) * 1024)) AS INTEGER)"


PIXELS_SQL = f"""px AS (
  SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
    CASE WHEN vec_id % 7 = 0 THEN 255 ELSE {_sql_level(1)} END AS r,
    CASE WHEN vec_id % 7 = 0 THEN 192 ELSE {_sql_level(2)} END AS g,
    CASE WHEN vec_id % 7 = 0 THEN 0 ELSE {_sql_level(3)} END AS b,
    CASE WHEN vec_id % 7 = 0 THEN CASE WHEN i // 8 = 3 THEN 80 ELSE 0 END
      WHEN {_sql_level(0)} < 60 THEN 0 WHEN vec_id % 5 = 0 THEN {_sql_level(0)} // 3 ELSE {_sql_level(0)} END AS a
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""


def large_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 100 x 500 pixels, a pixel for each order; its key gives the image and the place."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    alpha = F.when((key * 7 + F.floor(key / 100) * 3) % 11 < 5, 0).otherwise((F.col("o_custkey") * 37) % 256)
    shade = (F.floor("o_totalprice") % 4 * 64).cast("int")
    return o.select(F.floor(key / 50_000).cast("string").alias("image_id"), (key % 100).cast("int").alias("x"), F.floor(key % 50_000 / 100).cast("int").alias("y"), shade.alias("r"), shade.alias("g"), F.lit(0).alias("b"), alpha.cast("int").alias("a"))


def image_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def renderings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, generated): a board for each hundred order keys, a row of pixels for each order, and a pixel for each of its
    lines in the order of all columns; at 72 DPI the generated side departs further. Boards and pixels grow with lineitem."""
    # Lines equal in these four columns make equal pixels, whatever order the columns after them give, so those aren't shuffled.
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.row_number().over(order) - 1).alias("x"))
    ink = (255 - F.floor(F.col("l_quantity") * 5)).cast("int")
    board = F.floor(F.col("l_orderkey") / 100)
    base = line.select(board.alias("board"), "x", (F.col("l_orderkey") % 100).cast("int").alias("y"), ink.alias("ink"), (F.col("l_linenumber") % 5).alias("k"))
    both = base.withColumn("dpi", F.explode(F.array(F.lit(18), F.lit(72))))
    tint = F.when(F.col("k") == 4, 40).otherwise(0)
    ref = both.select(F.col("board").cast("string").alias("board_id"), "dpi", "x", "y", F.col("ink").alias("r"), F.col("ink").alias("g"), F.greatest(F.lit(0), F.col("ink") - tint).alias("b"))
    drift = (F.col("board") % 16 * F.col("k") / F.when(F.col("dpi") == 18, 4).otherwise(2)).cast("int")
    gen = both.select(F.col("board").cast("string").alias("board_id"), "dpi", "x", "y", F.least(F.lit(255), F.col("ink") + drift).alias("r"), F.col("ink").alias("g"), F.greatest(F.lit(0), F.col("ink") - tint).alias("b"))
    return ref, gen


RENDERINGS_SQL = """base AS (
  SELECT l_orderkey // 100 AS board, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS x,
    CAST(l_orderkey % 100 AS INTEGER) AS y, CAST(255 - floor(l_quantity * 5) AS INTEGER) AS ink, l_linenumber % 5 AS k FROM lineitem),
pairs AS (
  SELECT CAST(board AS VARCHAR) AS board_id, dpi, x, y, ink AS r, ink AS g, greatest(0, ink - CASE WHEN k = 4 THEN 40 ELSE 0 END) AS b,
    least(255, ink + CAST(board % 16 * k // CASE WHEN dpi = 18 THEN 4 ELSE 2 END AS INTEGER)) AS gr, ink AS gg,
    greatest(0, ink - CASE WHEN k = 4 THEN 40 ELSE 0 END) AS gb
  FROM base, (VALUES (18), (72)) AS d(dpi))"""


def operator_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of a board for each user: eight for each event, in the order of time and key. The
    last two set the state that stays: opacity, color spaces, width, dash and miter limit; and leave a curve in the path."""
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v = F.floor(F.abs(F.col("value"))).cast("double")
    rows = e.select(F.col("user_id").cast("string").alias("board_id"), (order * 8).cast("long").alias("base"), "event_id", v.alias("v"))

    def op(i: int, name: Column, nums: list[Column], label: Column | None = None, dash: list[Column] | None = None) -> Column:
        none = F.lit(None).cast("string")
        pattern = F.array(*dash) if dash else F.lit(None)
        return F.struct(F.lit(i).alias("i"), name.alias("op"), F.array(*nums).cast("array<double>").alias("nums"), (none if label is None else label).alias("name"), pattern.cast("array<double>").alias("dash"))

    k, s = F.col("event_id") % 23, F.col("event_id") % 8
    sets = (
        F.when(s == 0, op(6, F.lit("gs"), [], F.lit("GS0")))
        .when(s == 1, op(6, F.lit("cs"), [], F.lit("CS0")))
        .when(s == 2, op(6, F.lit("w"), [F.col("v") % 4 + 1]))
        .when(s == 3, op(6, F.lit("d"), [F.col("v") % 3], dash=[F.col("v") % 3 + 1, F.lit(2)]))
        .when(s == 4, op(6, F.lit("M"), [F.col("v") % 5 + 1]))
        .when(s == 5, op(6, F.lit("CS"), [], F.lit("DeviceCMYK")))
        .when(s == 6, op(6, F.lit("rg"), [F.lit(0.5), F.lit(0.25), F.lit(1)]))
        .otherwise(op(6, F.lit("K"), [F.lit(0), F.lit(1), F.lit(0), F.lit(0.5)]))
    )
    opener = F.when(F.col("event_id") % 1150 == 22, "Q").when(k < 11, "q").otherwise("n")
    ops = F.array(
        op(0, opener, []),
        op(1, F.lit("cm"), [F.lit(2), F.lit(0), F.lit(0), F.lit(2), F.col("v") % 7, F.col("v") % 5]),
        op(2, F.lit("re"), [F.col("v") % 50, F.lit(1), F.lit(3), F.lit(4)]),
        op(3, F.when(k % 3 == 0, "S").when(k % 3 == 1, "f").otherwise("W"), []),
        op(4, F.when(k < 11, "Q").otherwise("n"), []),
        op(5, F.when(k == 5, "Do").otherwise("n"), [], F.when(k == 5, F.concat(F.lit("Im"), (F.col("event_id") % 4).cast("string")))),
        sets,
        F.when(s % 3 == 0, op(7, F.lit("c"), [F.col("v") % 9] * 6)).otherwise(op(7, F.when(s % 3 == 1, "v").otherwise("y"), [F.col("v") % 9] * 4)),
    )
    return rows.select("board_id", "base", F.explode(ops).alias("o")).select("board_id", (F.col("base") + F.col("o.i")).alias("seq"), "o.op", "o.nums", "o.name", "o.dash")


STREAMS_SQL = """e AS (SELECT CAST(user_id AS VARCHAR) AS board_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 8 AS base,
  event_id, event_id % 23 AS k, event_id % 8 AS s, event_id % 1150 = 22 AS extra, floor(abs(value)) AS v FROM events),
ops AS (
  SELECT board_id, base + i AS seq, CASE i WHEN 0 THEN CASE WHEN extra THEN 'Q' WHEN k < 11 THEN 'q' ELSE 'n' END WHEN 1 THEN 'cm' WHEN 2 THEN 're'
    WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'S' WHEN k % 3 = 1 THEN 'f' ELSE 'W' END WHEN 4 THEN CASE WHEN k < 11 THEN 'Q' ELSE 'n' END
    WHEN 5 THEN CASE WHEN k = 5 THEN 'Do' ELSE 'n' END WHEN 6 THEN ['gs', 'cs', 'w', 'd', 'M', 'CS', 'rg', 'K'][s + 1] ELSE ['c', 'v', 'y'][s % 3 + 1] END AS op
  FROM e, (SELECT unnest(range(8)) AS i))"""


def stream_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """boards, resources, alphas and color spaces of the streams; every thirteenth board lacks one resource."""
    users = table(spark, sf_dir, "events").select(F.col("user_id")).distinct()
    boards = users.select(F.col("user_id").cast("string").alias("board_id"), F.lit(200.0).alias("width"), F.lit(100.0).alias("height"))
    names = users.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).where(~((F.col("user_id") % 13 == 0) & (F.col("i") == 3)))
    kind = F.element_at(F.array(F.lit("raster"), F.lit("vector"), F.lit("mixed"), F.lit("raster")), F.col("i") + 1)
    name = F.concat(F.lit("Im"), F.col("i").cast("string"))
    resources = names.select(F.col("user_id").cast("string").alias("board_id"), name.alias("name"), kind.alias("kind"), F.when(kind != "vector", name).alias("asset_id"))
    alphas = boards.select("board_id", F.lit("GS0").alias("name"), F.lit(0.5).alias("opacity"))
    spaces = boards.select("board_id", F.lit("CS0").alias("name"), F.lit("rgb").alias("space"))
    return boards, resources, alphas, spaces


def scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boards, assets, nodes): a board for each order, an image or link node for each of its lines, parts as assets."""
    from inkfold.operators.validate import NODES

    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    side = lambda mod, c: F.when(F.col("o_orderkey") % mod == 0, 0.0).otherwise(F.floor(c).cast("double"))
    boards = orders.select(F.col("o_orderkey").cast("string").alias("board_id"), side(97, F.col("o_totalprice")).alias("width"), side(89, F.col("o_totalprice") / 2).alias("height"))
    link = F.col("l_linenumber") % 4 == 0
    used = lines.where(~link).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    extra = orders.where(F.col("o_orderkey") % 31 == 0).select(F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("p"))
    held = used.where(F.col("p") % 50 != 0).unionByName(extra)
    assets = held.select(F.col("k").cast("string").alias("board_id"), F.col("p").cast("string").alias("asset_id"), F.concat(F.lit("assets/"), F.col("p").cast("string"), F.lit(".png")).alias("file"), F.when(F.col("p") % 41 == 0, 0).otherwise(8).alias("width"), F.lit(8).alias("height"))
    doubled = assets.where(F.col("board_id").cast("long") % 53 == 0)
    assets = assets.unionByName(doubled)
    order = Window.partitionBy("l_orderkey").orderBy(*(c for c in lines.columns if c != "l_orderkey"))
    q = F.col("l_quantity")
    m = F.struct(*(v.cast("double").alias(n) for n, v in zip("abcdef", (q * 8192, F.lit(0.0), F.lit(0.0), F.when(q == 50, 1e6).otherwise(q), F.lit(-1.0), F.lit(-1.0)), strict=True)))
    bounds = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.floor(F.col("l_discount") * 1024).cast("double").alias("width"), q.alias("height"))
    nodes = lines.select(
        F.col("l_orderkey").cast("string").alias("board_id"),
        F.row_number().over(order).cast("long").alias("node_seq"),
        F.when(link, "link").otherwise("image").alias("kind"),
        F.when(~link, F.col("l_partkey").cast("string")).alias("asset_id"),
        F.when(~link, m).alias("matrix"),
        F.when(~link, F.when(F.col("l_tax") > 0.079, 1.5).otherwise(1.0)).alias("opacity"),
        F.when(link, bounds).alias("bounds"),
    )
    return boards, assets, spark.createDataFrame([], NODES).unionByName(nodes, allowMissingColumns=True)


SCENES_SQL = """boards AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS board_id, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE floor(o_totalprice) END AS width,
    CASE WHEN o_orderkey % 89 = 0 THEN 0 ELSE floor(o_totalprice / 2) END AS height FROM orders),
held AS (
  SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_partkey % 50 <> 0
  UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 31 = 0),
assets AS (
  SELECT CAST(k AS VARCHAR) AS board_id, CAST(p AS VARCHAR) AS asset_id, CASE WHEN p % 41 = 0 THEN 0 ELSE 8 END AS width, k % 53 = 0 AS twice FROM held),
nodes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS board_id, CASE WHEN l_linenumber % 4 = 0 THEN 'link' ELSE 'image' END AS kind, CAST(l_partkey AS VARCHAR) AS asset_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS node_seq,
    l_quantity * 8192 AS a, CASE WHEN l_quantity = 50 THEN 1000000 ELSE l_quantity END AS d, CASE WHEN l_tax > 0.079 THEN 1.5 ELSE 1 END AS opacity,
    floor(l_discount * 1024) AS w, l_quantity AS h FROM lineitem)"""
