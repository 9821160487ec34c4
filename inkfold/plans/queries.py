"""Queries over the given tables, each with the SQL that another engine runs for comparison, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold import sinks
from inkfold.functions import colors, geometry, links, text
from inkfold.operators import classify, components, evaluate, interpret, markup, summary, tracing, validate
from inkfold.operators import links as link_nodes
from inkfold.plans import inputs
from inkfold.plans.inputs import PIXELS_SQL, RENDERINGS_SQL, SCENES_SQL, STREAMS_SQL, table
from inkfold.sources import discovery, images
from inkfold.tables import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The game rule of the queries, on an invented place.
RULE = links.GameRule("games.example.org", "/arcade/", "/games/", "Example Arcade")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Renderings

_METRICS_SQL = f"""WITH {RENDERINGS_SQL},
m AS (
  SELECT board_id, dpi, count(*) AS n, sum(abs(r - gr) + abs(g - gg) + abs(b - gb)) AS gap,
    count(*) FILTER (greatest(abs(r - gr), abs(g - gg), abs(b - gb)) <= 32) AS near,
    sum(765 - r - g - b) AS ink, sum(765 - gr - gg - gb) AS other FROM pairs GROUP BY ALL),
f AS (
  SELECT board_id, dpi, CAST(gap AS DOUBLE) / CAST(n * 765 AS DOUBLE) AS mean_error, CAST(near AS DOUBLE) / n AS within_tolerance,
    CASE WHEN ink <> 0 THEN CAST(other AS DOUBLE) / CAST(ink AS DOUBLE) WHEN other = 0 THEN 1.0 ELSE 0.0 END AS ink_ratio FROM m),
s AS (SELECT *, mean_error <= 0.02 AND within_tolerance >= 0.96 AND ink_ratio BETWEEN 0.85 AND 1.15 AS passed FROM f)"""


@query(_METRICS_SQL + " SELECT *, CAST(NULL AS VARCHAR) AS error FROM s")
def compare_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare(*inputs.renderings(spark, sf_dir))


@query(_METRICS_SQL + """ SELECT board_id, max(mean_error) AS mean_error, min(within_tolerance) AS within_tolerance,
  arg_max(ink_ratio, [abs(ink_ratio - 1), -dpi]) AS ink_ratio, bool_and(passed) AS passed FROM s GROUP BY board_id""")
def aggregate_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aggregate_scales(evaluate.compare(*inputs.renderings(spark, sf_dir)))


_REGIONS_SQL = f"""WITH {RENDERINGS_SQL},
t AS (
  SELECT board_id, x // 32 * 32 AS tx, y // 32 * 32 AS ty, count(*) FILTER (r < 255 AND r = g AND r = b) AS ink,
    sum(abs(r - gr) + abs(g - gg) + abs(b - gb)) FILTER (r < 255 AND r = g AND r = b) AS score, max(x) AS mx, max(y) AS my
  FROM pairs WHERE dpi = 18 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY score DESC, ty, tx) AS number FROM t WHERE ink > 0)"""


@query(_REGIONS_SQL + """ SELECT board_id, CAST(number AS INTEGER) AS number, tx AS x, ty AS y, mx - tx + 1 AS width, my - ty + 1 AS height,
  CAST(score AS BIGINT) AS score FROM k WHERE number <= 3""")
def detail_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.detail_regions(evaluate.paired(*inputs.renderings(spark, sf_dir)))


@query(_REGIONS_SQL + """ SELECT board_id, CAST(number AS INTEGER) AS number, dpi, tx * (dpi // 18) AS x, ty * (dpi // 18) AS y,
  (mx - tx + 1) * (dpi // 18) AS width, (my - ty + 1) * (dpi // 18) AS height, '-detail-' || number || '-' || dpi AS suffix
  FROM k, (VALUES (288), (576)) AS d(dpi) WHERE number <= 3""")
def detail_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.detail_plan(evaluate.detail_regions(evaluate.paired(*inputs.renderings(spark, sf_dir))))


@query(f"""WITH {RENDERINGS_SQL} SELECT board_id, dpi, x, y, least(255, abs(r - gr) * 4) AS r, least(255, abs(g - gg) * 4) AS g, least(255, abs(b - gb) * 4) AS b FROM pairs""")
def difference_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.difference_image(evaluate.paired(*inputs.renderings(spark, sf_dir)))


@query()
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels meet once; scales, totals and details are all made of the table of their regions."""
    regions = materialize(evaluate.regions(*inputs.renderings(spark, sf_dir)))
    scales = evaluate.scales(regions)
    return sinks.evaluation_report(scales, evaluate.aggregate_scales(scales), evaluate.detail_plan(evaluate.worst_regions(regions)))


@query("""WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS board_id, CAST(floor(o_totalprice) AS INTEGER) % 30000 - 100 AS width, CAST(o_custkey AS INTEGER) * 7 % 15000 AS height FROM orders)
  SELECT board_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(least(8192, width - x) AS INTEGER) AS width, CAST(least(4096, height - y) AS INTEGER) AS height
  FROM (SELECT board_id, width, height, x, unnest(range(0, greatest(height, 0), 4096)) AS y FROM (SELECT *, unnest(range(0, greatest(width, 0), 8192)) AS x FROM b)) WHERE width > 0 AND height > 0""")
def capture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.capture_plan(_boards_in_pixels(spark, sf_dir))


def _boards_in_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("board_id"), (F.floor("o_totalprice").cast("int") % 30000 - 100).alias("width"), (F.col("o_custkey").cast("int") * 7 % 15000).alias("height"))


@query("""WITH b AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS INTEGER) % 30000 - 100 AS w, CAST(o_custkey AS INTEGER) * 7 % 15000 AS h FROM orders)
  SELECT CAST(k AS VARCHAR) AS board_id, CASE WHEN w <= 0 OR h <= 0 THEN 'stitched image dimensions must be positive'
    WHEN k % 5 = 0 THEN 'captured tiles do not match the expected grid' WHEN k % 7 = 0 THEN 'captured tile dimensions do not match the tile plan' END AS error FROM b""")
def stitch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made of the plan: every fifth board lacks its first tile, every seventh has wrong sizes."""
    boards = _boards_in_pixels(spark, sf_dir)
    k = F.col("board_id").cast("long")
    held = evaluate.capture_plan(boards).where(~((k % 5 == 0) & (F.col("x") == 0) & (F.col("y") == 0)))
    captured = held.withColumns({"pixel_width": F.col("width") + F.when(k % 7 == 0, 1).otherwise(0), "pixel_height": F.col("height")})
    return evaluate.stitch_status(boards, captured)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS board_id, CAST(ceil(o_totalprice * 18 / 72) AS INTEGER) AS pixels,
  CASE WHEN o_custkey % 300 < ceil(o_totalprice * 18 / 72) THEN CAST(least(50, ceil(o_totalprice * 18 / 72) - o_custkey % 300) AS INTEGER) END AS clipped FROM orders""")
def clipped_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    size = geometry.scaled_pixels(F.col("o_totalprice"), F.lit(18))
    region = F.struct((F.col("o_custkey") % 300).cast("int").alias("x"), F.lit(10).alias("y"), F.lit(50).alias("width"), F.lit(20).alias("height"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("board_id"), size.alias("pixels"), region.alias("region"))
    return rows.select("board_id", "pixels", geometry.clip_region(F.col("region"), F.col("pixels"), F.lit(4000))["width"].alias("clipped"))


# Images

_DISPOSITION_SQL = """c AS (SELECT image_id, max(a) AS high, CAST(count(*) FILTER (a < 255) AS DOUBLE) / count(*) AS share FROM px GROUP BY image_id),
d AS (SELECT image_id, CASE WHEN high = 0 THEN 'soft mask contains no visible artwork' WHEN high >= 96 AND share > 0.01 AND share < 0.02 THEN 'soft-masked image is too opaque to classify safely' END AS error,
  CASE WHEN high < 96 THEN 'low_alpha_raster' WHEN share <= 0.01 THEN 'raster' ELSE 'trace' END AS kind FROM c),
disp AS (SELECT image_id, CASE WHEN error IS NULL THEN kind END AS disposition, error FROM d)"""
_CLASS_SQL = f"WITH {PIXELS_SQL},\n{_DISPOSITION_SQL}"
_PROFILE_SQL = """prof AS (SELECT image_id, count(*) AS visible, count(*) FILTER (greatest(r, g, b) - least(r, g, b) >= 28) AS chromatic, min(x) AS "left", min(y) AS top,
  max(x) + 1 AS "right", max(y) + 1 AS bottom, bool_or(a < 255) AS translucent FROM px WHERE a > 0 GROUP BY image_id)"""


def _dispositions(pixels: DataFrame) -> DataFrame:
    masked = pixels.select("image_id").distinct().withColumn("masked", F.lit(True))
    return classify.classify_images(masked, pixels)


@query(_CLASS_SQL + " SELECT * FROM disp")
def classify_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispositions(inputs.pixels(spark, sf_dir))


@query(f"WITH {PIXELS_SQL}, {_PROFILE_SQL} SELECT * FROM prof")
def image_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.image_profiles(inputs.pixels(spark, sf_dir))


@query(_CLASS_SQL + f""", {_PROFILE_SQL},
hi AS (SELECT image_id FROM prof JOIN disp USING (image_id) WHERE disposition = 'low_alpha_raster' AND chromatic * 20 >= visible * 19 AND translucent
  AND greatest("right" - "left", bottom - top) >= 4 * greatest(1, least("right" - "left", bottom - top)))
SELECT image_id, x, y, r, g, b, CASE WHEN a > 0 AND image_id IN (SELECT image_id FROM hi) THEN 255 ELSE a END AS a FROM px""")
def opaque_highlighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.pixels(spark, sf_dir)
    return classify.make_opaque(pixels, _dispositions(pixels)).select("image_id", "x", "y", "r", "g", "b", "a")


_Q = "least(255, ({0} + 16) // 32 * 32)"
_STYLE = ", ".join(_Q.format(c) + f" AS {c}" for c in "rgb")


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT image_id, {_STYLE}, CASE WHEN a < 96 THEN 64 ELSE 255 END AS opacity FROM px WHERE a >= 88)
  SELECT image_id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, opacity, count(*) AS n FROM s GROUP BY ALL""")
def pixel_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.pixels(spark, sf_dir)
    style = colors.style(*(F.col(c) for c in "rgba"))
    return pixels.select("image_id", style.alias("s")).where("s IS NOT NULL").groupBy("image_id", "s.r", "s.g", "s.b", "s.opacity").agg(F.count("*").alias("n"))


#: Components by reachability; images are 8 x 8.
_LABELS_SQL = f"""WITH RECURSIVE {PIXELS_SQL},
v AS (SELECT *, y * 8 + x AS p FROM px WHERE a > 0),
near AS (SELECT a.image_id, a.p, b.p AS o FROM v a JOIN v b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach(image_id, p, o) AS (SELECT image_id, p, p FROM v UNION SELECT r.image_id, r.p, n.o FROM reach r JOIN near n ON r.image_id = n.image_id AND r.o = n.p),
root AS (SELECT image_id, p, min(o) AS root FROM reach GROUP BY ALL),
lab AS (SELECT v.*, CAST(dense_rank() OVER (PARTITION BY v.image_id ORDER BY root) AS INTEGER) AS label FROM v JOIN root USING (image_id, p))"""
_STATS_SQL = f"""{_LABELS_SQL},
packed AS (SELECT *, ({_Q.format('r')}) * 65536 + ({_Q.format('g')}) * 256 + ({_Q.format('b')}) AS color,
  (SELECT count(*) FROM px o WHERE o.image_id = lab.image_id AND abs(o.x - lab.x) + abs(o.y - lab.y) = 1 AND o.a >= 128) = 4 AS inner4 FROM lab),
stats AS (
  SELECT image_id, label, sum(a) AS ink, sum(CASE WHEN a < 88 THEN a ELSE 0 END) AS untraced, count(*) FILTER (a >= 128) AS covered,
    count(*) FILTER (a >= 128 AND NOT inner4) AS boundary, min(color) FILTER (a >= 88) AS low, max(color) FILTER (a >= 88) AS high FROM packed GROUP BY ALL),
peak AS (SELECT image_id, label, max(a) AS peak FROM lab GROUP BY ALL),
sig AS (
  SELECT p.*, peak, (SELECT count(*) FROM px o WHERE o.image_id = p.image_id AND abs(o.x - p.x) + abs(o.y - p.y) = 1 AND o.a >= (peak + 1) // 2) = 4 AS full4
  FROM packed p JOIN peak USING (image_id, label) WHERE a >= (peak + 1) // 2),
stroke AS (
  SELECT image_id, label, CASE WHEN max(peak) >= 48 AND 2 * count(*) < 3 * count(*) FILTER (NOT full4) AND min(color) = max(color) THEN min(color) END AS stroke_color FROM sig GROUP BY ALL),
kinds AS (
  SELECT image_id, label, CAST(ink AS BIGINT) AS ink, CAST(untraced AS BIGINT) AS untraced, covered, boundary, CASE WHEN low IS NULL THEN 0 WHEN low = high THEN 1 ELSE 2 END AS n_colors,
    CAST(CASE WHEN low = high THEN low END AS INTEGER) AS color, CAST(stroke_color AS INTEGER) AS stroke_color,
    CASE WHEN untraced > 0.25 * ink THEN CASE WHEN stroke_color IS NOT NULL THEN 'reconstructed' ELSE 'residual' END
      WHEN covered > 0 AND 2 * covered < 3 * boundary AND low = high THEN 'smooth' ELSE 'pixel' END AS kind
  FROM stats JOIN stroke USING (image_id, label))"""


@query(_LABELS_SQL + " SELECT image_id, x, y, r, g, b, a, label FROM lab")
def label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In tiles of 3 x 3, so that most components span several."""
    return components.label_components(inputs.pixels(spark, sf_dir), tile=3)


@query(_STATS_SQL + " SELECT * FROM kinds")
def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.component_kinds(components.cut(components.label_components(inputs.pixels(spark, sf_dir))))


@query(_STATS_SQL + """ SELECT image_id, kind AS part FROM kinds GROUP BY ALL
  UNION ALL SELECT DISTINCT image_id, 'pixel' FROM px WHERE image_id NOT IN (SELECT image_id FROM kinds)""")
def artwork_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = inputs.pixels(spark, sf_dir)
    return components.artwork_parts(pixels, components.component_kinds(components.cut(components.label_components(pixels))))


def _parts(spark: SparkSession, pixels: DataFrame, tile: int = components.TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    labeled = components.cut(components.label_components(pixels, tile))
    kinds = components.cut(components.component_kinds(labeled))
    return components.partition_artwork(labeled, kinds), kinds, inputs.image_sizes(pixels)


def _shape_rows(shapes: DataFrame) -> DataFrame:
    points = F.aggregate("path", F.lit(0), lambda n, c: n + F.size(c["segments"]) + 1)
    return shapes.select("image_id", "shape_seq", "color", "opacity", F.size("path").alias("contours"), points.alias("points"), "path")


@query()
def trace_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _, sizes = _parts(spark, inputs.pixels(spark, sf_dir))
    return _shape_rows(tracing.trace_pixels(parts.where("kind = 'pixel'"), sizes)[0])


@query()
def trace_large_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large images in tiles of 32: a row for each contour, or for an image's error."""
    pixels = inputs.large_pixels(spark, sf_dir)
    labeled = components.cut(components.label_components(pixels, 32))
    contours, errors = tracing.trace_contours(labeled, inputs.image_sizes(pixels), 32)
    points = F.size("contour.segments") + 1
    return contours.withColumn("points", points).unionByName(errors, allowMissingColumns=True)


@query()
def trace_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, kinds, sizes = _parts(spark, inputs.pixels(spark, sf_dir))
    return _shape_rows(tracing.trace_smooth(parts.where("kind = 'smooth'"), sizes, kinds)[0])


@query()
def trace_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, kinds, sizes = _parts(spark, inputs.pixels(spark, sf_dir))
    return _shape_rows(tracing.trace_strokes(parts.where("kind = 'reconstructed'"), sizes, kinds)[0])


@query(_STATS_SQL + f""", {_DISPOSITION_SQL},
own AS (SELECT image_id FROM disp WHERE disposition = 'trace'),
p AS (SELECT image_id, count(kind) AS n, count(*) FILTER (kind = 'residual') AS residual FROM own LEFT JOIN kinds USING (image_id) GROUP BY image_id)
SELECT image_id, CASE WHEN n > 0 THEN CASE WHEN residual = 0 THEN 'vector' WHEN residual = n THEN 'raster' ELSE 'mixed' END END AS prepared,
  CASE WHEN n = 0 THEN 'vector artwork contains no visible shapes' END AS error FROM p""")
def prepared_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are classified to be traced, from pixels to the union of their parts' shapes."""
    pixels = inputs.pixels(spark, sf_dir)
    own = components.cut(pixels.join(_dispositions(pixels).where("disposition = 'trace'").select("image_id"), "image_id", "left_semi"))
    parts, kinds, sizes = _parts(spark, own)
    return tracing.prepare_artwork(parts, kinds, sizes, own)[1]


@query()
def area_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _, _ = _parts(spark, inputs.pixels(spark, sf_dir))
    return tracing.area_levels(parts.where("kind = 'smooth'"))


@query(f"""WITH {PIXELS_SQL} SELECT image_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a FROM px GROUP BY image_id""")
def decode_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels packed into sample planes and decoded again."""
    own = inputs.pixels(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b", "a"))).alias("p"))
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    plane = lambda f: F.unhex(F.array_join(F.transform("p", f), ""))
    planes = own.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(3).alias("components"), plane(lambda s: F.concat(byte(s["r"]), byte(s["g"]), byte(s["b"]))).alias("color"), plane(lambda s: byte(s["a"])).alias("alpha"))
    decoded, _ = images.decode(planes)
    return decoded.groupBy("image_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "rgba"))


@query(f"""WITH {RENDERINGS_SQL} SELECT board_id, count(*) AS n, CAST(sum(x * 1000003 + y * 7919 + r) AS BIGINT) AS placed FROM pairs WHERE dpi = 18 GROUP BY board_id""")
def stitched_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference at 18 DPI cut into tiles of 4 x 16, and put together again."""
    whole = inputs.renderings(spark, sf_dir)[0].where("dpi = 18")
    tiled = whole.withColumns({"tile_x": (F.floor(F.col("x") / 4) * 4).cast("int"), "tile_y": (F.floor(F.col("y") / 16) * 16).cast("int")})
    found = evaluate.stitch(tiled.withColumns({"x": F.col("x") - F.col("tile_x"), "y": F.col("y") - F.col("tile_y")}))
    placed = F.col("x").cast("long") * 1000003 + F.col("y").cast("long") * 7919 + F.col("r")
    return found.groupBy("board_id").agg(F.count("*").alias("n"), F.sum(placed).alias("placed"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'PNG header is incomplete' WHEN o_orderkey % 5 = 1 THEN 'image does not have a PNG signature'
    WHEN o_orderkey % 5 = 2 THEN 'PNG does not start with an IHDR chunk' WHEN o_custkey % 10 = 0 THEN 'PNG dimensions must be positive' END AS error,
  CASE WHEN o_orderkey % 5 > 2 AND o_custkey % 10 > 0 THEN o_custkey % 10 END AS width, CASE WHEN o_orderkey % 5 > 2 AND o_custkey % 10 > 0 THEN o_orderkey + 1 END AS height FROM orders""")
def png_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("o_orderkey") % 5, lambda v: F.lpad(F.hex(v), 8, "0")
    head = F.concat(F.when(k == 1, "89504E470D0A1A0B").otherwise("89504E470D0A1A0A"), F.when(k == 2, "0000000D49484453").otherwise("0000000D49484452"), size(F.col("o_custkey") % 10), F.when(k == 0, "").otherwise(size(F.col("o_orderkey") + 1)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), images.png_size(F.unhex(head)).alias("s")).select("path", "s.error", "s.width", "s.height")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS image_id, CASE WHEN p_size % 6 = 0 THEN 'only 8-bit image components are supported' WHEN p_size % 7 = 0 THEN 'image Decode arrays are not supported'
  WHEN p_size % 5 = 0 THEN 'unsupported image color space' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'JPEG images with soft masks are not supported'
  WHEN p_partkey % 3 = 1 THEN 'unsupported image filter: LZWDecode' WHEN p_partkey % 2 = 0 AND p_partkey % 4 = 0 THEN 'SMask does not reference an image stream' END AS error FROM part""")
def admit_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.element_at(F.array(F.lit("DCTDecode"), F.lit("LZWDecode"), F.lit("FlateDecode")), (k % 3 + 1).cast("int"))
    mask = F.when((k % 2 == 0) & (k % 4 != 0), F.concat(k.cast("string"), F.lit("-mask"))).when(k % 4 == 0, "none")
    meta = p.select(k.cast("string").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(s % 6 == 0, 1).otherwise(8).alias("bits"), (s % 7 == 0).alias("has_decode"), F.when(s % 5 == 0, "indexed").otherwise("rgb").alias("space"), name.alias("filter"), mask.alias("mask_id"))
    masks = meta.where("mask_id LIKE '%-mask'").select(F.col("mask_id").alias("image_id"), "width", "height", F.lit(8).alias("bits"), F.lit(False).alias("has_decode"), F.lit("gray").alias("space"), F.lit("FlateDecode").alias("filter"), F.lit(None).cast("string").alias("mask_id"))
    return images.admit(meta.unionByName(masks)).where("image_id NOT LIKE '%-mask'").select("image_id", "error")


# Scenes

_VIOLATIONS_SQL = f"""WITH {SCENES_SQL},
viol AS (
  SELECT board_id, 1 AS rule FROM boards WHERE width <= 0 UNION ALL SELECT board_id, 2 FROM boards WHERE height <= 0
  UNION ALL SELECT board_id, 3 FROM assets WHERE twice UNION ALL SELECT board_id, 4 FROM assets, range(CASE WHEN twice THEN 2 ELSE 1 END) WHERE width <= 0
  UNION ALL SELECT n.board_id, 5 FROM nodes n WHERE kind = 'image' AND (board_id, asset_id) NOT IN (SELECT (board_id, asset_id) FROM assets)
  UNION ALL SELECT a.board_id, 6 FROM assets a, range(CASE WHEN twice THEN 2 ELSE 1 END) WHERE (board_id, asset_id) NOT IN (SELECT (board_id, asset_id) FROM nodes WHERE kind = 'image')
  UNION ALL SELECT board_id, 8 FROM nodes WHERE CASE WHEN kind = 'image' THEN opacity > 1 ELSE w <= 0 OR h <= 0 END
  UNION ALL SELECT n.board_id, 9 FROM nodes n JOIN boards b USING (board_id) WHERE kind = 'image' AND 1 / a BETWEEN -1e-9 AND 1 + 1e-9 AND (b.width + 1) / a BETWEEN -1e-9 AND 1 + 1e-9 AND 1 / d BETWEEN -1e-9 AND 1 + 1e-9 AND (b.height + 1) / d BETWEEN -1e-9 AND 1 + 1e-9)"""


@query(_VIOLATIONS_SQL + " SELECT board_id, rule, count(*) AS n FROM viol GROUP BY ALL")
def scene_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(*inputs.scenes(spark, sf_dir))


_MESSAGES = ", ".join("'" + m.replace("'", "''") + "'" for m in validate.MESSAGES)


@query(_VIOLATIONS_SQL + f""", f AS (SELECT board_id, min(rule) AS rule FROM viol GROUP BY board_id)
SELECT board_id, CASE WHEN rule IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN rule IS NOT NULL THEN 'invalid_scene' END AS error_kind,
  [{_MESSAGES}][rule] AS error_message FROM boards LEFT JOIN f USING (board_id)""")
def validate_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_scenes(*inputs.scenes(spark, sf_dir))


@query(f"""WITH {SCENES_SQL}, c AS (SELECT board_id, count(*) FILTER (kind = 'image') AS i, count(*) FILTER (kind = 'link') AS l FROM nodes GROUP BY ALL),
f AS (SELECT board_id, CAST(sum(CASE WHEN twice THEN 2 ELSE 1 END) AS BIGINT) AS n FROM assets GROUP BY ALL)
SELECT board_id, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, coalesce(n, 0) AS assets, coalesce(i, 0) AS image_nodes, CAST(0 AS BIGINT) AS vector_artwork_nodes,
  CAST(0 AS BIGINT) AS path_nodes, CAST(0 AS BIGINT) AS text_nodes, coalesce(l, 0) AS link_nodes, CAST(0 AS BIGINT) AS svg_document_nodes FROM boards LEFT JOIN f USING (board_id) LEFT JOIN c USING (board_id)""")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.scene_summary(*inputs.scenes(spark, sf_dir))


@query(f"""WITH {SCENES_SQL} SELECT board_id, asset_id FROM assets a, range(CASE WHEN twice THEN 2 ELSE 1 END) WHERE (board_id, asset_id) IN (SELECT (board_id, asset_id) FROM nodes WHERE kind = 'image')""")
def used_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, assets, nodes = inputs.scenes(spark, sf_dir)
    return sinks.used_assets(assets, nodes).select("board_id", "asset_id")


@query(_VIOLATIONS_SQL + " SELECT board_id, count(*) AS n FROM nodes WHERE board_id IN (SELECT board_id FROM boards) AND board_id NOT IN (SELECT board_id FROM viol) GROUP BY board_id")
def publishable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards, assets, nodes = inputs.scenes(spark, sf_dir)
    gate = validate.validate_scenes(boards, assets, nodes).select("board_id", (F.col("status") == "ok").alias("passed"))
    return sinks.publishable(nodes, gate).groupBy("board_id").agg(F.count("*").alias("n"))


@query(_VIOLATIONS_SQL + " SELECT board_id, count(*) AS n FROM nodes WHERE board_id IN (SELECT board_id FROM boards) AND board_id NOT IN (SELECT board_id FROM viol) GROUP BY board_id")
def published_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that pass, published as JSON; those with images published again; and read back."""
    boards, assets, nodes = inputs.scenes(spark, sf_dir)
    gate = validate.validate_scenes(boards, assets, nodes).select("board_id", (F.col("status") == "ok").alias("passed"))
    path = new_path(spark)
    # Read by both publications, several times each, so the boards are validated once.
    passed = components.cut(sinks.publishable(nodes, gate))
    sinks.publish(passed, path, buckets=8)
    again = passed.join(passed.where("kind = 'image'").select("board_id").distinct(), "board_id", "left_semi")
    sinks.publish(again, path)
    written = sinks.published(spark, path)
    return written.where("json LIKE '{%}'").groupBy("board_id").agg(F.count("*").alias("n"))


_SCENE_JSON_SQL = f"""WITH {SCENES_SQL},
num AS (SELECT board_id, kind, asset_id, a, CAST(d AS DOUBLE) AS d, CAST(opacity AS DOUBLE) AS opacity, CAST(w AS DOUBLE) AS w, h, node_seq FROM nodes),
txt AS (SELECT board_id, node_seq, CASE WHEN kind = 'image' THEN '{{{{"kind":"image","asset_id":"' || asset_id || '","matrix":{{{{"a":' || a || ',"b":0.0,"c":0.0,"d":' || d || ',"e":-1.0,"f":-1.0}}}},"opacity":' || opacity || '}}}}'
  ELSE '{{{{"kind":"link","bounds":{{{{"x":0.0,"y":0.0,"width":' || w || ',"height":' || h || '}}}}}}}}' END AS j FROM num),
c AS (SELECT board_id, string_agg(j, ',' ORDER BY node_seq) AS content FROM txt GROUP BY board_id),
twice AS (SELECT board_id, asset_id, width FROM assets, range(CASE WHEN twice THEN 2 ELSE 1 END)),
f AS (SELECT board_id, string_agg('{{{{"asset_id":"' || asset_id || '","file":"assets/' || asset_id || '.png","width":' || width || ',"height":8}}}}', ',' ORDER BY asset_id) AS files FROM twice GROUP BY board_id)
SELECT board_id, '{{{{"width":' || CAST(width AS DOUBLE) || ',"height":' || CAST(height AS DOUBLE) || ',"assets":[' || coalesce(files, '') || '],"content":[' || coalesce(content, '') || ']}}}}' AS json
FROM boards LEFT JOIN f USING (board_id) LEFT JOIN c USING (board_id)""".replace("{{", "{").replace("}}", "}")


@query(_SCENE_JSON_SQL)
def scene_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.scene_json(*inputs.scenes(spark, sf_dir))


# URLs of pages, most of them replaced by ones of each kind

_URLS = {
    0: "'https://games.example.org/arcade/#/games/a-b%20' || k", 1: "'https://youtu.be/' || lpad(k, 11, 'x')", 2: "'https://www.youtube.com/watch?a=1&v=' || lpad(k, 11, '_') || '&v=z'",
    3: "'http://m.YouTube.com/shorts/' || lpad(k, 10, 'y')", 4: "'https://youtube.com/embed/' || lpad(k, 11, '-') || '/x'", 5: "'ftp://example.org/' || k", 6: "'/relative/' || k",
    7: "'https://example.org/%zz' || k", 8: "'https://example.org/a b' || k", 9: "'https://games.example.org:443/arcade/#/games/' || k",
}
_URL = "CASE page_id % 12 " + " ".join(f"WHEN {i} THEN {u}" for i, u in _URLS.items()) + " ELSE url END"


#: What each URL is, by its text alone.
_PARTS_SQL = f"""urls AS (SELECT page_id, {_URL} AS url FROM (SELECT page_id, url, CAST(page_id AS VARCHAR) AS k FROM pages)),
cut AS (
  SELECT *, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9._~:/?#@!$&()*+,;=-]|%[0-9A-Fa-f][0-9A-Fa-f])*') AS legal, regexp_extract(url, '^([^:]*):', 1) AS scheme,
    lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS pairs, regexp_extract(url, '#(.*)$', 1) AS fragment FROM urls),
vid AS (
  SELECT *, CASE WHEN NOT legal THEN 'invalid URI: ' || url WHEN scheme NOT IN ('http', 'https') THEN 'unsupported URI scheme: ' || url END AS error,
    scheme = 'https' AND host = 'games.example.org' AND path = '/arcade/' AND fragment LIKE '/games/_%' AS game,
    CASE WHEN host = 'youtu.be' THEN regexp_extract(path, '^/*([^/]*)', 1) WHEN host NOT IN ('youtube.com', 'www.youtube.com', 'm.youtube.com') THEN ''
      WHEN path = '/watch' THEN regexp_extract('&' || pairs, '&v=([^&]*)', 1) ELSE regexp_extract(path, '^/(shorts|embed)/([^/]*)', 2) END AS v FROM cut),
told AS (
  SELECT page_id, url, error, CASE WHEN error IS NOT NULL THEN NULL WHEN game THEN 'game' WHEN regexp_full_match(v, '[A-Za-z0-9_-]{{{{11}}}}') THEN 'video' ELSE 'external' END AS kind, v, fragment FROM vid)""".replace("{{", "{").replace("}}", "}")
_LINKS_SQL = f"""{_PARTS_SQL},
good AS (SELECT CAST(page_id % 40 AS VARCHAR) AS board_id, page_id, kind FROM told
  WHERE page_id % 9 <> 0 AND page_id % 19 <> 0 AND page_id % 17 <> 0 AND error IS NULL AND page_id % 40 IN (SELECT user_id FROM events))"""


# Operator streams

@query(f"""WITH {STREAMS_SQL},
d AS (SELECT *, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY board_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS depth FROM ops)
SELECT board_id, CASE WHEN min(depth) < 0 THEN 'Q tried to restore an empty graphics-state stack' WHEN arg_max(depth, seq) <> 0 THEN 'content stream ended before every q had a matching Q' END AS error
FROM d GROUP BY board_id""")
def stream_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret.check_streams(inputs.operator_streams(spark, sf_dir))


@query(f"""WITH {STREAMS_SQL},
p AS (SELECT board_id, op, coalesce(sum(CASE WHEN op IN ('S', 'f', 'n') THEN 1 ELSE 0 END) OVER (PARTITION BY board_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path_no FROM ops)
SELECT board_id, CAST(path_no AS BIGINT) AS path_no, count(*) AS n FROM p WHERE op = 're' GROUP BY ALL""")
def stream_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = interpret.path_numbers(inputs.operator_streams(spark, sf_dir))
    return numbered.where("op = 're'").groupBy("board_id", "path_no").agg(F.count("*").alias("n"))


def _interpreted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boards, *rest = inputs.stream_inputs(spark, sf_dir)
    return interpret.interpret(inputs.operator_streams(spark, sf_dir), boards, *rest)


#: Boards with an error have no nodes; the state that stays is counted before each event of the others.
_NODES_SQL = f"""WITH {STREAMS_SQL}, named AS (
  SELECT board_id, seq, op, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY board_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS depth FROM ops),
ids AS (SELECT CAST(user_id AS VARCHAR) AS board_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 8 + 5 AS seq, event_id, user_id FROM events),
bad AS (
  SELECT board_id, seq, 'graphics_state' AS error_kind, 'Q tried to restore an empty graphics-state stack' AS error_message FROM named WHERE depth < 0
  UNION ALL SELECT board_id, seq, 'invalid_structure', 'missing image resource Im3' FROM ids WHERE user_id % 13 = 0 AND event_id % 23 = 5 AND event_id % 4 = 3
  UNION ALL SELECT board_id, 9223372036854775807, 'graphics_state', 'content stream ended before every q had a matching Q' FROM named GROUP BY board_id HAVING arg_max(depth, seq) <> 0),
st AS (
  SELECT *, coalesce(sum(CASE WHEN k >= 11 THEN 1 ELSE 0 END) OVER b, 0) AS steps, coalesce(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER b, 0) > 0 AS half,
    last_value(CASE WHEN s = 2 THEN v % 4 + 1 END IGNORE NULLS) OVER b AS w, last_value(CASE WHEN s = 3 THEN v % 3 + 1 END IGNORE NULLS) OVER b AS dash,
    last_value(CASE WHEN s = 4 THEN v % 5 + 1 END IGNORE NULLS) OVER b AS miter
  FROM e WHERE board_id NOT IN (SELECT board_id FROM bad)
  WINDOW b AS (PARTITION BY board_id ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (
  SELECT board_id, base + 3 AS op_seq, 0 AS sub_seq, 'path' AS kind, CAST(NULL AS VARCHAR) AS asset_id, CAST(NULL AS VARCHAR) AS href, CASE WHEN k % 3 = 0 THEN pow(2, steps + 1) ELSE 1 END AS grown, half, w, dash, miter
  FROM st WHERE k % 3 < 2
  UNION ALL SELECT board_id, base + 5, 0, CASE WHEN event_id % 4 IN (1, 2) THEN 'vector-artwork' ELSE 'image' END, CASE WHEN event_id % 4 IN (0, 3) THEN 'Im' || event_id % 4 END, CASE WHEN event_id % 4 IN (1, 2) THEN 'Im' || event_id % 4 END, NULL, half, NULL, NULL, NULL FROM st WHERE k = 5
  UNION ALL SELECT board_id, base + 5, 1, 'image', 'Im2', NULL, NULL, half, NULL, NULL, NULL FROM st WHERE k = 5 AND event_id % 4 = 2)"""


@query(_NODES_SQL + """ SELECT board_id, op_seq, sub_seq, kind, asset_id, href, CASE WHEN half THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS opacity,
  CASE WHEN kind = 'path' THEN CAST(grown * coalesce(w, 1) AS DOUBLE) END AS line_width, CASE WHEN kind = 'path' THEN CAST(coalesce(miter, 10) AS DOUBLE) END AS miter_limit,
  CASE WHEN kind = 'path' AND dash IS NOT NULL THEN CAST(grown * dash AS DOUBLE) END AS dash FROM n""")
def interpret_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, style = _interpreted(spark, sf_dir)[0], F.col("style")
    own = {"opacity": F.coalesce(style["opacity"], "opacity"), "line_width": style["line_width"], "miter_limit": style["miter_limit"], "dash": F.try_element_at(style["dash"], F.lit(1))}
    return nodes.select("board_id", "op_seq", "sub_seq", "kind", "asset_id", "href", *(c.alias(n) for n, c in own.items()))


@query(f"""WITH {STREAMS_SQL}, named AS (
  SELECT board_id, seq, op, sum(CASE op WHEN 'q' THEN 1 WHEN 'Q' THEN -1 ELSE 0 END) OVER (PARTITION BY board_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS depth FROM ops),
ids AS (SELECT CAST(user_id AS VARCHAR) AS board_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 8 + 5 AS seq, event_id, user_id FROM events),
bad AS (
  SELECT board_id, seq, 'graphics_state' AS error_kind, 'Q tried to restore an empty graphics-state stack' AS error_message FROM named WHERE depth < 0
  UNION ALL SELECT board_id, seq, 'invalid_structure', 'missing image resource Im3' FROM ids WHERE user_id % 13 = 0 AND event_id % 23 = 5 AND event_id % 4 = 3
  UNION ALL SELECT board_id, 9223372036854775807, 'graphics_state', 'content stream ended before every q had a matching Q' FROM named GROUP BY board_id HAVING arg_max(depth, seq) <> 0)
SELECT board_id, arg_min(error_kind, seq) AS error_kind, arg_min(error_message, seq) AS error_message FROM bad GROUP BY board_id""")
def interpret_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interpreted(spark, sf_dir)[1]


@query(_NODES_SQL + """ SELECT board_id, op_seq, sub_seq, kind, CASE WHEN kind = 'vector-artwork' THEN 1 END AS shapes, CASE WHEN kind = 'vector-artwork' THEN CAST(pow(2, steps) AS DOUBLE) END AS across
  FROM n JOIN (SELECT board_id AS sb, base, steps FROM st) ON sb = board_id AND base = op_seq // 8 * 8""")
def place_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector or mixed placement gets a copy of its resource's triangle, as wide as the matrix says."""
    _, resources, *_ = inputs.stream_inputs(spark, sf_dir)
    found = interpret.place_shapes(_interpreted(spark, sf_dir)[0], _unit_shapes(resources))
    first = F.col("shapes")[0]["path"]
    return found.select("board_id", "op_seq", "sub_seq", "kind", F.when(F.col("shapes").isNotNull(), F.size("shapes")).alias("shapes"), F.abs(first[1]["end"]["x"] - first[0]["end"]["x"]).alias("across"))


@query()
def build_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams and links to validated scenes."""
    boards, resources, alphas, spaces = inputs.stream_inputs(spark, sf_dir)
    nodes, errors = interpret.interpret(inputs.operator_streams(spark, sf_dir), boards, resources, alphas, spaces)
    ends, _ = link_nodes.extract_links(_annotations(spark, sf_dir), boards, RULE)
    # Validated, counted and summed up from one table; clips are told finite or not by the fold and read by none of these.
    scene = components.cut(interpret.scene_nodes(interpret.place_shapes(nodes, _unit_shapes(resources)), ends).drop("clips"))
    assets = resources.where("asset_id IS NOT NULL").select("board_id", "asset_id", F.concat(F.lit("assets/"), "asset_id", F.lit(".png")).alias("file"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    used = sinks.used_assets(assets, scene)
    status = validate.validate_scenes(boards, used, scene)
    return status.join(errors.select("board_id", F.col("error_message").alias("stream_error")), "board_id", "left").join(summary.scene_summary(boards, used, scene), "board_id")


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, unnest(range(4)) AS i FROM u)
SELECT CAST(user_id AS VARCHAR) AS board_id, 'Im' || i AS name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) AS INTEGER) AS position FROM r WHERE NOT (user_id % 13 = 0 AND i = 3)""")
def resource_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each resource among its board's as they're written."""
    found = sinks.by_name(inputs.stream_inputs(spark, sf_dir)[1])
    return found.withColumn("position", F.row_number().over(Window.partitionBy("board_id").orderBy("name"))).select("board_id", "name", "position")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN w END AS width, CASE WHEN w > 0 AND h > 0 THEN h END AS height, CASE WHEN NOT (w > 0 AND h > 0) THEN 'page dimensions must be positive' END AS error
FROM (SELECT *, CAST(l_partkey % 700 - l_suppkey AS DOUBLE) AS w, l_quantity - l_linenumber AS h FROM lineitem)""")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(F.col("l_suppkey").cast("double"), F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 700).cast("double"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", geometry.page_size(box).alias("p")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p.*")


def _unit_shapes(resources: DataFrame) -> DataFrame:
    """A triangle for each traced resource."""
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    none = F.lit(None).cast("struct<x:double,y:double>")
    line = lambda p: F.struct(none.alias("first"), none.alias("second"), p.alias("end"))
    path = F.array(F.struct(at(0.0, 0.0).alias("start"), F.array(line(at(1.0, 0.0)), line(at(0.0, 1.0))).alias("segments")))
    black = F.struct(*(F.lit(0.0).alias(c) for c in "rgb"))
    return resources.where("kind <> 'raster'").select("board_id", F.col("name").alias("resource"), F.lit(0).alias("shape_seq"), path.alias("path"), black.alias("color"), F.lit(1.0).alias("opacity"))


@query(f"""WITH {STREAMS_SQL}, o AS (SELECT board_id, count(*) AS operators FROM ops GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events), {_LINKS_SQL}, k AS (SELECT board_id, count(*) AS links FROM good GROUP BY board_id),
r AS (SELECT user_id, CASE WHEN user_id % 13 = 0 THEN 3 ELSE 4 END AS images, 2 AS vectors, CASE WHEN user_id % 13 = 0 THEN 2 ELSE 3 END AS rasters FROM u)
SELECT CAST(user_id AS VARCHAR) AS board_id, CASE WHEN user_id % 10 = 0 THEN 2 ELSE 1 END AS pages, operators, CAST(images AS BIGINT) AS images, CAST(vectors AS BIGINT) AS vectors, CAST(rasters AS BIGINT) AS rasters, coalesce(links, 0) AS links,
  CASE WHEN user_id % 10 <> 0 THEN printf('File: %d.pdf\nFormat: PDF\nPages: 1\nBoard: 200.0 x 100.0 pt\nOperators: %d\nImages: %d\nVector artworks: 2\nRaster images: %d\nLinks: %d\n', user_id, operators, images, rasters, coalesce(links, 0)) END AS summary,
  CASE WHEN user_id % 10 = 0 THEN 'PDF must contain exactly one page, found 2' END AS error FROM r JOIN o ON o.board_id = CAST(user_id AS VARCHAR) LEFT JOIN k ON k.board_id = o.board_id""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards, resources, *_ = inputs.stream_inputs(spark, sf_dir)
    docs = boards.withColumns({"file": F.concat("board_id", F.lit(".pdf")), "pages": F.when(F.col("board_id").cast("long") % 10 == 0, 2).otherwise(1)})
    found, _ = link_nodes.extract_links(_annotations(spark, sf_dir), boards, RULE)
    return summary.document_summary(docs, inputs.operator_streams(spark, sf_dir), resources, found)


# Links, texts and sources

def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", "CAST(page_id AS STRING) AS k").select("page_id", F.expr(_URL).alias("url"))


@query(f"""WITH {_PARTS_SQL} SELECT page_id, kind, CASE WHEN kind = 'video' THEN v END AS video_id, CASE WHEN kind <> 'video' THEN url END AS url, error FROM told""")
def classify_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", links.classify(F.col("url"), RULE).alias("t")).select("page_id", "t.*")


@query(f"""WITH {_PARTS_SQL} SELECT page_id, 'Play ' || replace(replace(substr(fragment, 8), '%20', ' '), '-', ' ') || ' in Example Arcade' AS label FROM told WHERE kind = 'game'""")
def game_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).where(links.is_game(F.col("url"), RULE)).select("page_id", links.game_label(F.col("url"), RULE).alias("label"))


@query(f"""WITH {_PARTS_SQL} SELECT page_id, 'https://www.youtube-nocookie.com/embed/' || v || '?autoplay=1' AS embed FROM told WHERE kind = 'video'""")
def video_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(spark, sf_dir).withColumn("video", links.video_id(F.col("url"))).where("video IS NOT NULL")
    return rows.select("page_id", links.embed_url(F.col("video")).alias("embed"))


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _urls(spark, sf_dir)
    k = F.col("page_id")
    rect = F.when(k % 17 == 0, F.array(F.lit(1.0))).otherwise(F.array((k % 90).cast("double"), F.lit(40.0), F.lit(10.0), F.lit(70.0)))
    return u.select((k % 40).cast("string").alias("board_id"), k.alias("annot_seq"), F.when(k % 9 == 0, "Text").otherwise("Link").alias("subtype"), F.when(k % 19 == 0, "GoTo").otherwise("URI").alias("action"), F.encode("url", "UTF-8").alias("uri"), rect.alias("rect"))


@query(f"""WITH {_LINKS_SQL} SELECT board_id, page_id AS annot_seq, kind, CAST(least(page_id % 90, 10) AS DOUBLE) AS x, CAST(30 AS DOUBLE) AS y, CAST(abs(page_id % 90 - 10) AS DOUBLE) AS width, CAST(30 AS DOUBLE) AS height FROM good""")
def link_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards, *_ = inputs.stream_inputs(spark, sf_dir)
    found, _ = link_nodes.extract_links(_annotations(spark, sf_dir), boards, RULE)
    return found.select("board_id", "annot_seq", "target.kind", "bounds.x", "bounds.y", "bounds.width", "bounds.height")


@query("""WITH t AS (SELECT doc_id, regexp_replace('  ' || text || chr(10), '^[\\t-\\r\\p{Zs}]+|[\\t-\\r\\p{Zs}]+$', '', 'g') AS title FROM documents)
SELECT doc_id, title, CASE WHEN title = '' THEN 'site title must not be empty' WHEN regexp_matches(title, '\\p{Cc}') THEN 'site title must not contain control characters' END AS error FROM t""")
def site_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "text", F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", text.trimmed(F.col("raw")).alias("title"), text.title_error(F.col("raw")).alias("error"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT page_id, md5({_ESCAPED.format('html')}) AS escaped FROM pages")
def escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


@query(f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '{{{{SITE_ARIA_LABEL}}}}' ELSE '<' || p_name || '>' END AS title FROM part)
SELECT p_partkey, '<title>' || {_ESCAPED.format('title')} || '</title><a aria-label="' || {_ESCAPED.format("'Zoomable page: ' || title")} || '">' AS page FROM t""")
def render_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 4 == 0, "{{SITE_ARIA_LABEL}}").otherwise(F.concat(F.lit("<"), "p_name", F.lit(">")))
    page = text.render_template(F.lit('<title>{{SITE_TITLE}}</title><a aria-label="{{SITE_ARIA_LABEL}}">'), title)
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page"))


@query("""SELECT page_id, contains(regexp_extract(marked, '(?s)<body([^>]*)', 1), 'data-ready="true"') AS ready
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(html, '<body>', '<body class="x" data-ready="true">') WHEN 1 THEN replace(html, '<body>', '<body><i data-ready="true">') ELSE html END AS marked FROM pages)""")
def ready_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page's body tag gets the mark; in every other third the mark comes after the tag."""
    k = F.col("page_id") % 3
    marked = F.when(k == 0, F.replace("html", F.lit("<body>"), F.lit('<body class="x" data-ready="true">'))).when(k == 1, F.replace("html", F.lit("<body>"), F.lit('<body><i data-ready="true">'))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.body_is_ready(marked).alias("ready"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey - 1000) / 512.0 AS x, l_suppkey / 8.0 AS y FROM lineitem),
r AS (SELECT *, round_even(x * 1000, 0) / 1000 AS rx, round_even(y * 1000, 0) / 1000 AS ry FROM v)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'M' || CASE WHEN rx = 0 THEN '0' ELSE rtrim(rtrim(printf('%.3f', CAST(rx AS DOUBLE)), '0'), '.') END || ',' || CASE WHEN ry = 0 THEN '0' ELSE rtrim(rtrim(printf('%.3f', CAST(ry AS DOUBLE)), '0'), '.') END || 'L1,2Z' AS path
FROM r""")
def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    start = geometry.point((F.col("l_partkey") - 1000) / 512.0, F.col("l_suppkey") / 8.0)
    path = F.array(geometry.command("move", start), geometry.command("line", geometry.point(F.lit(1), F.lit(2))), geometry.command("close"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.path_data(path).alias("path"))


_SOURCES_SQL = """m AS (SELECT p_brand AS root, '/boards/' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '/build/' ELSE '/notes/' END || p_partkey ||
    CASE WHEN p_partkey % 97 = 0 THEN '.PDF' WHEN p_partkey % 89 = 0 THEN '.svg' ELSE '.png' END AS path, p_partkey % 11 = 0 AS is_symlink FROM part),
s AS (SELECT root, path, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'svg' END AS format FROM m WHERE NOT is_symlink AND path NOT LIKE '%/build/%' AND lower(path) SIMILAR TO '.*\\.(pdf|svg)')"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/boards/"), "p_brand", F.when(F.col("p_partkey") % 7 == 0, "/build/").otherwise("/notes/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 97 == 0, ".PDF").when(F.col("p_partkey") % 89 == 0, ".svg").otherwise(".png"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("root"), path.alias("path"), (F.col("p_partkey") % 11 == 0).alias("is_symlink"))


@query(f"WITH {_SOURCES_SQL} SELECT * FROM s")
def discover_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discover(_manifest(spark, sf_dir))


@query(f"""WITH {_SOURCES_SQL}, c AS (SELECT r.root, count(s.path) AS n, min(s.path) AS path, min_by(s.format, s.path) AS format FROM (SELECT DISTINCT root FROM m) r LEFT JOIN s USING (root) GROUP BY ALL)
SELECT root, CASE WHEN n = 1 THEN path END AS path, CASE WHEN n = 1 THEN format END AS format, CASE WHEN n <> 1 THEN 'expected exactly one PDF or SVG source file, found ' || n END AS error FROM c""")
def single_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir)
    return discovery.single_source(manifest, discovery.discover(manifest))


# Geometry and colors

@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 2 AS a, CAST(l_linenumber * 3 AS DOUBLE) AS d, CAST(l_suppkey * 2 + 4 AS DOUBLE) AS e, CAST(l_partkey * 3 + 5 AS DOUBLE) AS f,
  CAST(2 * l_partkey + 4 AS DOUBLE) AS px, CAST(95 - 3 * l_suppkey AS DOUBLE) AS py FROM lineitem""")
def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    m = geometry.matrix(F.col("l_quantity"), F.lit(0), F.lit(0), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"))
    n = geometry.matrix(F.lit(2), F.lit(0), F.lit(0), F.lit(3), F.lit(4), F.lit(5))
    p = geometry.to_board(geometry.apply(n, geometry.point(F.col("l_partkey"), F.col("l_suppkey"))), F.lit(100.0))
    return rows.withColumns({"m": geometry.multiply(m, n), "p": p}).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "m.a", "m.d", "m.e", "m.f", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, -CAST(p_partkey AS DOUBLE) AS b, CAST(-3 AS DOUBLE) AS c, CAST(4 AS DOUBLE) AS d, CAST(5 + 3 AS DOUBLE) AS e, CAST(100 - 6 + -4 AS DOUBLE) AS f,
  CASE WHEN p_size = 4 AND p_partkey = 3 THEN 5.0 END AS scale, 2.0 * p_size AS area FROM part""".replace("CASE WHEN p_size = 4 AND p_partkey = 3 THEN 5.0 END AS scale", "CASE WHEN p_size > 0 THEN CAST(p_size AS DOUBLE) END AS scale").replace("2.0 * p_size AS area", "CAST(2 * p_size AS DOUBLE) AS area"))
def image_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geometry.matrix(F.col("p_size"), F.col("p_partkey"), F.lit(3), F.lit(4), F.lit(5), F.lit(6))
    shown = geometry.image_matrix(geometry.board_matrix(m, F.lit(100.0)))
    turn = geometry.matrix(F.lit(0), F.col("p_size"), -F.col("p_size"), F.lit(0), F.lit(1), F.lit(2))
    square = F.array(*(geometry.point(x, y) for x, y in ((F.lit(0), F.lit(0)), (F.col("p_size"), F.lit(0)), (F.col("p_size"), F.lit(1)), (F.lit(0), F.lit(1)))))
    rows = table(spark, sf_dir, "part").withColumn("m", shown)
    return rows.select("p_partkey", "m.*", geometry.similarity_scale(turn).alias("scale"), geometry.signed_area(square).alias("area"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 40 THEN 1 - least(1, p_size / 64.0 + 0.25) END AS r, CASE WHEN p_size <= 40 THEN 1 - least(1, 0.5 + 0.25) END AS g FROM part""".replace("p_size / 64.0 + 0.25", "CAST(p_size AS DOUBLE) / 64 + CAST(0.25 AS DOUBLE)").replace("1 - least(1, 0.5 + 0.25) END AS g", "CAST(0.25 AS DOUBLE) END AS g"))
def cmyk_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("p_size") <= 40, F.col("p_size") / 64.0).otherwise(2.0)
    rows = table(spark, sf_dir, "part").withColumn("c", colors.from_cmyk(c, F.lit(0.5), F.lit(0.0), F.lit(0.25)))
    return rows.select("p_partkey", "c.r", "c.g")


# Markup

_SVG = "'<svg xmlns=\"http://www.w3.org/2000/svg\" xmlns:l=\"http://www.w3.org/1999/xlink\" width=\"' || {w} || '\" height=\"1in\">' || {body} || '</svg>'"
_BODIES = (
    ("<g/>", None), ("<script/>", "SVG scripts are not supported"), ("<g ONclick=\"x\"/>", "SVG event handler attributes are not supported"), ("<a/>", "SVG hyperlinks are not supported"),
    ("<image href=\"x.png\"/>", "SVG references an external resource: x.png"), ("<image l:href=\"DATA:image/png,x\"/>", None), ("<use href=\"data:x\"/>", "SVG use elements must reference an element in the same file"),
    ("<rect fill=\"URL( ''p.svg#a'' )\"/>", "SVG references an external resource: p.svg#a"), ("<style>a{b:url(#c)} @imp<!-- -->ort x</style>", "SVG stylesheets must not import other stylesheets"),
    ("<rect fill=\"url(data:x#y)\"/>", "SVG CSS references must not point into a data URI"), ("<g>", "malformed"), ("<?xml-stylesheet href=\"x\"?>", "external SVG stylesheets are not supported"),
)
_BODY = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (b, _) in enumerate(_BODIES)) + " END"


def _svgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark joins adjacent literals, so a quote in one is written as a backslash and a quote.
    body = _BODY.replace("''", "\\'")
    whole = _SVG.format(w="concat(CAST(p_size AS STRING), 'pt')", body=body)
    # Parts are a few bytes each: a file that Spark reads in one task gives far more markup than a task should have.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(F.col("p_partkey").cast("string").alias("doc_id"), F.encode(F.expr(whole), "UTF-8").alias("content"))


_SAYS = "CASE CAST(doc_id AS BIGINT) % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(_BODIES) if m) + " END"


@query(f"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, p_size FROM part), s AS (SELECT *, {_SAYS} AS m FROM d)
SELECT doc_id, CASE WHEN m IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN m = 'malformed' THEN 'invalid_svg' WHEN m IS NOT NULL THEN 'unsupported_svg' END AS error_kind, m AS message,
  CASE WHEN m IS NULL THEN CAST(p_size AS DOUBLE) * (CAST(96 AS DOUBLE) / 72) END AS width, CASE WHEN m IS NULL THEN CAST(96 AS DOUBLE) END AS height FROM s""")
def audit_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.audit_markup(markup.tokenize_markup(_svgs(spark, sf_dir)))
    message = F.when(F.col("error_kind") == "invalid_svg", "malformed").otherwise(F.col("error_message"))
    return found.select("doc_id", "status", "error_kind", message.alias("message"), "width", "height")


@query(f"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id FROM part), s AS (SELECT {_SAYS} AS m FROM d WHERE {_SAYS} <> 'malformed') SELECT 'unsupported_svg' AS kind, m AS message, count(*) AS n, count(*) AS docs FROM s GROUP BY m""")
def markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.rule_counts(markup.tokenize_markup(_svgs(spark, sf_dir))).where("kind = 'unsupported_svg'")


@query()
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as markup: hardly any is well-formed XML, and each gets its own status."""
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    return markup.audit_markup(markup.tokenize_markup(docs))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)url\\([^)]*\\)')) AS INTEGER) AS urls, contains(lower(html), '@import') AS imports FROM pages""")
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(markup.css_targets(F.col("html"))).alias("urls"), F.contains(F.lower("html"), F.lit("@import")).alias("imports"))


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS board_id, 'data:image/svg+xml;base64,' || to_base64(encode({_SVG.format(w="p_size || 'pt'", body=_BODY)})) AS href FROM part WHERE p_partkey % 12 IN (0, 5)""")
def svg_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _svgs(spark, sf_dir)
    return markup.svg_nodes(docs, markup.audit_markup(markup.tokenize_markup(docs))).select("board_id", "href")
