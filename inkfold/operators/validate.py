"""Scene validation: checks in order, the first that fails names a board's error.

boards(board_id, width, height); assets(board_id, asset_id, file, width, height); nodes(board_id, node_seq, kind, asset_id,
matrix, opacity, clips, commands, style, shapes, text, target, bounds, href), payloads null by kind. Where nodes have a column
clips_finite, it stands for the check of clips, which then aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import COVERAGE_TOLERANCE

#: The tolerance of a board's cover is one of so many parts of an image's side.
PARTS = round(1 / COVERAGE_TOLERANCE)

POINT = "struct<x:double,y:double>"
COMMANDS = f"array<struct<kind:string,first:{POINT},second:{POINT},end:{POINT}>>"
COLOR = "struct<r:double,g:double,b:double>"
MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
CLIPS = f"array<struct<rule:string,commands:{COMMANDS}>>"
STYLE = f"struct<fill:{COLOR},fill_rule:string,stroke:{COLOR},line_width:double,miter_limit:double,dash:array<double>,dash_phase:double,opacity:double>"
SHAPES = f"array<struct<path:{COMMANDS},color:{COLOR},opacity:double>>"
RECT = "struct<x:double,y:double,width:double,height:double>"
NODE_FIELDS = f"kind string, asset_id string, matrix {MATRIX}, opacity double, clips {CLIPS}, commands {COMMANDS}, style {STYLE}, shapes {SHAPES}, text struct<content:string,font_size:double>, target struct<kind:string,video_id:string,url:string>, bounds {RECT}, href string"
NODES = f"board_id string, node_seq bigint, {NODE_FIELDS}"

# What each check says, in the order of the checks.
MESSAGES = (
    "board width must be finite and positive",
    "board height must be finite and positive",
    "asset identifiers must be unique",
    "asset dimensions must be positive",
    "image node references a missing asset",
    "scene contains an unreferenced asset",
    "scene contains a non-finite number",
    "scene contains an invalid size, color, or opacity",
    "a full-board raster image is not allowed",
)


def finite(value: Column) -> Column:
    """A null is no number at all and so not a bad one."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(True))


def _all(values: list[Column]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v
    return out


def _fields(struct: Column, names: str) -> Column:
    return _all([finite(struct[n]) for n in names.split()])


def _commands_finite(commands: Column) -> Column:
    return F.coalesce(F.forall(commands, lambda c: _all([_fields(c[p], "x y") for p in ("first", "second", "end")])), F.lit(True))


def node_is_finite(told: bool = False) -> Column:
    """told: clips_finite says it of the clips."""
    col = F.col
    style = col("style")
    clips = col("clips_finite") if told else F.forall("clips", lambda c: _commands_finite(c["commands"]))
    return _all([
        _fields(col("matrix"), "a b c d e f"),
        finite(col("opacity")),
        F.coalesce(clips, F.lit(True)),
        _commands_finite(col("commands")),
        _fields(style, "line_width miter_limit dash_phase opacity"),
        F.coalesce(F.forall(style["dash"], finite), F.lit(True)),
        _fields(style["fill"], "r g b"),
        _fields(style["stroke"], "r g b"),
        F.coalesce(F.forall("shapes", lambda s: _commands_finite(s["path"]) & _fields(s["color"], "r g b") & finite(s["opacity"])), F.lit(True)),
        finite(col("text.font_size")),
        _fields(col("bounds"), "x y width height"),
    ])


def _unit(value: Column) -> Column:
    return (value >= 0) & (value <= 1)


def _color_valid(color: Column) -> Column:
    return color.isNull() | (_unit(color["r"]) & _unit(color["g"]) & _unit(color["b"]))


def node_is_valid() -> Column:
    """Ranges by kind; what is null where a value is needed isn't valid."""
    col, style = F.col, F.col("style")
    dash = F.forall(style["dash"], lambda v: v >= 0) & ((F.size(style["dash"]) == 0) | F.exists(style["dash"], lambda v: v > 0))
    shape = F.forall("shapes", lambda s: (F.size(s["path"]) > 0) & _color_valid(s["color"]) & _unit(s["opacity"]))
    area = (col("bounds.width") > 0) & (col("bounds.height") > 0)
    by_kind = (
        F.when(col("kind") == "image", _unit(col("opacity")))
        .when(col("kind") == "vector-artwork", (F.size("shapes") > 0) & _unit(col("opacity")) & shape)
        .when(col("kind") == "path", (style["line_width"] >= 0) & (style["miter_limit"] >= 1) & dash & _unit(style["opacity"]) & _color_valid(style["fill"]) & _color_valid(style["stroke"]))
        .when(col("kind") == "text", (col("text.font_size") > 0) & _unit(col("opacity")))
        .when(col("kind").isin("link", "svg-document"), area)
    )
    return F.coalesce(by_kind, F.lit(False))


def _clearly_apart(m: list[np.ndarray], width: np.ndarray, height: np.ndarray, margin: float) -> np.ndarray:
    """Some corner of the board is outside the image's unit square by more than doubles can err.

    The determinant is good to 1e-7 and a coordinate's terms are below 1e9 determinants, so that it's good to the margin.
    """
    a, b, c, d, e, f = m
    with np.errstate(all="ignore"):
        det, scale = a * d - b * c, np.maximum(np.abs(a * d), np.abs(b * c))
        low, high = (-COVERAGE_TOLERANCE - margin) * np.abs(det), (1 + COVERAGE_TOLERANCE + margin) * np.abs(det)
        out = np.zeros(len(a), bool)
        for x, y in ((0.0, 0.0), (width, 0.0), (0.0, height), (width, height)):
            ox, oy = x - e, y - f
            for one, two in ((d * ox, c * oy), (a * oy, b * ox)):
                u = np.sign(det) * (one - two)
                out |= ((u < low) | (u > high)) & (np.abs(one) + np.abs(two) < 1e9 * np.abs(det))
        return out & (np.abs(det) > scale * 1e-9) & (scale > 1e-290) & (scale < 1e290)


def _covers(a: float, b: float, c: float, d: float, e: float, f: float, w: float, h: float) -> bool:
    """In whole numbers: doubles are fractions of powers of two, and the largest of them makes all of a row's whole."""
    ratios = [v.as_integer_ratio() for v in (a, b, c, d, e, f, w, h)]
    unit = max(below for _, below in ratios)
    a, b, c, d, e, f, w, h = (above * (unit // below) for above, below in ratios)
    det = a * d - b * c
    sign = 1 if det > 0 else -1
    low, high = -abs(det), abs(det) * (PARTS + 1)
    corners = [(x - e, y - f) for x in (0, w) for y in (0, h)]
    return det != 0 and all(low <= PARTS * sign * u <= high for x, y in corners for u in (d * x - c * y, a * y - b * x))


def covers_board(nodes: DataFrame, margin: float = 1e-6) -> DataFrame:
    """The image nodes (with board width and height as bw, bh) that cover their board, in one pass.

    Doubles rule out what is clear of a bound; the rest, few, is decided exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("matrix")
            columns = [*(pc.struct_field(m, c) for c in "abcdef"), batch.column("bw"), batch.column("bh")]
            values = [pc.fill_null(x.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for x in columns]
            usable = np.logical_and.reduce([np.isfinite(x) for x in values])
            doubtful = np.flatnonzero(usable & ~_clearly_apart(values[:6], *values[6:], margin))
            rows = zip(*(x[doubtful].tolist() for x in values), strict=True)
            yield batch.take(pa.array([i for i, row in zip(doubtful.tolist(), rows, strict=True) if _covers(*row)], pa.int64()))

    return nodes.mapInArrow(run, nodes.schema)


def violations(boards: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """board_id, rule (from 1), n: every check that fails, with how often.

    Assets and image references are counted by asset together, in one exchange.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def told(rows: DataFrame, **counts: Column) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(int(rule[1:])).alias("rule"), F.coalesce(n, none).alias("n")) for rule, n in counts.items()))
        return rows.select("board_id", F.explode(F.filter(pairs, lambda p: p["n"] > 0)).alias("p")).select("board_id", "p.*")

    def bad(side: str) -> Column:
        return F.when(~(finite(F.col(side)) & (F.col(side) > 0)), one)

    sizes = told(boards, r1=bad("width"), r2=bad("height"))
    images = nodes.where("kind = 'image'")
    flat = F.when((F.col("width") <= 0) | (F.col("height") <= 0), one)
    sides = assets.select("board_id", "asset_id", one.alias("held"), flat.alias("flat")).unionByName(images.select("board_id", "asset_id", one.alias("used")), allowMissingColumns=True)
    met = sides.groupBy("board_id", "asset_id").agg(*(F.sum(c).alias(c) for c in ("held", "flat", "used")))
    # A null name is nobody's: it neither holds nor uses.
    nameless = F.col("board_id").isNull() | F.col("asset_id").isNull()
    by_asset = told(met, r3=F.when(F.col("held") > 1, one), r4=F.col("flat"), r5=F.when(F.col("held").isNull() | nameless, F.col("used")), r6=F.when(F.col("used").isNull() | nameless, F.col("held")))
    ranges = told(nodes, r7=F.when(~node_is_finite("clips_finite" in nodes.columns), one), r8=F.when(~node_is_valid(), one))
    placed = images.select("board_id", "matrix").join(boards.select("board_id", F.col("width").alias("bw"), F.col("height").alias("bh")), "board_id")
    full = covers_board(placed).select("board_id", F.lit(9).alias("rule"), one.alias("n"))
    found = sizes.unionByName(by_asset).unionByName(ranges).unionByName(full)
    return found.groupBy("board_id", "rule").agg(F.sum("n").alias("n"))


def validate_scenes(boards: DataFrame, assets: DataFrame, nodes: DataFrame) -> DataFrame:
    """board_id, status (ok or error), error_kind, error_message: the first failing check."""
    first = violations(boards, assets, nodes).groupBy("board_id").agg(F.min("rule").alias("rule"))
    both = boards.select("board_id").join(first, "board_id", "left")
    bad = F.col("rule").isNotNull()
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), F.coalesce("rule", F.lit(1)))
    return both.select("board_id", F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "invalid_scene").alias("error_kind"), F.when(bad, message).alias("error_message"))
