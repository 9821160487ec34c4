"""Tracing components into vector shapes: edges per tile, contours per component and style, shapes per image.

Components never share a 2 x 2 cell, so edges are grouped by component; no group holds an image's whole ink. A crossing
is always computed from the left or upper sample, so that neighboring tiles find the same point.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.constants import BIN_WIDTH, FAINT_OPACITY, FIELD_MARGIN, FIELD_TILE, HISTOGRAM_BINS, NORMALIZATION_RADIUS, NORMALIZED_FLOOR, POINT_LIMIT, RECONSTRUCTION_LEVEL, SUPERSAMPLING, TRACEABLE_ALPHA, VECTOR_FLOOR_ALPHA
from inkfold.operators import contours
from inkfold.operators.components import cut, numbered
from inkfold.operators.groups import map_groups

TILE = 256
EDGES = "image_id string, label int, style int, px double, py double, qx double, qy double"
POINT = "struct<x:double,y:double>"
PATH = f"array<struct<start:{POINT},segments:array<struct<first:{POINT},second:{POINT},end:{POINT}>>>>"


def _edge_rows(masks: np.ndarray, crossing) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every cell and segment: row, column and the two end points. crossing(side, rows, columns) -> x, y."""
    out = []
    for mask, segments in contours.SEGMENTS.items():
        rows, columns = np.nonzero(masks == mask)
        if len(rows):
            for a, b in segments:
                out.append((rows, columns, *crossing(a, rows, columns), *crossing(b, rows, columns)))
    return out


def _ordered(px, py, qx, qy):
    """End points in order, and which edges have two different ones."""
    swap = (px > qx) | ((px == qx) & (py > qy))
    a, b = (np.where(swap, qx, px), np.where(swap, qy, py)), (np.where(swap, px, qx), np.where(swap, py, qy))
    return (*a, *b), (px != qx) | (py != qy)


def _edge_frame(parts: list[tuple], images: list, names: list[int]) -> pd.DataFrame:
    """parts: (group, px, py, qx, qy) arrays; images and labels by group."""
    if not parts:
        return pd.DataFrame(columns=["image_id", "label", "style", "px", "py", "qx", "qy"])
    sizes = [len(p[1]) for p in parts]
    label = np.repeat([names[p[0]] for p in parts], sizes)
    image = np.repeat(np.array([images[p[0]] for p in parts], object), sizes)
    ends = {c: np.concatenate([p[i] for p in parts]) for i, c in ((1, "px"), (2, "py"), (3, "qx"), (4, "qy"))}
    return pd.DataFrame({"image_id": image, "label": label, "style": 0, **ends})


def _by_group(work, *arguments):
    """work(columns of one group, *arguments) -> parts, over many groups of a frame, into one frame of edges."""

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        parts, images, names = [], [], []
        for group, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            own = {c: v[lo:hi] for c, v in columns.items()}
            images.append(own["image_id"][0])
            names.append(int(own["label"][0]))
            parts += [(group, *p) for p in work(own, *arguments)]
        return _edge_frame(parts, images, names)

    return run


#: The corners of a cell: top left, top right, bottom right, bottom left; and those that each side joins.
_CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
_SIDES = {0: (0, 1), 1: (1, 2), 2: (3, 2), 3: (0, 3)}


def _level(style: np.ndarray) -> np.ndarray:
    return np.where(style % 256 == FAINT_OPACITY, VECTOR_FLOOR_ALPHA, TRACEABLE_ALPHA) - 0.5


def _pixel_edges(tile: int):
    """Edges of the cells whose upper left sample is in the tile, or outside the image next to it; all tiles of a frame at once.

    A style is looked at only in the cells that its own samples touch, so that the work grows with the samples, not with
    samples times styles.
    """

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        own = {c: pdf[c].to_numpy() for c in pdf.columns}
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        tx, ty, width, height = (own[c][starts[:-1]].astype(np.int64) for c in ("tx", "ty", "width", "height"))
        x0, y0 = np.where(tx > 0, tx * tile, -1), np.where(ty > 0, ty * tile, -1)
        w, h = (np.minimum((t + 1) * tile, size) - o + 1 for t, size, o in ((tx, width, x0), (ty, height, y0)))
        x, y = own["x"] - x0[group], own["y"] - y0[group]
        across, down = int(w.max(initial=1)), int(h.max(initial=1))
        code = (group * down + y) * across + x
        order = np.argsort(code, kind="stable")
        code = code[order]
        # The last row stands for samples that aren't there.
        r, g, b, a, label = (np.append(own[c][order].astype(np.int64), 0) for c in ("r", "g", "b", "a", "label"))
        step = np.minimum(255, (np.stack([r, g, b]) + 16) // 32 * 32)
        color = step[0] * 65536 + step[1] * 256 + step[2]
        alpha = a.astype(float)
        drawn_as = color * 256 + np.where(alpha < TRACEABLE_ALPHA, FAINT_OPACITY, 255)
        style = np.where(alpha >= VECTOR_FLOOR_ALPHA, drawn_as, -1)

        styles, number = np.unique(style[:-1], return_inverse=True)
        seen = np.flatnonzero(style[:-1] >= 0)
        gs, ys, xs = group[order][seen], y[order][seen], x[order][seen]
        keys = []
        for dy, dx in _CORNERS:
            row, column = ys - dy, xs - dx
            fits = (row >= 0) & (column >= 0) & (row < h[gs] - 1) & (column < w[gs] - 1)
            keys.append((((gs * down + row) * across + column) * len(styles) + number[seen])[fits])
        key = np.unique(np.concatenate(keys))
        cell, drawn = key // max(1, len(styles)), styles[key % max(1, len(styles))]
        place = cell // across
        columns, rows, gs = cell % across, place % down, place // down

        corner = []
        for dy, dx in _CORNERS:
            wanted = cell + dy * across + dx
            at = np.searchsorted(code, wanted, side="right") - 1
            corner.append(np.where((at >= 0) & (code[at] == wanted), at, len(code)))
        level = _level(drawn)
        # Faint samples of the same color keep their alpha, whatever their opacity.
        value = [np.where((drawn_as[i] == drawn) | ((alpha[i] < VECTOR_FLOOR_ALPHA) & (color[i] == drawn // 256)), alpha[i], 0.0) for i in corner]
        masks = sum(((v >= level).astype(int) << n for n, v in enumerate(value)), np.zeros(len(cell), int))
        cell_label = np.maximum.reduce([label[i] for i in corner])

        def crossing(side: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, two = _SIDES[side]
            i, j = corner[one][at], corner[two][at]
            s, e = style[i], style[j]
            border = (s >= 0) & (e >= 0) & (s != e)
            alike = border & (s // 256 == e // 256)
            low = np.where(alike, np.maximum(_level(s), _level(e)) - alpha[i], level[at] - value[one][at])
            span = np.where(alike, alpha[j] - alpha[i], value[two][at] - value[one][at])
            part = np.where(border & ~alike, 0.5, low / np.where(span == 0, 1.0, span))
            (ay, ax), (by, bx) = (((rows[at] + dy + y0[gs[at]]) + 0.5, (columns[at] + dx + x0[gs[at]]) + 0.5) for dy, dx in (_CORNERS[one], _CORNERS[two]))
            return np.clip(ax + part * (bx - ax), 0, width[gs[at]]), np.clip(ay + part * (by - ay), 0, height[gs[at]])

        found = []
        for mask, segments in contours.SEGMENTS.items():
            at = np.flatnonzero(masks == mask)
            for one, two in segments if len(at) else ():
                ends, real = _ordered(*crossing(one, at), *crossing(two, at))
                found.append((at[real], *(v[real] for v in ends)))
        at, px, py, qx, qy = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, int), *[np.empty(0)] * 4)
        return pd.DataFrame({"image_id": own["image_id"][starts[:-1]][gs[at]], "label": cell_label[at], "style": drawn[at] - (1 << 31), "px": px, "py": py, "qx": qx, "qy": qy})

    return run


def pixel_edges(labeled: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """Marching squares on the samples of each style, tile by tile. sizes(image_id, width, height)."""

    def tiles(c: str):
        own = F.floor(F.col(c) / tile).cast("int")
        return F.when((F.col(c) % tile == 0) & (F.col(c) > 0), F.array(own - 1, own)).otherwise(F.array(own))

    # A sample on a tile's left or upper border also belongs to the halo of the tiles before.
    spread = labeled.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))
    sized = spread.join(sizes.select("image_id", "width", "height"), "image_id")
    return map_groups(sized, ["image_id", "tx", "ty"], _pixel_edges(tile), EDGES).dropDuplicates()


def _weight(distance: np.ndarray) -> np.ndarray:
    d = np.abs(distance)
    return np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


@cache
def _terms(radius: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(weights, rows, columns of the samples) of each term of a tile's field, the same for all tiles."""
    u = (np.arange(FIELD_TILE * SUPERSAMPLING + 1 + 2 * radius) - radius + 0.5) / SUPERSAMPLING - 0.5  # relative to the tile's first sample
    base, pad = np.floor(u).astype(int), FIELD_MARGIN + 2
    near = [(_weight(u - (base + d)), base + d + pad) for d in range(-1, 3)]
    return [(wx[None, :] * wy[:, None], rows[:, None], columns[None, :]) for wy, rows in near for wx, columns in near]


def _field(own: dict, radius: int) -> np.ndarray:
    """The bicubic field of one component in one tile, with a margin of samples; each sample's terms in one order."""
    tx, ty = int(own["tx"][0]), int(own["ty"][0])
    pad = FIELD_MARGIN + 2
    alpha = np.zeros((FIELD_TILE + 2 * pad, FIELD_TILE + 2 * pad))
    alpha[own["y"] - ty * FIELD_TILE + pad, own["x"] - tx * FIELD_TILE + pad] = own["a"]
    terms = _terms(radius)
    out = np.zeros(terms[0][0].shape)
    for w, rows, columns in terms:
        out += w * alpha[rows, columns]
    return out


def _normalized(own: dict) -> np.ndarray:
    r = NORMALIZATION_RADIUS
    field = np.maximum(0, _field(own, r))
    windows = np.lib.stride_tricks.sliding_window_view(field, 2 * r + 1, axis=0).max(axis=-1)
    windows = np.lib.stride_tricks.sliding_window_view(windows, 2 * r + 1, axis=1).max(axis=-1)
    inner = field[r:-r, r:-r]
    return np.where(windows < NORMALIZED_FLOOR, 0.0, inner / np.where(windows == 0, 1.0, windows))


def _histograms(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    columns = {c: pdf[c].to_numpy() for c in pdf.columns}
    out = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        own = {c: v[lo:hi] for c, v in columns.items()}
        values = _field(own, 0)[:-1, :-1]  # the last row and column are the next tiles'
        bins = np.minimum(HISTOGRAM_BINS - 1, np.floor(values[values > 0] / BIN_WIDTH).astype(int))
        found, counts = np.unique(bins, return_counts=True)
        out += [(own["image_id"][0], own["label"][0], b, n) for b, n in zip(found.tolist(), counts.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["image_id", "label", "bin", "n"])


def _field_edges(own: dict, normalized: bool) -> list[tuple]:
    field = _normalized(own) if normalized else _field(own, 0)
    level, width, height = (float(own[c][0]) for c in ("level", "width", "height"))
    x0, y0 = (int(own[c][0]) * FIELD_TILE * SUPERSAMPLING for c in ("tx", "ty"))
    inside = (field >= level).astype(int)
    masks = inside[:-1, :-1] + 2 * inside[:-1, 1:] + 4 * inside[1:, 1:] + 8 * inside[1:, :-1]
    steps = {0: (0, 0, 0, 1), 1: (0, 1, 1, 1), 2: (1, 0, 1, 1), 3: (0, 0, 1, 0)}

    def crossing(side, rows, columns):
        dy, dx, ey, ex = steps[side]
        a, b = field[rows + dy, columns + dx], field[rows + ey, columns + ex]
        part = (level - a) / (b - a)
        ax, ay = ((columns + dx + x0) + 0.5) / SUPERSAMPLING, ((rows + dy + y0) + 0.5) / SUPERSAMPLING
        bx, by = ((columns + ex + x0) + 0.5) / SUPERSAMPLING, ((rows + ey + y0) + 0.5) / SUPERSAMPLING
        return np.clip(ax + part * (bx - ax), 0, width), np.clip(ay + part * (by - ay), 0, height)

    found = []
    for _, _, px, py, qx, qy in _edge_rows(masks, crossing):
        (px, py, qx, qy), real = _ordered(px, py, qx, qy)
        found.append((px[real], py[real], qx[real], qy[real]))
    return found


def field_tiles(labeled: DataFrame) -> DataFrame:
    """Each sample of a component in every field tile that it can reach."""
    reach = [F.sequence(F.floor((F.col(c) - FIELD_MARGIN) / FIELD_TILE).cast("int"), F.floor((F.col(c) + FIELD_MARGIN) / FIELD_TILE).cast("int")) for c in ("x", "y")]
    return labeled.withColumn("tx", F.explode(reach[0])).withColumn("ty", F.explode(reach[1]))


def area_levels(labeled: DataFrame) -> DataFrame:
    """image_id, label, level: the highest histogram level above which the field's area reaches the component's ink."""
    counts = map_groups(field_tiles(labeled), ["image_id", "label", "tx", "ty"], _histograms, "image_id string, label int, bin int, n long").groupBy("image_id", "label", "bin").agg(F.sum("n").alias("n"))
    ink = labeled.groupBy("image_id", "label").agg(F.expr(f"sum(a) * {SUPERSAMPLING * SUPERSAMPLING} div 255").alias("target"))
    above = F.sum("n").over(Window.partitionBy("image_id", "label").orderBy(F.desc("bin")))
    reached = counts.withColumn("above", above).join(ink, ["image_id", "label"]).where((F.col("bin") > 0) & (F.col("above") >= F.col("target")))
    level = reached.groupBy("image_id", "label").agg((F.max("bin") * BIN_WIDTH).alias("level"))
    return ink.join(level, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("level", F.lit(BIN_WIDTH)).alias("level"))


def field_edges(labeled: DataFrame, sizes: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Marching squares on the supersampled field, at the given levels or, without them, on the normalized field."""
    tiles = field_tiles(labeled).join(sizes.select("image_id", "width", "height"), "image_id")
    tiles = tiles.join(levels, ["image_id", "label"]) if levels is not None else tiles.withColumn("level", F.lit(RECONSTRUCTION_LEVEL))
    return map_groups(tiles, ["image_id", "label", "tx", "ty"], _by_group(_field_edges, levels is None), EDGES).dropDuplicates()


def _closed(curved: bool):
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ends = list(pdf[["px", "py", "qx", "qy"]].itertuples(index=False, name=None))
        keys = list(pdf[["image_id", "label", "style", "width", "height"]].itertuples(index=False, name=None))
        rows = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            image, label, style, width, height = keys[lo]
            for walked in contours.close([((a, b), (c, d)) for a, b, c, d in ends[lo:hi]]):
                points = contours.simplify(walked)
                if points:
                    rows.append((image, label, style, len(points), *points[0], contours.path(points, width, height, curved)))
        return pd.DataFrame(rows, columns=["image_id", "label", "style", "n_points", "start_x", "start_y", "contour"])

    return run


def close_contours(edges: DataFrame, sizes: DataFrame, curved: bool) -> DataFrame:
    """A row for each contour: image_id, label, style, n_points, start_x, start_y, contour. Degenerate ones are dropped."""
    schema = f"image_id string, label int, style int, n_points int, start_x double, start_y double, contour {PATH[6:-1]}"
    sized = edges.join(sizes.select("image_id", "width", "height"), "image_id")
    return map_groups(sized, ["image_id", "label", "style"], _closed(curved), schema)


def _channels() -> Column:
    channel = lambda shift: F.shiftright("packed", shift).bitwiseAND(255) / 255.0
    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b")).alias("color")


def _within_limit(found: DataFrame, empty: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contours of images that have any and are below the point limit; and errors of the other images. Nothing is collected."""
    points = images.select("image_id").distinct().join(found.groupBy("image_id").agg(F.sum("n_points").alias("points")), "image_id", "left")
    error = F.when(F.col("points").isNull(), empty).when(F.col("points") > POINT_LIMIT, "vector artwork exceeds the point complexity limit")
    errors = points.select("image_id", error.alias("error")).where("error IS NOT NULL")
    return found.join(errors, "image_id", "left_anti"), errors


def _shapes(found: DataFrame, by: str, empty: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shapes of each image in the order of `by`, contours by their start; and errors of empty or too complex images."""
    found, errors = _within_limit(found, empty, images)
    parts = found.groupBy("image_id", by).agg(F.array_sort(F.collect_list(F.struct("start_x", "start_y", "contour"))).alias("c"), F.max("packed").alias("packed"), F.max("opacity").alias("opacity"))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy(by)) - 1
    shapes = parts.select("image_id", order.alias("shape_seq"), _channels(), (F.col("opacity") / 255.0).alias("opacity"), F.transform("c", lambda x: x["contour"]).alias("path"))
    return shapes, errors


def _pixel_contours(labeled: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    found = close_contours(pixel_edges(labeled, sizes, tile), sizes, False)
    own = F.col("style").cast("long") + (1 << 31)
    return found.withColumns({"style": own, "packed": F.shiftright(own, 8), "opacity": own.bitwiseAND(255)})


_NO_SHAPES = "vector artwork contains no visible shapes"


def trace_contours(labeled: DataFrame, sizes: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(contours, errors) like trace_pixels, with a row for each contour: its shape and its number in the shape, from 0.

    For large images: no row or task holds all contours of an image or of a style.
    """
    found, errors = _within_limit(cut(_pixel_contours(labeled, sizes, tile)), _NO_SHAPES, labeled)
    shapes = numbered(found.select("image_id", "style").distinct(), ["image_id"], ["style"], "shape_seq")
    contours = numbered(found, ["image_id", "style"], ["start_x", "start_y"], "contour_seq", ["contour"]).join(shapes, ["image_id", "style"])
    return contours.select("image_id", "shape_seq", "contour_seq", _channels(), (F.col("opacity") / 255.0).alias("opacity"), "contour"), errors


def trace_pixels(labeled: DataFrame, sizes: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(shapes, errors) of the pixel parts: polygons of each quantized style, in the order of styles."""
    return _shapes(_pixel_contours(labeled, sizes, tile), "style", _NO_SHAPES, labeled)


def _curves(edges: DataFrame, sizes: DataFrame, color: DataFrame, empty: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = close_contours(edges, sizes, True).join(color, ["image_id", "label"]).withColumn("opacity", F.lit(255))
    return _shapes(found, "label", empty, images)


def trace_smooth(labeled: DataFrame, sizes: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, errors) of thin components of one color: curves at the level that keeps their ink, by label."""
    color = stats.where("n_colors = 1").select("image_id", "label", F.col("color").cast("long").alias("packed"))
    own = labeled.join(color.select("image_id", "label"), ["image_id", "label"], "left_semi")
    return _curves(field_edges(own, sizes, area_levels(own)), sizes, color, "smoothed artwork contains no visible shapes", labeled)


def trace_strokes(labeled: DataFrame, sizes: DataFrame, strokes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shapes, errors) of pen strokes narrower than a pixel: curves on the field divided by its local peak."""
    color = strokes.where("stroke_color IS NOT NULL").select("image_id", "label", F.col("stroke_color").cast("long").alias("packed"))
    own = labeled.join(color.select("image_id", "label"), ["image_id", "label"], "left_semi")
    return _curves(field_edges(own, sizes), sizes, color, "reconstructed artwork contains no visible shapes", labeled)


def prepare_artwork(parts: DataFrame, kinds: DataFrame, sizes: DataFrame, images: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(shapes, prepared) of images whose pixels, as parts, have the kinds of their components.

    shapes: those of the traced, the smoothed and the reconstructed part, in this order, with numbers from 0. prepared:
    image_id, prepared, error: vector, mixed where a residual is left beside shapes, raster where it's all there is; an
    image of which a part can't be traced has the first part's error and no shapes.
    """
    of = lambda kind: parts.where(F.col("kind") == kind)
    traced = [trace_pixels(of("pixel"), sizes, tile), trace_smooth(of("smooth"), sizes, kinds), trace_strokes(of("reconstructed"), sizes, kinds)]
    numbered_ = [[df.withColumn("part", F.lit(i)) for df in pair] for i, pair in enumerate(traced)]
    shapes, errors = (a.unionByName(b).unionByName(c) for a, b, c in zip(*numbered_, strict=True))
    none = images.select("image_id").distinct().join(parts.select("image_id").distinct(), "image_id", "left_anti")
    errors = errors.unionByName(none.select("image_id", F.lit(_NO_SHAPES).alias("error"), F.lit(0).alias("part")))
    first = errors.groupBy("image_id").agg(F.min_by("error", "part").alias("error"))
    united = cut(shapes.join(first, "image_id", "left_anti"))
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("part", "shape_seq")) - 1
    drawn = united.select("image_id").distinct().withColumn("drawn", F.lit(True))
    left = of("residual").select("image_id").distinct().withColumn("residual", F.lit(True))
    told = images.select("image_id").distinct().join(first, "image_id", "left").join(drawn, "image_id", "left").join(left, "image_id", "left")
    what = F.when(F.col("error").isNotNull(), None).when(F.col("residual").isNull(), "vector").when(F.col("drawn").isNull(), "raster").otherwise("mixed")
    return united.withColumn("shape_seq", order), told.select("image_id", what.alias("prepared"), "error")
