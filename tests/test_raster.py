"""Images by their alpha, components, and traced contours with known decimals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkfold.operators import classify, components, contours, tracing


def frame(spark, images):
    """images: name -> {(x, y): (r, g, b, a)}"""
    rows = [(n, x, y, *v) for n, cells in images.items() for (x, y), v in cells.items()]
    return spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, a int")


def sizes(spark, **named):
    return spark.createDataFrame([(n, w, h) for n, (w, h) in named.items()], "image_id string, width int, height int")


def gray(a):
    return (0, 0, 0, a)


def box(x0, y0, x1, y1, a):
    return {(x, y): gray(a) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}


def test_classification(spark):
    masks = {"zero": [0, 0], "low": [0, 1, 95], "trace": [96], "few": [0] * 8 + [255] * 992, "limit": [0] * 10 + [255] * 990, "opaque": [0] * 15 + [255] * 985, "clear": [0] * 20 + [255] * 980}
    pixels = frame(spark, {n: {(i, 0): gray(a) for i, a in enumerate(v)} for n, v in masks.items()})
    images = spark.createDataFrame([(n, True) for n in [*masks, "empty"]] + [("none", False)], "image_id string, masked boolean")
    got = {r.image_id: r.disposition or r.error for r in classify.classify_images(images, pixels).collect()}
    assert got == {"none": "raster", "empty": "soft mask is empty", "zero": "soft mask contains no visible artwork", "low": "low_alpha_raster", "trace": "trace", "few": "raster", "limit": "raster", "opaque": "soft-masked image is too opaque to classify safely", "clear": "trace"}


def test_highlighter(spark):
    band = {(x, 0): (255, 192, 0, 89 if x else 0) for x in range(12)}
    block = {(x, y): (255, 192, 0, 89) for x in range(4) for y in range(4)}
    pixels = frame(spark, {"band": band, "block": block})
    images = spark.createDataFrame([("band", True), ("block", True)], "image_id string, masked boolean")
    out = classify.make_opaque(pixels, classify.classify_images(images, pixels)).collect()
    assert {r.a for r in out if r.image_id == "band" and r.x} == {255}
    assert {r.a for r in out if r.image_id == "band" and not r.x} == {0}
    assert {r.a for r in out if r.image_id == "block"} == {89}


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_labels_match_whole_image(spark, tile):
    random = np.random.default_rng(4)
    images = {str(i): {(x, y): gray(int(random.random() < 0.45) * 200) for x in range(19) for y in range(17)} for i in range(3)}
    got = components.label_components(frame(spark, images), tile).collect()
    for name, cells in images.items():
        label, seen = 0, {}
        for y in range(17):
            for x in range(19):
                if cells[x, y][3] and (x, y) not in seen:
                    label += 1
                    todo = [(x, y)]
                    while todo:
                        p = todo.pop()
                        if p in seen or cells.get(p, gray(0))[3] == 0:
                            continue
                        seen[p] = label
                        todo += [(p[0] + dx, p[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        assert {(r.x, r.y): r.label for r in got if r.image_id == name} == seen


def test_component_kinds(spark):
    block = box(5, 2, 12, 8, 255)
    stroke = {(1, 1): gray(60), (2, 1): gray(96), (3, 1): gray(60)}
    line = {(x, 2): gray(255) for x in range(2, 10)}
    images = {
        "block": block,
        "stroke": stroke,
        "faint": {p: gray(40) for p in stroke},
        "pale": {p: gray(60) for p in block},
        "line": line,
        "two": {p: ((255, 0, 0, 255) if p[0] >= 6 else v) for p, v in line.items()},
        "q85": {(0, 0): gray(255), (1, 0): gray(85)},
        "q86": {(0, 0): gray(255), (1, 0): gray(86)},
    }
    got = {r.image_id: r.kind for r in components.component_kinds(components.label_components(frame(spark, images))).collect()}
    assert got["block"] == "pixel" and got["stroke"] == "reconstructed" and got["faint"] == "residual" and got["pale"] == "residual"
    assert got["line"] == "smooth" and got["two"] == "pixel" and got["q85"] != "reconstructed" and got["q86"] == "reconstructed"


def coordinates(rows):
    return {round(v, 6) for r in rows for c in r.path for p in [c.start, *(s.end for s in c.segments)] for v in (p.x, p.y)}


def test_traced_decimals(spark):
    images = {
        "solid": box(0, 0, 1, 1, 255),
        "hole": box(0, 0, 2, 2, 255) | {(1, 1): gray(0)},
        "stair": {(x, y): gray(255 if x >= y + y % 2 else 0) for x in range(6) for y in range(6)},
        "ramp": {(0, 0): gray(0), (0, 1): gray(0), (1, 0): gray(128), (1, 1): gray(128)},
        "faint": {(0, 0): gray(94), (1, 0): gray(0), (2, 0): gray(255)},
        "low": {(0, 0): gray(80), (0, 1): gray(80), (1, 0): gray(128), (1, 1): gray(128)},
        "mixed": {(0, 0): gray(88), (0, 1): gray(88), (1, 0): gray(255), (1, 1): gray(255)},
        "styles": {(0, 0): gray(255), (0, 1): gray(255), (1, 0): (255, 0, 0, 255), (1, 1): (255, 0, 0, 255)},
    }
    side = {"solid": (2, 2), "hole": (3, 3), "stair": (6, 6), "ramp": (2, 2), "faint": (3, 1), "low": (2, 2), "mixed": (2, 2), "styles": (2, 2)}
    labeled = components.label_components(frame(spark, images))
    shapes, errors = tracing.trace_pixels(labeled, sizes(spark, **side), tile=4)
    by = {}
    for r in shapes.collect():
        by.setdefault(r.image_id, []).append(r)
    assert not errors.collect()
    assert len(by["solid"]) == 1 and len(by["solid"][0].path) == 1
    assert len(by["hole"]) == 1 and len(by["hole"][0].path) == 2
    for name, value in {"stair": 0.854248, "ramp": 0.623047, "faint": 0.189716, "low": 0.411458, "mixed": 0.272455, "styles": 0.5}.items():
        assert value in coordinates(by[name]), (name, coordinates(by[name]))
    assert sorted(round(r.opacity, 6) for r in by["mixed"]) == [round(64 / 255, 6), 1.0]


@pytest.mark.parametrize("tile", [3, 8])
def test_tiled_trace_is_whole_trace(spark, tile):
    random = np.random.default_rng(5)
    images = {"i": {(x, y): (int(random.integers(0, 3)) * 100, 0, 0, int(random.choice([0, 90, 120, 255]))) for x in range(21) for y in range(13)}}
    labeled = components.label_components(frame(spark, images)).cache()
    whole, tiled = (sorted(map(str, tracing.trace_pixels(labeled, sizes(spark, i=(21, 13)), t)[0].collect())) for t in (256, tile))
    assert whole == tiled


def test_contours_are_the_shapes_paths(spark):
    random = np.random.default_rng(6)
    images = {i: {(x, y): (int(random.integers(0, 3)) * 100, 0, 0, int(random.choice([0, 0, 120, 255]))) for x in range(17) for y in range(11)} for i in "ij"}
    labeled = components.label_components(frame(spark, images | {"empty": {(0, 0): gray(50)}})).cache()
    side = sizes(spark, i=(17, 11), j=(17, 11), empty=(1, 1))
    shapes, errors = tracing.trace_pixels(labeled, side, 4)
    found, found_errors = tracing.trace_contours(labeled, side, 4)
    assert found_errors.collect() == errors.collect() and errors.count() == 1
    want = [(r.image_id, r.shape_seq, i, r.color, r.opacity, c) for r in shapes.collect() for i, c in enumerate(r.path)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect()) and len(want) > 20


def test_large_images(spark, monkeypatch):
    """Images grow in number, and one beyond the point limit is an error, not nothing."""
    from inkfold.plans import inputs, queries

    assert inputs.image_sizes(inputs.large_pixels(spark, "/root/testdata/sf0.1")).where("width <= 100 AND height <= 500").count() > 1
    run = queries.trace_large_image
    assert {r.error for r in run(spark, "/root/testdata/sf0.001").collect()} == {None}
    monkeypatch.setattr(tracing, "POINT_LIMIT", 10)
    (row,) = run(spark, "/root/testdata/sf0.001").collect()
    assert (row.image_id, row.error, row.contour) == ("0", "vector artwork exceeds the point complexity limit", None)


def test_numbers_over_ranges(spark):
    rows = [("a", (i * 7919) % 501) for i in range(501)] + [("b", 3), ("b", 1)]
    got = components.numbered(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], ["v"], "n", first=1).collect()
    assert sorted((r.k, r.v, r.n) for r in got) == sorted([("a", i, i + 1) for i in range(501)] + [("b", 1, 1), ("b", 3, 2)])


def test_smooth_line(spark):
    labeled = components.label_components(frame(spark, {"line": {(x, 2): gray(255) for x in range(2, 10)}}))
    kinds = components.component_kinds(labeled)
    (shape,) = tracing.trace_smooth(labeled, sizes(spark, line=(12, 5)), kinds)[0].collect()
    (contour,) = shape.path
    assert all(s.first is not None for s in contour.segments)
    at, points = contour.start, []
    for s in contour.segments:
        for t in np.linspace(0, 1, 20, endpoint=False):
            w = ((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3)
            points.append(tuple(sum(k * getattr(p, c) for k, p in zip(w, (at, s.first, s.second, s.end), strict=True)) * side for c, side in (("x", 12), ("y", 5))))
        at = s.end
    assert 6.4 <= abs(contours.area(points)) / 2 <= 9.6


def test_reconstructed_stroke(spark):
    stroke = {(1, 1): gray(60), (2, 1): gray(96), (3, 1): gray(60)}
    labeled = components.label_components(frame(spark, {"s": stroke}))
    (shape,) = tracing.trace_strokes(labeled, sizes(spark, s=(14, 10)), components.component_kinds(labeled))[0].collect()
    assert shape.opacity == 1 and len(shape.path) == 1


def test_empty_trace_is_an_error(spark):
    labeled = components.label_components(frame(spark, {"x": {(0, 0): gray(50)}}))
    shapes, errors = tracing.trace_pixels(labeled, sizes(spark, x=(1, 1)))
    assert shapes.count() == 0 and errors.first().error == "vector artwork contains no visible shapes"


def test_quantized_style(spark):
    from inkfold.functions import colors

    row = spark.range(1).select(colors.quantize(F.lit(15)).alias("a"), colors.quantize(F.lit(16)).alias("b"), colors.quantize(F.lit(250)).alias("c")).first()
    assert tuple(row) == (0, 32, 255)


def test_pixel_edges_do_not_take_each_style_over_a_whole_tile():
    """A tile of 256 x 256 with hundreds of styles: work grows with samples, not with samples times styles; all 16 masks occur."""
    import time

    r = np.random.default_rng(3)
    n = 256
    y, x = (v.ravel() for v in np.mgrid[0:n, 0:n])
    rgb = [r.integers(0, 256, n * n) for _ in "rgb"]
    tile = pd.DataFrame({"image_id": "i", "tx": 0, "ty": 0, "width": n, "height": n, "x": x, "y": y, "label": 1, **dict(zip("rgb", rgb, strict=True)), "a": r.integers(0, 256, n * n)})
    began = time.process_time()
    edges = tracing._pixel_edges(256)(tile, np.array([0, n * n]))
    assert time.process_time() - began < 4
    # A contour is closed: at each point, edges of one style meet in pairs.
    ends = pd.concat([edges[["style", "px", "py"]].set_axis(["s", "x", "y"], axis=1), edges[["style", "qx", "qy"]].set_axis(["s", "x", "y"], axis=1)])
    assert len(edges) > n * n and (ends.groupby(["s", "x", "y"]).size() % 2 == 0).mean() > 0.99


def test_pixel_edges_of_many_tiles_at_once_are_those_of_each():
    r = np.random.default_rng(4)
    frames = []
    for i in range(40):
        w, h = r.integers(1, 9, 2).tolist()
        y, x = (v.ravel() for v in np.mgrid[0:h, 0:w])
        kept = r.random(w * h) < 0.8
        kept[0] = True
        one = pd.DataFrame({"image_id": str(i), "tx": 0, "ty": 0, "width": w, "height": h, "x": x, "y": y, "label": i + 1, **{c: r.choice([0, 90, 200], w * h) for c in "rgb"}, "a": r.choice([1, 60, 90, 95, 97, 255], w * h)})
        frames.append(one[kept])
    starts = np.append(0, np.cumsum([len(f) for f in frames]))
    work = tracing._pixel_edges(16)
    rows = lambda df: sorted(map(tuple, df.astype({"style": int, "label": int}).itertuples(index=False)))
    each = [row for f in frames for row in rows(work(f.reset_index(drop=True), np.array([0, len(f)])))]
    assert rows(work(pd.concat(frames, ignore_index=True), starts)) == sorted(each) and len(each) > 100
