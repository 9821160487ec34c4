"""Streams, scenes, links, markup, renderings and sources on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from inkfold import sinks
from inkfold.functions import geometry, links, text
from inkfold.operators import evaluate, interpret, markup, validate
from inkfold.sources import discovery, images

RULE = links.GameRule("games.example.org", "/arcade/", "/games/", "Example Arcade")
OPS = "board_id string, seq int, op string, nums array<double>, name string, dash array<double>"


def run(spark, streams):
    floats = lambda v: None if v is None else [float(x) for x in v]
    rows = [(b, i, o[0], floats(o[1]), o[2], floats(o[3])) for b, ops in streams.items() for i, o in enumerate((*x, *[None] * (4 - len(x))) for x in ops)]
    boards = spark.createDataFrame([(b, 100.0, 100.0) for b in streams], "board_id string, width double, height double")
    resources = spark.createDataFrame([(b, n, k, a) for b in streams for n, k, a in (("Im1", "raster", "Im1"), ("V", "vector", None), ("X", "mixed", "X"))], "board_id string, name string, kind string, asset_id string")
    alphas = spark.createDataFrame([(b, "GS", 0.5) for b in streams], "board_id string, name string, opacity double")
    spaces = spark.createDataFrame([(b, n, s) for b in streams for n, s in (("C", "rgb"), ("U", None))], "board_id string, name string, space string")
    nodes, errors = interpret.interpret(spark.createDataFrame(rows, OPS), boards, resources, alphas, spaces)
    by = {}
    for r in nodes.orderBy("board_id", "op_seq", "sub_seq").collect():
        by.setdefault(r.board_id, []).append(r)
    return by, {r.board_id: r.error_message for r in errors.collect()}


LINE = [("m", [0, 0]), ("l", [5, 5])]


def test_interpreter(spark):
    by, errors = run(spark, {
        "image": [("cm", [2, 0, 0, 3, 10, 20]), ("Do", [], "Im1")],
        "order": [("Do", [], "Im1"), ("Do", [], "V"), ("Do", [], "X")],
        "curve": [("m", [10, 10]), ("l", [20, 10]), ("h", []), ("v", [30, 20, 40, 40]), ("S", [])],
        "miter": [("M", [0])],
        "dash": [("cm", [2, 0, 0, 2, 0, 0]), ("w", [3]), ("d", [4], None, [2, 1]), *LINE, ("S", [])],
        "skew": [("cm", [2, 0, 0, 3, 0, 0]), *LINE, ("S", [])],
        "skewfill": [("cm", [2, 0, 0, 3, 0, 0]), *LINE, ("f", [])],
        "zeros": [("d", [0], None, [0, 0])],
        "named": [("CS", [], "C"), ("SC", [1, 0, 0]), *LINE, ("S", [])],
        "reset": [("rg", [1, 0, 0]), ("cs", [], "DeviceGray"), *LINE, ("f", [])],
        "unsupported": [("cs", [], "U")],
        "lost": [("cs", [], "Nope")],
        "cmyk": [("K", [2, 0, 0, 0])],
        "text": [("BT", [])],
        "open": [("q", [])],
        "close": [("Q", [])],
        "none": [("Do", [], "Nope")],
        "keeps": [("q", []), ("m", [0, 0]), ("W", []), ("Q", []), ("l", [1, 1]), ("f", []), *LINE, ("f", [])],
        "alpha": [("gs", [], "GS"), *LINE, ("f", [])],
        "empty": [("S", []), ("f", [])],
        "odd": [("zz", [])],
        "ignored": [("ri", []), ("BDC", []), ("EMC", [])],
    })
    assert tuple(by["image"][0].matrix) == (2, 0, 0, 3, 10, 77)
    assert [r.kind for r in by["order"]] == ["image", "vector-artwork", "vector-artwork", "image"]
    last = by["curve"][0].commands[3]
    assert (tuple(last.first), tuple(last.second), tuple(last.end)) == ((10, 90), (30, 80), (40, 60))
    style = by["dash"][0].style
    assert (style.line_width, style.dash, style.dash_phase) == (6, [4, 2], 8)
    assert tuple(by["named"][0].style.stroke) == (1, 0, 0) and tuple(by["reset"][0].style.fill) == (0, 0, 0)
    assert "skewfill" in by and by["alpha"][0].style.opacity == 0.5
    first, second = by["keeps"]
    assert len(first.commands) == 2 and first.clips == [] and len(second.clips) == 1
    assert errors == {
        "miter": "miter limit must be at least 1", "skew": "stroked paths require a non-singular similarity transform", "zeros": "dash array must not contain only zeros",
        "unsupported": "unsupported named color space: U", "lost": "missing color-space resource Nope", "cmyk": "CMYK components must be between 0 and 1",
        "text": "PDF text requires font decoding and metrics", "open": "content stream ended before every q had a matching Q", "close": "Q tried to restore an empty graphics-state stack",
        "none": "missing image resource Nope", "odd": "zz",
    }


def drawn(spark, streams, size):
    """Nodes and errors of boards, folded in slices of size positions."""
    floats = lambda v: None if v is None else [float(x) for x in v]
    rows = [(b, i, o[0], floats(o[1]), o[2], floats(o[3])) for b, ops in streams.items() for i, o in enumerate((*x, *[None] * (4 - len(x))) for x in ops)]
    boards = spark.createDataFrame([(b, 100.0) for b in streams], "board_id string, height double")
    resources = spark.createDataFrame([(b, "X", "mixed", "X") for b in streams], "board_id string, name string, kind string, asset_id string")
    alphas = spark.createDataFrame([(b, f"G{i}", i / 8) for b in streams for i in range(4)], "board_id string, name string, opacity double")
    spaces = spark.createDataFrame([(b, "C", "cmyk") for b in streams], "board_id string, name string, space string")
    nodes, errors = interpret.interpret(spark.createDataFrame(rows, OPS), boards, resources, alphas, spaces, size)
    return sorted(map(repr, nodes.collect())), sorted(map(tuple, errors.collect()))


def any_stream(r, n, faults):
    """A stream of n operators: paths over q and Q, clips, colors in spaces, and, if asked for, faults."""
    out, depth = [], 0
    for _ in range(n):
        op = r.choice(["q", "q", "Q", "Q", "cm", "w", "d", "gs", "cs", "sc", "g", "RG", "m", "l", "v", "re", "W", "W*", "n", "S", "f", "b", "Do", "BDC"])
        if op == "Q" and not depth and not faults:
            continue
        depth += (op == "q") - (op == "Q")
        x = [r.randint(-9, 9) / 8 for _ in range(6)]
        more = {"cm": [x[0] or 1, x[1], -x[1], x[0] or 1, x[4], x[5]], "w": [abs(x[0])], "d": [x[0]], "g": [abs(x[0])], "RG": x[:3], "m": x[:2], "l": x[:2], "v": x[:4], "re": x[:4]}.get(op, [])
        if op == "sc":
            more = [abs(v) / 2 for v in x[: r.choice([1, 3, 4]) if faults else 1]]
        name = {"gs": f"G{r.randint(0, 3)}", "cs": "DeviceGray" if not faults else r.choice(["DeviceGray", "C"]), "Do": "X"}.get(op)
        out.append((op, more, name, [1.0, abs(x[1])] if op == "d" else None))
    return out + [("Q", [])] * max(depth, 0)


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_sliced_streams_are_folded_as_whole_ones(spark, size):
    r = random.Random(size)
    streams = {f"s{i}": any_stream(r, 120, False) for i in range(30)} | {f"f{i}": any_stream(r, 25, True) for i in range(20)}
    # A path and a clip over the edges of slices and over q and Q, and an open q.
    streams["over"] = [("m", [0, 0]), ("q", []), ("cm", [2, 0, 0, 2, 1, 1]), ("l", [3, 4]), ("W", []), ("Q", []), ("l", [1, 1]), ("q", []), ("n", []), ("Do", [], "X"), ("Q", []), ("Do", [], "X"), ("re", [0, 0, 1, 1]), ("f", [])]
    streams["open"] = [("q", []), *LINE, ("f", [])] * 9
    whole = drawn(spark, streams, 1 << 20)
    assert len(whole[0]) > 200 and len(whole[1]) > 5
    assert drawn(spark, streams, size) == whole


def test_one_fold_and_a_row_for_each_clip(spark):
    clip = [("re", [0, 0, 1, 1]), ("W", []), ("n", [])]
    ops = [x for i in range(40) for x in (*clip, *LINE, ("f", []))] + [("re", [float("inf"), 0, 1, 1]), ("W*", []), ("n", []), ("Do", [], "X")]
    rows = [("b", i, o[0], [float(v) for v in o[1]], o[2] if len(o) > 2 else None, None) for i, o in enumerate(ops)]
    boards = spark.createDataFrame([("b", 100.0, 100.0)], "board_id string, width double, height double")
    resources = spark.createDataFrame([("b", "X", "raster", "X")], "board_id string, name string, kind string, asset_id string")
    none = [spark.createDataFrame([], f"board_id string, name string, {c}") for c in ("opacity double", "space string")]
    nodes, errors = interpret.interpret(spark.createDataFrame(rows, OPS), boards, resources, *none)
    # Without clips nothing is folded or joined to them again.
    plan = nodes.drop("clips")._jdf.queryExecution().optimizedPlan().toString() + errors._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
    found = nodes.orderBy("op_seq").collect()
    assert [len(r.clips) for r in found] == [*range(1, 41), 41] and found[-1].clips[-1].rule == "evenodd"
    assert [r.clips_finite for r in found] == [True] * 40 + [False]
    scene = interpret.scene_nodes(interpret.place_shapes(nodes, spark.createDataFrame([], "board_id string, resource string, shape_seq int, path array<string>, color string, opacity double").select("board_id", "resource", "shape_seq", F.lit(None).cast("array<struct<start:struct<x:double,y:double>,segments:array<struct<first:struct<x:double,y:double>,second:struct<x:double,y:double>,end:struct<x:double,y:double>>>>>").alias("path"), F.lit(None).cast("struct<r:double,g:double,b:double>").alias("color"), "opacity")), spark.createDataFrame([], "board_id string, annot_seq long, target struct<kind:string,video_id:string,url:string>, bounds struct<x:double,y:double,width:double,height:double>"))
    assets = spark.createDataFrame([("b", "X", "x.png", 8, 8)], "board_id string, asset_id string, file string, width int, height int")
    told, read = ({(r.rule, r.n) for r in validate.violations(boards, assets, x).collect()} for x in (scene.drop("clips"), scene.drop("clips_finite")))
    assert told == read == {(7, 1)}


def test_live_operators():
    def live(ops):
        found = interpret.Live()
        for i, op in enumerate(ops.split()):
            found.add(i, op)
        return [i for i in found.kept if i is not None]

    assert live("n " + "q cm Do Q " * 1000 + "m l S " * 1000) == [0]
    assert live("n g g sc sc rg w w") == [0, 5, 7]
    assert live("n q cm m Q l") == [0, 1, 2, 3, 4, 5] and live("n q cm m f Q") == [0]
    assert live("n m W n q re W n Q") == [0, 1, 2, 3]
    assert live("n w cm Q cm") == [0, 3, 4]
    assert live("q m f Q") == [0, 1, 2, 3], "the first paint may end an earlier slice's path"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_checks_and_path_numbers_of_slices(spark, size):
    ops = ["q", "m", "f", "Q", "m", "W", "n", "q", "Do", "Q", "m", "S"]
    streams = {"good": ops, "deep": [*ops, "Q", "zz"], "odd": [*ops, "zz", "Q"], "open": [*ops, "q"]}
    rows = spark.createDataFrame([(b, i, op) for b, s in streams.items() for i, op in enumerate(s)], "board_id string, seq int, op string")
    assert {r.board_id: r.error for r in interpret.check_streams(rows, size).collect()} == {"good": None, "deep": interpret.EMPTY_STACK, "odd": "unsupported operator zz", "open": interpret.OPEN_STACK}
    numbers = interpret.path_numbers(rows, size).where("board_id = 'good'").orderBy("seq").collect()
    assert [r.path_no for r in numbers] == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 2]


def test_matrices(spark):
    row = spark.range(1).select(
        geometry.board_matrix(geometry.matrix(*map(F.lit, (1, 0, 0, 1, 10, 20))), F.lit(100.0)).alias("board"),
        geometry.image_matrix(geometry.matrix(*map(F.lit, (2, 0, 1, 3, 10, 20)))).alias("image"),
        geometry.multiply(geometry.matrix(*map(F.lit, geometry.IDENTITY)), geometry.matrix(*map(F.lit, (1, 2, 3, 4, 5, 6)))).alias("same"),
    ).first()
    assert tuple(row.board) == (1, 0, 0, -1, 10, 80) and tuple(row.image) == (2, 0, -1, -3, 11, 23) and tuple(row.same) == (1, 2, 3, 4, 5, 6)


@pytest.mark.parametrize(("url", "kind", "video"), [
    ("https://GAMES.example.org/arcade/#/games/x", "game", None), ("http://games.example.org/arcade/#/games/x", "external", None), ("https://u@games.example.org/arcade/#/games/x", "external", None),
    ("https://games.example.org:443/arcade/#/games/x", "external", None), ("https://games.example.org/other/#/games/x", "external", None), ("https://games.example.org/arcade/", "external", None),
    ("https://games.example.org.evil.org/arcade/#/games/x", "external", None), ("https://youtu.be/abcdefghijk", "video", "abcdefghijk"), ("https://www.youtube.com/watch?v=abcdefghijk", "video", "abcdefghijk"),
    ("https://youtube.com/shorts/abcdefghijk", "video", "abcdefghijk"), ("https://m.youtube.com/embed/abcdefghijk/", "video", "abcdefghijk"), ("https://youtu.be/abcdefghij", "external", None),
    ("https://youtu.be/abcdefghijkl", "external", None), ("https://youtube.com/watch?v=&v=abcdefghijk", "external", None), ("ftp://x.org/a", None, None), ("relative/path", None, None), ("https://x.org/%zz", None, None), ("https://x.org/a b", None, None),
])
def test_urls(spark, url, kind, video):
    row = spark.createDataFrame([(url,)], "u string").select(links.classify(F.col("u"), RULE).alias("t")).first().t
    assert (row.kind, row.video_id) == (kind, video) and (row.error is None) == (kind is not None)


def test_labels_and_texts(spark):
    row = spark.range(1).select(
        links.game_label(F.lit("https://games.example.org/arcade/#/games/a-b%FF"), RULE).alias("bad"),
        links.game_label(F.lit("https://games.example.org/arcade/#/games/a-b%20c+d"), RULE).alias("good"),
        text.escape_html(F.lit("<Notes & \"Ideas\"'>")).alias("escaped"),
        text.render_template(F.lit("{{SITE_TITLE}}|{{SITE_ARIA_LABEL}}"), F.lit("{{SITE_ARIA_LABEL}}")).alias("page"),
        text.path_data(F.array(geometry.command("move", geometry.point(F.lit(12.3456), F.lit(-0.0004))), geometry.command("curve", geometry.point(F.lit(5.5), F.lit(6)), geometry.point(F.lit(1), F.lit(2)), geometry.point(F.lit(3.1), F.lit(4))), geometry.command("close"))).alias("path"),
        text.title_error(F.lit(" \t ")).alias("blank"), text.title_error(F.lit("a\tb")).alias("control"), text.title_error(F.lit(" ok ")).alias("ok"),
        text.body_is_ready(F.lit('<body data-ready="true">')).alias("ready"), text.body_is_ready(F.lit('<body><p data-ready="true">')).alias("not_ready"),
    ).first()
    assert row.bad == "Play a b%FF in Example Arcade" and row.good == "Play a b c+d in Example Arcade"
    assert row.escaped == "&lt;Notes &amp; &quot;Ideas&quot;&#39;&gt;" and row.page == "{{SITE_ARIA_LABEL}}|Zoomable page: {{SITE_ARIA_LABEL}}"
    assert row.path == "M12.346,0C1,2 3.1,4 5.5,6Z" and row.blank == text.EMPTY_TITLE and row.control == text.CONTROL_TITLE and row.ok is None
    assert row.ready and not row.not_ready


def test_scenes(spark):
    def m(*v):
        return dict(zip("abcdef", map(float, v), strict=True))

    def image(matrix, asset="A", opacity=1.0):
        return {"kind": "image", "asset_id": asset, "matrix": m(*matrix), "opacity": opacity, "clips": []}

    small = image((10, 0, 0, 10, 0, 0))
    path = {"kind": "path", "clips": [], "commands": [{"kind": "move", "first": None, "second": None, "end": {"x": 1.0, "y": 1.0}}], "style": {"fill": None, "fill_rule": None, "stroke": None, "line_width": 1.0, "miter_limit": 10.0, "dash": [], "dash_phase": 0.0, "opacity": 1.0}}
    cases = {
        "ok": [small], "missing": [small, image((10, 0, 0, 10, 0, 0), "B")], "full": [image((100, 0, 0, 100, 0, 0))], "near": [image((100 - 1e-9, 0, 0, 100, 0, 0))], "unused": [path], "sheared": [image((100, 100, 100, 0, 0, 0))],
        "infinite": [small, path | {"commands": [{"kind": "move", "first": None, "second": None, "end": {"x": float("inf"), "y": 1.0}}]}], "opacity": [image((10, 0, 0, 10, 0, 0), opacity=float("nan"))],
        "dash": [small, path | {"style": path["style"] | {"dash": [0.0, 0.0]}}], "miter": [small, path | {"style": path["style"] | {"miter_limit": 0.5}}], "huge": [image((2e306, 0, 0, 2e306, -1e306, -1e306))],
        "area": [small, {"kind": "svg-document", "bounds": {"x": 0.0, "y": 0.0, "width": 0.0, "height": 1.0}, "href": "x"}],
    }
    schema = spark.createDataFrame([], validate.NODES).schema
    rows = [{f.name: None for f in schema} | {"board_id": b, "node_seq": i} | n for b, nodes in cases.items() for i, n in enumerate(nodes)]
    nodes = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    boards = spark.createDataFrame([(b, 100.0, 100.0) for b in cases] + [("flat", 0.0, 1.0), ("twice", 1.0, 1.0)], "board_id string, width double, height double")
    assets = spark.createDataFrame([(b, "A", "a.png", 1, 1) for b in [*cases, "twice", "twice"]], "board_id string, asset_id string, file string, width int, height int")
    got = {r.board_id: r.error_message for r in validate.validate_scenes(boards, assets, nodes).collect()}
    say = validate.MESSAGES
    assert got == {"ok": None, "missing": say[4], "full": say[8], "near": say[8], "unused": say[5], "sheared": None, "infinite": say[6], "opacity": say[6], "dash": say[7], "miter": say[7], "huge": say[8], "area": say[7], "flat": say[0], "twice": say[2]}


def svg(body="", size='width="72pt" height="1in"'):
    return f'<svg xmlns="http://www.w3.org/2000/svg" xmlns:l="http://www.w3.org/1999/xlink" {size}>{body}</svg>'


def test_markup(spark):
    cases = {
        "ok": (svg(), None), "percent": (svg(size='width="100%" viewBox="0 0 640,480"'), None), "signs": (svg(size='viewBox="-.5 +.5 64 48"'), None),
        "one": (svg(size='width="5"'), "width and height must both be absolute lengths, or neither"), "plain": ('<svg width="1" height="1"/>', markup.NO_SVG), "script": (svg("<script/>"), markup.BANNED["script"]),
        "xhtml": (svg('<p xmlns="http://www.w3.org/1999/xhtml"/>'), markup.XHTML), "on": (svg('<g onclick="x"/>'), markup.EVENT_HANDLER), "foreign": (svg("<foreignObject/>"), markup.BANNED["foreignObject"]),
        "image": (svg('<image href="x.png"/>'), "SVG references an external resource: x.png"), "css": (svg("<rect fill=\"URL( 'paint.svg#p' )\"/>"), "SVG references an external resource: paint.svg#p"),
        "style": (svg("<style>a{b:url(https://x)}</style>"), "SVG references an external resource: https://x"), "import": (svg("<style>@imp<!-- -->ort</style>"), markup.IMPORT),
        "text": (svg('<textPath l:href="data:x"/>'), "SVG textPath elements must reference an element in the same file"), "data": (svg('<image l:href="DATA:image/png,x"/><use href="#a"/>'), None),
        "into": (svg('<rect fill="url(data:x#y)"/>'), markup.INTO_DATA), "sheet": ('<?xml-stylesheet href="x"?>' + svg(), markup.STYLESHEET),
    }
    docs = spark.createDataFrame([(k, bytearray(v.encode())) for k, (v, _) in cases.items()] + [("bad", bytearray(b"<svg>"))], "doc_id string, content binary")
    got = {r.doc_id: r for r in markup.audit_markup(markup.tokenize_markup(docs)).collect()}
    assert {k: r.error_message for k, r in got.items() if k != "bad"} == {k: m for k, (_, m) in cases.items()}
    assert got["bad"].error_kind == "invalid_svg"
    assert (got["ok"].width, got["ok"].height) == (96, 96) and (got["percent"].width, got["percent"].height) == (640, 480) and (got["signs"].width, got["signs"].height) == (64, 48)
    uri = spark.createDataFrame([(bytearray(b"x" * 100),)], "c binary").select(sinks.svg_data_uri(F.col("c"))).first()[0]
    assert "\n" not in uri and "\r" not in uri


def rendering(spark, cells, dpi=18, board="b"):
    return spark.createDataFrame([(board, dpi, x, y, *c) for (x, y), c in cells.items()], "board_id string, dpi int, x int, y int, r int, g int, b int")


def test_renderings(spark):
    white, black = (255, 255, 255), (0, 0, 0)
    blank = {(x, y): white for x in range(100) for y in range(100)}
    a, b = rendering(spark, blank), rendering(spark, blank | {(5, 5): black})
    (row,) = evaluate.compare(a, b).collect()
    assert not row.passed and row.ink_ratio == 0 and row.error is None
    assert evaluate.detail_regions(evaluate.paired(a, b)).count() == 0
    (same,) = evaluate.compare(a, a).collect()
    assert same.passed and same.ink_ratio == 1
    (other,) = evaluate.compare(a, rendering(spark, {(0, 0): white})).collect()
    assert other.error == evaluate.SIZES_DIFFER and not other.passed
    strip = {(x, 0): white for x in range(96)}
    ref = rendering(spark, strip | {(10, 0): (100,) * 3, (74, 0): black})
    regions = evaluate.detail_regions(evaluate.paired(ref, rendering(spark, strip))).orderBy("number").collect()
    assert [(r.x, r.y, r.width, r.height) for r in regions] == [(64, 0, 32, 1), (0, 0, 32, 1)]
    colored = rendering(spark, strip | {(10, 0): (1, 2, 3)})
    assert evaluate.detail_regions(evaluate.paired(colored, rendering(spark, strip))).count() == 0
    plan = evaluate.capture_plan(spark.createDataFrame([("s", 6051, 3020), ("l", 24204, 12080), ("n", 0, 5)], "board_id string, width int, height int"))
    assert {r.board_id: r["count"] for r in plan.groupBy("board_id").count().collect()} == {"s": 1, "l": 9}


def test_sources(spark):
    rows = [("a", "/a/notes/Board.SVG", False), ("b", "/b/board.png", False), ("c", "/c/x.pdf", False), ("c", "/c/y.svg", False), ("d", "/d/build/x.pdf", False), ("e", "/e/x.pdf", True)]
    manifest = spark.createDataFrame(rows, "root string, path string, is_symlink boolean")
    got = {r.root: (r.format, r.error) for r in discovery.single_source(manifest, discovery.discover(manifest)).collect()}
    say = "expected exactly one PDF or SVG source file, found "
    assert got == {"a": ("svg", None), "b": (None, say + "0"), "c": (None, say + "2"), "d": (None, say + "0"), "e": (None, say + "0")}


def test_planes(spark):
    rows = [("short", 1, 1, 3, bytearray(b"x"), None), ("gray", 2, 1, 1, bytearray(b"\x07\x08"), bytearray(b"\x01\x5f")), ("mask", 1, 1, 1, bytearray(b"x"), bytearray(b"")), ("four", 1, 1, 4, bytearray(b"xxxx"), None)]
    pixels, errors = images.decode(spark.createDataFrame(rows, "image_id string, width int, height int, components int, color binary, alpha binary"))
    assert sorted(tuple(r) for r in pixels.collect()) == [("gray", 0, 0, 7, 7, 7, 1), ("gray", 1, 0, 8, 8, 8, 95)]
    assert {r.image_id for r in errors.collect()} == {"short", "mask", "four"}


def test_cover_against_fractions(spark):
    import random
    from fractions import Fraction

    def covers(a, b, c, d, e, f, w, h):
        det, slack = a * d - b * c, Fraction(1, 10**9)
        corners = [(x - e, y - f) for x in (0, w) for y in (0, h)]
        return det != 0 and all(-slack <= u <= 1 + slack for x, y in corners for u in ((d * x - c * y) / det, (a * y - b * x) / det))

    pick, rows = random.Random(3), []
    for _ in range(300):
        w, h = pick.choice([1.0, 3.0, 0.1]), pick.choice([1.0, 0.3])
        a, d = pick.choice([w, w * (1 + 1e-9), w / (1 + 1e-9), 2 * w, 0.0, -w]), pick.choice([h, 3 * h, h * 0.999])
        if pick.random() < 0.3:  # large terms, small determinants
            a, d = a * 1e9, pick.choice([d, d * 1e-12, d * 1e150])
        rows.append((a, pick.choice([0.0, 1e-12, 0.5]), pick.choice([0.0, -1e-10]), d, pick.choice([0.0, w, -1e-9]), pick.choice([0.0, -1e-9 * h]), w, h))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double, e double, f double, bw double, bh double")
    got = {r.id for r in validate.covers_board(df.selectExpr("id", "struct(a, b, c, d, e, f) AS matrix", "bw", "bh")).collect()}
    want = {i: covers(*map(Fraction, r)) for i, r in enumerate(rows)}
    assert got == {i for i, yes in want.items() if yes}
    assert 0 < sum(want.values()) < len(want)


def test_documents_that_share_an_id_are_audited_as_one(spark):
    good, bad = b'<svg xmlns="http://www.w3.org/2000/svg" width="1" height="2"/>', b"<svg"
    docs = spark.createDataFrame([("x", good), ("x", good), ("y", good), ("y", bad), (None, good), ("z", None)], "doc_id string, content binary")
    got = {r.doc_id: (r.status, r.width, r.n_violations) for r in markup.audit_markup(markup.tokenize_markup(docs)).collect()}
    assert got == {"x": ("ok", 1.0, 0), "y": ("error", None, 1), None: ("ok", 1.0, 0), "z": ("error", None, 1)}
    assert markup.audit_markup(markup.tokenize_markup(docs.limit(0))).count() == 0


def test_scan(spark, tmp_path):
    for name in ("a/Board.PDF", "a/b/x.svg", "a/build/y.svg", "a/z.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = discovery.discover(discovery.scan(spark, f"file://{tmp_path}"))
    assert sorted((r.path.rsplit("/", 1)[1], r.format) for r in found.collect()) == [("Board.PDF", "pdf"), ("x.svg", "svg")]


def test_page_size_and_order(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([4.0, 2.0, 1.0, 8.0],), ([0.0, 0.0, 5.0, 0.0],), (None,)], "box array<double>")
    got = [tuple(r.p) for r in rows.select(geometry.page_size(F.col("box")).alias("p")).collect()]
    bad = (None, None, "page dimensions must be positive")
    assert got == [(3.0, 6.0, None), bad, bad, bad]
    names = spark.createDataFrame([("b", "Im2"), ("b", "Im10"), ("a", "é"), ("a", "Z")], "board_id string, name string")
    assert [r.name for r in sinks.by_name(names).collect()] == ["Z", "é", "Im10", "Im2"]


NODES = "board_id string, node_seq bigint, kind string"


def made_nodes(spark, boards, kind="link"):
    return spark.createDataFrame([(b, i, kind) for b in boards for i in (2, 1)], NODES)


def boards_of(spark, path):
    return {r.board_id: (r.n, r.kinds) for r in sinks.published(spark, path).groupBy("board_id").agg(F.count("*").alias("n"), F.max(F.get_json_object("json", "$.kind")).alias("kinds")).collect()}


@pytest.mark.parametrize("buckets", [1, 4, 1000])
def test_publish_leaves_other_boards(spark, tmp_path, buckets):
    path, names = f"file://{tmp_path}/out", [f"b{i}" for i in range(20)]
    assert sinks.published(spark, path).count() == 0
    sinks.publish(made_nodes(spark, names), path, buckets)
    sinks.publish(made_nodes(spark, ["b7"], "image"), path, 3)  # the number of buckets is the first one's
    assert boards_of(spark, path) == {b: (2, "image" if b == "b7" else "link") for b in names}
    sinks.publish(made_nodes(spark, ["b3", "new"], "path"), path)
    want = {b: (2, {"b7": "image", "b3": "path", "new": "path"}.get(b, "link")) for b in [*names, "new"]}
    assert boards_of(spark, path) == want
    sinks.publish(made_nodes(spark, []), path)
    assert boards_of(spark, path) == want
    gone = sinks.vacuum(spark, path)
    assert gone >= 1 and boards_of(spark, path) == want and sinks.vacuum(spark, path) == 0


def test_publish_boards_without_nodes(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.publish(made_nodes(spark, ["a", "b"]), path, 1)
    both = spark.createDataFrame([("a",), ("b",)], "board_id string")
    sinks.publish(made_nodes(spark, ["a"], "image"), path, boards=both)
    assert boards_of(spark, path) == {"a": (2, "image")}
    sinks.publish(made_nodes(spark, []), path, boards=both)
    assert boards_of(spark, path) == {}


def test_a_job_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    sinks.publish(made_nodes(spark, ["a", "b"]), path, 4)

    def dies(*args):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_promote", dies)
        with pytest.raises(OSError):
            sinks.publish(made_nodes(spark, ["b", "c"], "image"), path)
    assert boards_of(spark, path) == {"a": (2, "link"), "b": (2, "link")}
    broken = made_nodes(spark, ["b"], "image").withColumn("node_seq", F.expr("CAST(raise_error('x') AS bigint)"))
    with pytest.raises(Exception, match="x"):
        sinks.publish(broken, path)
    assert boards_of(spark, path) == {"a": (2, "link"), "b": (2, "link")}
    assert sinks.vacuum(spark, path) >= 1
    assert boards_of(spark, path) == {"a": (2, "link"), "b": (2, "link")}


def test_two_jobs_at_once(spark, tmp_path):
    """The second to promote fails and says so; what the first wrote stays."""
    path = f"file://{tmp_path}/out"
    sinks.publish(made_nodes(spark, ["a"]), path, 2)
    number, versions = sinks._manifest(spark, path)
    sinks.publish(made_nodes(spark, ["b"]), path)
    with pytest.raises(RuntimeError, match="meanwhile"):
        sinks._promote(spark, path, number + 1, versions)
    assert set(boards_of(spark, path)) == {"a", "b"}


def test_stitch(spark):
    rows = spark.createDataFrame([("b", 0, 0, 1, 2), ("b", 8, 4, 1, 2)], "board_id string, tile_x int, tile_y int, x int, y int")
    assert sorted((r.x, r.y) for r in evaluate.stitch(rows).collect()) == [(1, 2), (9, 6)]


def test_assets_and_references_meet_once(spark):
    """Missing, unused, doubled and flat assets, those without a name too, counted in one exchange by asset."""
    boards = spark.createDataFrame([("b", 1.0, 1.0)], "board_id string, width double, height double")
    assets = spark.createDataFrame([("b", n, "f", w, 1) for n, w in (("one", 1), ("two", 1), ("two", 0), ("unused", 1), (None, 1))], "board_id string, asset_id string, file string, width int, height int")
    nodes = spark.createDataFrame([("b", i, "image", n, 1.0) for i, n in enumerate(("one", "one", "two", "missing", "missing", None))], "board_id string, node_seq bigint, kind string, asset_id string, opacity double")
    nodes = spark.createDataFrame([], validate.NODES).unionByName(nodes, allowMissingColumns=True)
    found = {r.rule: r.n for r in validate.violations(boards, assets, nodes).collect()}
    assert found == {3: 1, 4: 1, 5: 3, 6: 2}


def test_boards_are_validated_once_for_both_publications(spark, monkeypatch):
    from inkfold.plans import queries

    plans = []
    monkeypatch.setattr(queries.sinks, "publish", lambda nodes, path, **more: plans.append(nodes._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(queries.sinks, "published", lambda spark, path: spark.createDataFrame([], "board_id string, node_seq bigint, json string"))
    queries.published_nodes(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and "Window" not in plans[0] and "MapInArrow" not in plans[0] + plans[1]


def test_violations_apply_the_rules_once(spark):
    """The plan has the rules in the projection below the explode alone, not again in filters."""
    docs = spark.createDataFrame([("a", b"<svg/>"), ("b", b"<g>")], "doc_id string, content binary")
    found = markup.rule_counts(markup.tokenize_markup(docs)).where("kind = 'unsupported_svg'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter") and "SVG" in line]
    assert {(r.doc_id, r.kind) for r in markup.violations(markup.tokenize_markup(docs)).collect()} == {("a", "invalid_svg"), ("b", "invalid_svg")}
