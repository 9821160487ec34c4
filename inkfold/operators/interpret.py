"""Drawing operators to scene nodes.

operators(board_id, seq, op, nums, name, dash), each with a position of its own. What names stand for comes ahead of a board's
operators, so that these are dealt out once and joined with nothing. The fold runs once: its rows are written, and a clip is one
row there, which names the clip under it; whole lists of clips are made only for those who read them. A board stops at its first error, others go on. A long board is more than a task should do, so its stream is cut into slices of `SLICE` positions that are folded apart:

1. Each slice keeps its live operators, those that still matter at its end: no `q` with its `Q` and what's between, no path
   that is painted, of colors, widths and the like only the last at each depth. Mostly that's next to nothing.
2. A board's live operators, in order, give the state that each of its slices starts in. They are the same steps on the same
   numbers as in one fold of the whole board, so states are equal to the last bit; products of matrices wouldn't be.
3. Each slice is folded from its state. Of a board's errors the first by position counts: all before it is right, and what
   a slice makes of a state after it isn't used.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from inkfold.constants import SIMILARITY_TOLERANCE
from inkfold.functions import geometry
from inkfold.operators.validate import CLIPS, COMMANDS, MATRIX, STYLE
from inkfold.tables import materialize

# The operators of a board, a fixed table: name -> how many numbers it takes (None: any), and what it says if they're wrong.
NUMBERS = {
    "q": (0, ""), "Q": (0, ""), "cm": (6, "matrix operator expected six numbers"), "w": (1, "operator expected a number"),
    "M": (1, "operator expected a number"), "d": (1, "operator expected a number"), "SC": (None, ""), "sc": (None, ""),
    "g": (1, "operator expected a number"), "G": (1, "operator expected a number"), "rg": (3, "RGB operator expected three numbers"),
    "RG": (3, "RGB operator expected three numbers"), "k": (4, "CMYK operator expected four numbers"), "K": (4, "CMYK operator expected four numbers"),
    "m": (2, "path operator expected two numbers"), "l": (2, "path operator expected two numbers"), "c": (6, "curve operator expected six numbers"),
    "v": (4, "shorthand curve operator expected four numbers"), "y": (4, "shorthand curve operator expected four numbers"),
    "h": (0, ""), "re": (4, "rectangle operator expected four numbers"), "W": (0, ""), "W*": (0, ""), "n": (0, ""),
    "S": (0, ""), "s": (0, ""), "f": (0, ""), "F": (0, ""), "f*": (0, ""), "B": (0, ""), "B*": (0, ""), "b": (0, ""), "b*": (0, ""),
    "Do": (0, ""), "gs": (0, ""), "CS": (0, ""), "cs": (0, ""), "ri": (None, ""), "BMC": (None, ""), "BDC": (None, ""), "EMC": (None, ""),
}
NAMED = {"Do": "Do expected an image resource name", "gs": "gs expected a graphics-state name", "CS": "color-space operator expected a name", "cs": "color-space operator expected a name"}
#: Painting: does it close the path first, fill, stroke, and by which rule.
PAINTS = {"S": (0, 0, 1, "nonzero"), "s": (1, 0, 1, "nonzero"), "f": (0, 1, 0, "nonzero"), "F": (0, 1, 0, "nonzero"), "f*": (0, 1, 0, "evenodd"), "B": (0, 1, 1, "nonzero"), "B*": (0, 1, 1, "evenodd"), "b": (1, 1, 1, "nonzero"), "b*": (1, 1, 1, "evenodd")}
#: What an operator sets anew, whatever was before; only the last of a kind matters.
SETS = {"w": "width", "M": "miter", "d": "dash", "gs": "opacity", "g": "fill", "rg": "fill", "k": "fill", "cs": "fill", "G": "stroke", "RG": "stroke", "K": "stroke", "CS": "stroke"}
CLIPPING = frozenset({"W", "W*"})
PATHS = frozenset({"m", "l", "c", "v", "y", "h", "re"})
#: Positions of a board's stream that are folded together.
SLICE = 50_000
DEVICES = {"DeviceGray": "gray", "DeviceRGB": "rgb", "DeviceCMYK": "cmyk"}
EMPTY_STACK = "Q tried to restore an empty graphics-state stack"
OPEN_STACK = "content stream ended before every q had a matching Q"
TEXT = "PDF text requires font decoding and metrics"


def _slice(size: int) -> Column:
    return F.floor(F.col("seq") / size)


def _running(rows: DataFrame, value: str, to: int) -> DataFrame:
    """rows(board_id, seq, slice_no) with `before`, the board's sum of value up to `to` rows from each.

    Each slice's own running sum, and the sum of the slices before it. So a window holds a slice, or a row for each slice.
    """
    key = ["board_id", "slice_no"]
    sums = rows.groupBy(*key).agg(F.sum(value).alias("own"))
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy("board_id").orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("board_id").alias("b"), F.col("slice_no").alias("s"), earlier.alias("earlier"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, to)), F.lit(0))
    met = rows.withColumn("own", own).join(starts, F.col("board_id").eqNullSafe(F.col("b")) & F.col("slice_no").eqNullSafe(F.col("s")))
    return met.withColumn("before", F.col("earlier") + F.col("own")).drop("b", "s", "earlier", "own")


def check_streams(operators: DataFrame, size: int = SLICE) -> DataFrame:
    """board_id, error: balance of q and Q, and operators that are unknown, by windows of slices. First by position."""
    delta = F.when(F.col("op") == "q", 1).when(F.col("op") == "Q", -1).otherwise(0)
    rule = F.broadcast(operators.sparkSession.createDataFrame([(op,) for op in NUMBERS], "op string").withColumn("known", F.lit(True)))
    deep = _running(operators.select("board_id", "seq", "op", _slice(size).alias("slice_no"), delta.alias("delta")), "delta", 0)
    rows = deep.withColumnRenamed("before", "depth").join(rule, "op", "left")
    error = F.when(F.col("depth") < 0, EMPTY_STACK).when(F.col("op") == "BT", TEXT).when(F.col("known").isNull(), F.concat(F.lit("unsupported operator "), "op"))
    found = rows.withColumn("error", error).groupBy("board_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("first"), F.sum("delta").alias("left"))
    return found.select("board_id", F.coalesce(F.col("first.error"), F.when(F.col("left") != 0, OPEN_STACK)).alias("error"))


def path_numbers(operators: DataFrame, size: int = SLICE) -> DataFrame:
    """Each path operator with the number of the path it belongs to: how many paints came before it on its board."""
    ends = operators.withColumns({"slice_no": _slice(size), "ends": F.coalesce(F.col("op").isin(*PAINTS, "n").cast("int"), F.lit(0))})
    return _running(ends, "ends", -1).withColumnRenamed("before", "path_no").drop("slice_no", "ends")


#: What comes ahead of a slice's operators: a row of its board, then a row for each name.
_HEAD = "struct<height:double,last_slice:bigint,state:binary,use:string,r_kind:string,r_asset:string,alpha:double,space:string>"


def _names(resources: DataFrame, alphas: DataFrame, colorspaces: DataFrame) -> DataFrame:
    """board_id, name and what it stands for, by its use."""
    r = resources.select("board_id", "name", F.lit("Do").alias("use"), F.col("kind").alias("r_kind"), F.col("asset_id").alias("r_asset"))
    a = alphas.select("board_id", "name", F.lit("gs").alias("use"), F.col("opacity").cast("double").alias("alpha"))
    s = colorspaces.select("board_id", "name", F.lit("cs").alias("use"), "space")
    return r.unionByName(a, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)


def _led(operators: DataFrame, slices: DataFrame, names: DataFrame) -> DataFrame:
    """operators and, ahead of them in each of slices(board_id, slice_no, height, last_slice, state), what they need: place 0 and 1."""

    def head(rows: DataFrame, place: int) -> DataFrame:
        own = {f.split(":")[0]: f.split(":")[1] for f in _HEAD[7:-1].split(",")}
        held = F.struct(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in own.items()))
        return rows.select("board_id", "slice_no", F.lit(place).alias("place"), *([F.col("name")] if place else []), held.alias("head"))

    at = slices.select("board_id", "slice_no")
    rows = operators.select("board_id", "slice_no", F.lit(2).alias("place"), F.col("seq").cast("long").alias("seq"), "op", F.col("nums").cast("array<double>").alias("nums"), "name", F.col("dash").cast("array<double>").alias("dash"), F.lit(None).cast(_HEAD).alias("head"))
    return rows.unionByName(head(slices, 0), allowMissingColumns=True).unionByName(head(names.join(at, "board_id"), 1), allowMissingColumns=True)


class Graphics(NamedTuple):
    matrix: tuple = geometry.IDENTITY
    #: The position of the paint that made the last clip, and whether it and all clips under it are finite.
    clip: int | None = None
    clips_finite: bool = True
    opacity: float = 1.0
    fill: tuple = (0.0, 0.0, 0.0)
    stroke: tuple = (0.0, 0.0, 0.0)
    fill_space: str = "gray"
    stroke_space: str = "gray"
    width: float = 1.0
    miter: float = 10.0
    dash: tuple = ()
    phase: float = 0.0


@dataclass
class Board:
    """The state of one board's fold. Restoring graphics leaves the path and the pending clip alone."""

    height: float
    now: Graphics = field(default_factory=Graphics)
    stack: list = field(default_factory=list)
    path: list = field(default_factory=list)
    start: tuple | None = None
    at: tuple | None = None
    clip: str | None = None
    error: tuple | None = None
    #: By use and name: kind and asset of a resource, the alpha, or the space.
    names: dict = field(default_factory=dict)


class Rejected(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


def _bad(message: str) -> Rejected:
    return Rejected("invalid_structure", message)


def _times(m: tuple, n: tuple) -> tuple:
    """m first."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def _scale(m: tuple) -> float:
    a, b, c, d = m[:4]
    one, two = a * a + b * b, c * c + d * d
    if a * d - b * c != 0 and abs(one - two) <= SIMILARITY_TOLERANCE * max(one, two) and abs(a * c + b * d) <= SIMILARITY_TOLERANCE * math.sqrt(one * two):
        return math.sqrt(one)
    raise Rejected("unsupported_operator", "stroked paths require a non-singular similarity transform")


def _rgb(c: tuple | None) -> dict | None:
    return None if c is None else dict(zip("rgb", c, strict=True))


def _put(board: Board, kind: str, end: tuple | None = None, first: tuple | None = None, second: tuple | None = None) -> None:
    board.path.append((kind, first, second, end))
    if kind == "move":
        board.start = end
    board.at = end if kind != "close" else board.start


def _color(space: str, nums: list[float]) -> tuple:
    if space == "gray":
        if len(nums) != 1:
            raise _bad("gray color operator expected one number")
        return (nums[0],) * 3
    if space == "rgb":
        if len(nums) != 3:
            raise _bad(NUMBERS["rg"][1])
        return tuple(nums)
    if len(nums) != 4:
        raise _bad(NUMBERS["k"][1])
    if not all(0 <= v <= 1 for v in nums):
        raise _bad("CMYK components must be between 0 and 1")
    return tuple(1 - min(1, v + nums[3]) for v in nums[:3])


def _finite(path: list) -> bool:
    return all(math.isfinite(v) for _, *points in path for p in points if p is not None for v in p)


def _paint(board: Board, op: str, seq: int | None) -> list[dict]:
    """End the path: a node if it's painted and not empty; then the pending clip joins the clips."""
    found, now = [], board.now
    if op in PAINTS:
        closes, fills, strokes, rule = PAINTS[op]
        if closes:
            _put(board, "close")
        if board.path:
            by = _scale(now.matrix) if strokes else 1.0
            style = {
                "fill": _rgb(now.fill if fills else None), "fill_rule": rule if fills else None, "stroke": _rgb(now.stroke if strokes else None), "line_width": by * now.width,
                "miter_limit": now.miter, "dash": [by * v for v in now.dash], "dash_phase": by * now.phase, "opacity": now.opacity,
            }
            found.append({"kind": "path", "commands": board.path, "style": style, "clip": now.clip, "clips_finite": now.clips_finite})
    if board.clip:
        found.append({"kind": "clip", "rule": board.clip, "commands": board.path, "clip": now.clip})
        board.now = now._replace(clip=seq, clips_finite=now.clips_finite and _finite(board.path))
    board.path, board.start, board.at, board.clip = [], None, None, None
    return found


def _images(board: Board, name: str | None) -> list[dict]:
    if not name:
        raise _bad(NAMED["Do"])
    kind, asset = board.names.get(("Do", name), (None, None))
    if kind is None:
        raise _bad(f"missing image resource {name}")
    a, b, c, d, e, f = board.now.matrix
    matrix = dict(zip("abcdef", (a, -b, c, -d, e, board.height - f), strict=True))
    placed = {"a": matrix["a"], "b": matrix["b"], "c": -matrix["c"], "d": -matrix["d"], "e": matrix["e"] + matrix["c"], "f": matrix["f"] + matrix["d"]}
    common = {"matrix": placed, "opacity": board.now.opacity, "clip": board.now.clip, "clips_finite": board.now.clips_finite}
    art, raster = {"kind": "vector-artwork", "href": name, **common}, {"kind": "image", "asset_id": asset, **common}
    return {"vector": [art], "raster": [raster], "mixed": [art, raster]}[kind]


def step(board: Board, seq: int | None, op: str, nums: list[float], name: str | None, dash: list | None) -> list[dict]:
    """One operator: its nodes, and the clip that it makes, as a node of its own kind."""
    if op == "BT":
        raise Rejected("unsupported_operator", TEXT)
    if op not in NUMBERS:
        raise Rejected("unsupported_operator", op)
    count, says = NUMBERS[op]
    if count is not None and len(nums) != count:
        raise _bad(says) if says and count > 1 else Rejected("unsupported_operator", op)
    now, m = board.now, board.now.matrix

    def at(x: float, y: float) -> tuple:
        return (m[0] * x + m[2] * y + m[4], board.height - (m[1] * x + m[3] * y + m[5]))

    if op == "q":
        board.stack.append(now)
    elif op == "Q":
        if not board.stack:
            raise Rejected("graphics_state", EMPTY_STACK)
        board.now = board.stack.pop()
    elif op == "cm":
        board.now = now._replace(matrix=_times(tuple(nums), m))
    elif op == "w":
        board.now = now._replace(width=nums[0])
    elif op == "M":
        if nums[0] < 1:
            raise _bad("miter limit must be at least 1")
        board.now = now._replace(miter=nums[0])
    elif op == "d":
        if dash is None:
            raise _bad("dash pattern expected an array")
        dash = tuple(float(v) for v in dash)
        if any(v < 0 for v in dash):
            raise _bad("dash array values must be nonnegative")
        if dash and not any(dash):
            raise _bad("dash array must not contain only zeros")
        board.now = now._replace(dash=dash, phase=nums[0])
    elif op == "gs":
        if not name:
            raise _bad(NAMED["gs"])
        if (alpha := board.names.get(("gs", name))) is None:
            raise _bad(f"missing ExtGState resource {name}")
        board.now = now._replace(opacity=alpha)
    elif op in ("CS", "cs"):
        if not name:
            raise _bad(NAMED[op])
        space = DEVICES.get(name, board.names.get(("cs", name)))
        if space is None:
            raise Rejected("unsupported_operator", f"unsupported named color space: {name}") if ("cs", name) in board.names else _bad(f"missing color-space resource {name}")
        board.now = now._replace(**({"fill_space": space, "fill": (0.0,) * 3} if op == "cs" else {"stroke_space": space, "stroke": (0.0,) * 3}))
    elif op in ("SC", "sc", "g", "G", "rg", "RG", "k", "K"):
        fills = op.islower()
        space = {"g": "gray", "rg": "rgb", "k": "cmyk"}.get(op.lower()) or (now.fill_space if fills else now.stroke_space)
        color = _color(space, nums)
        board.now = now._replace(**({"fill": color, "fill_space": space} if fills else {"stroke": color, "stroke_space": space}))
    elif op in ("m", "l"):
        _put(board, "move" if op == "m" else "line", at(*nums))
    elif op == "c":
        _put(board, "curve", at(*nums[4:]), at(*nums[:2]), at(*nums[2:4]))
    elif op == "v":
        _put(board, "curve", at(*nums[2:]), board.at or (0.0, 0.0), at(*nums[:2]))
    elif op == "y":
        _put(board, "curve", at(*nums[2:]), at(*nums[:2]), at(*nums[2:]))
    elif op == "h":
        _put(board, "close")
    elif op == "re":
        x, y, w, h = nums
        for kind, p in (("move", (x, y)), ("line", (x + w, y)), ("line", (x + w, y + h)), ("line", (x, y + h))):
            _put(board, kind, at(*p))
        _put(board, "close")
    elif op in CLIPPING:
        board.clip = "nonzero" if op == "W" else "evenodd"
    elif op in PAINTS or op == "n":
        return _paint(board, op, seq)
    elif op == "Do":
        return _images(board, name)
    return []


def _lists(column: pa.ListArray) -> list[list | None]:
    """Lists by rows, from their values taken as one."""
    bounds, values = column.offsets.to_pylist(), column.values
    flat = values.to_pylist() if values.null_count else values.to_numpy().tolist()
    valid = column.is_valid().to_pylist() if column.null_count else [True] * len(column)
    return [flat[a:b] if held else None for a, b, held in zip(bounds, bounds[1:], valid, strict=False)]


def _lead(board: Board, name: str | None, head: dict) -> None:
    """A row ahead of the operators: what a name stands for."""
    use = head["use"]
    board.names[use, name] = (head["r_kind"], head["r_asset"]) if use == "Do" else head["alpha"] if use == "gs" else head["space"]


def _operators(batch: pa.RecordBatch) -> Iterator[tuple]:
    """board_id, slice_no, place, seq, op, nums, name, dash, head of each row, read a column at a time."""
    plain = ("board_id", "slice_no", "place", "seq", "op")
    columns = [batch.column(c).to_pylist() for c in plain]
    dashes = batch.column("dash")
    dashes = _lists(dashes) if dashes.null_count < len(dashes) else [None] * len(dashes)
    nums = [x or [] for x in _lists(batch.column("nums"))]
    return zip(*columns, nums, batch.column("name").to_pylist(), dashes, batch.column("head").to_pylist(), strict=True)


class Live:
    """The operators of a slice that still matter at its end, by their places, in order.

    A `q` goes with its `Q` and all between them, unless a path is begun there and not ended, or ended there and not begun.
    A path goes when it's painted; one that clips stays, until the `Q` of its clip. What the slice's first paint ends may have begun
    before the slice, so it stays. Of what sets the same anew at one depth, the last stays. Time is in proportion to the slice.
    """

    def __init__(self):
        self.kept: list = []
        #: Where in `kept` each open `q` is; what lies before them begins at `base`.
        self.opened: list[int] = []
        self.base = 0
        self.last: list[dict[str, int]] = [{}]
        #: Places in `kept` of the present path, and of each paint that stays with where its path begins (-1: before the slice).
        self.path: list[int] = []
        self.clips = False
        self.paints: list[tuple[int, int]] = []

    def _keep(self, place) -> int:
        self.kept.append(place)
        return len(self.kept) - 1

    def _drop(self, begin: int) -> bool:
        """Drop all from begin on, if each path that is in it begins and ends in it."""
        at = bisect.bisect_left(self.paints, (begin, -1))
        if (self.path and self.path[-1] >= begin) or (at < len(self.paints) and self.paints[at][1] < begin):
            return False
        del self.kept[begin:], self.paints[at:]
        return True

    def add(self, place, op: str) -> None:
        if op == "q":
            self.opened.append(self._keep(place))
            self.last.append({})
        elif op == "Q":
            if self.opened:
                self.last.pop()
                if not self._drop(self.opened.pop()):
                    self._keep(place)
            else:
                self._drop(self.base)
                self._keep(place)
                self.base, self.last = len(self.kept), [{}]
        elif op in PATHS or op in CLIPPING:
            self.clips |= op in CLIPPING
            self.path.append(self._keep(place))
        elif op in PAINTS or op == "n":
            if not self.begun:
                self.paints.append((self._keep(place), -1))
                if not self.opened:
                    self.base = len(self.kept)
            elif self.clips:
                self.paints.append((self._keep(place), self.path[0]))
            else:
                for at in self.path:
                    self.kept[at] = None
            self.path, self.clips, self.begun = [], False, True
        elif op in SETS or op.lower() == "sc":
            # sc takes the space that another has set, so it takes the place of an earlier sc only.
            last, kind = self.last[-1], SETS.get(op, op)
            for earlier in {kind} if kind == op else {kind, {"fill": "sc", "stroke": "SC"}.get(kind, kind)}:
                if earlier in last:
                    self.kept[last.pop(earlier)] = None
            last[kind] = self._keep(place)
        elif op == "cm":
            self._keep(place)

    #: Whether a paint was met, so that it's known where the present path begins.
    begun = False


_STATE = "board_id string, slice_no bigint, state binary"
_OUT = f"board_id string, op_seq bigint, sub_seq int, kind string, asset_id string, matrix {MATRIX}, opacity double, commands {COMMANDS}, style {STYLE}, href string, clip bigint, clips_finite boolean, rule string, error_seq bigint, error_kind string, error_message string"
#: An open q is an error after all others of its board.
_LAST = (1 << 63) - 1
_LIVE = ("board_id", "slice_no", "seq", "op", "nums", "name", "dash")


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by board, slice and position. Each slice gives a row without an operator, and its live operators after it."""
    last, live, held = None, Live(), {}

    def done() -> Iterator[pa.RecordBatch]:
        places: dict[int, list[int]] = {}
        for number, at in filter(None, live.kept):
            places.setdefault(number, []).append(at)
        for number, at in places.items():
            yield made(held[number].take(pa.array(at, pa.int64())).columns)

    def made(columns: list[pa.Array]) -> pa.RecordBatch:
        """Without marks of columns that hold no null, which differ between rows that begin a slice and others."""
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, f.type) for f in batch.schema]))

    def begins(at: int) -> pa.RecordBatch:
        return made([batch.column(f.name).slice(at, 1) if f.name in ("board_id", "slice_no") else pa.nulls(1, f.type) for f in batch.schema])

    for number, batch in enumerate(batches):
        # Batches of the slice at hand alone are held.
        held[number] = batch
        for at, (board, part, op) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("board_id", "slice_no", "op")), strict=True)):
            if (board, part) != last:
                yield from done()
                last, live, held = (board, part), Live(), {number: batch}
                yield begins(at)
            if op is not None:
                live.add((number, at), op)
    yield from done()


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What leads a board, then its live operators by slice and position, a row without one before each slice: the state each slice starts in."""
    board, first = None, True
    for batch in batches:
        out = []
        for key, part, place, seq, op, nums, name, dash, head in _operators(batch):
            if place == 0:
                board, first = Board(float(head["height"])), True
            elif place == 1:
                _lead(board, name, head)
            elif op is None:
                # After an error it doesn't matter what the other slices make of the board.
                if not first and not board.error:
                    names, board.names = board.names, {}
                    out.append({"board_id": key, "slice_no": part, "state": pickle.dumps(board)})
                    board.names = names
                first = False
            elif not board.error:
                try:
                    step(board, seq, op, nums, name, dash)
                except Rejected as e:
                    board.error = (e.kind, e.message)
        yield pa.RecordBatch.from_pylist(out, _STATES)


_STATES = pa.schema([("board_id", pa.string()), ("slice_no", pa.int64()), ("state", pa.binary())])


def _commands(paths: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    """Paths as lists of structs, made a column at a time."""
    flat = [c for path in paths if path for c in path]
    bounds = np.concatenate([[0], np.cumsum([len(p) if p else 0 for p in paths])]).astype(np.int32)
    points = []
    for i in (1, 2, 3):
        own = [c[i] for c in flat]
        xy = [pa.array([p[j] if p is not None else 0.0 for p in own], pa.float64()) for j in (0, 1)]
        points.append(pa.StructArray.from_arrays(xy, fields=list(kind.value_type.field(i).type), mask=pa.array([p is None for p in own], pa.bool_())))
    rows = pa.StructArray.from_arrays([pa.array([c[0] for c in flat], pa.string()), *points], fields=list(kind.value_type))
    none = pa.array([p is None for p in paths], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(bounds), rows, type=kind, mask=none)


def _made(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[r.get(f.name) for r in rows] for f in schema]
    return pa.RecordBatch.from_arrays([_commands(c, f.type) if f.name == "commands" else pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


def _folded(schema: pa.Schema):
    """Rows come by board and slice, what leads a slice first: its state, or none where a board begins, and its names; then by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, board, ends = None, None, False

        def end() -> list[dict]:
            return [_error(last[0], _LAST, "graphics_state", OPEN_STACK)] if board and ends and board.stack and not board.error else []

        for batch in batches:
            out: list[dict] = []
            for key, part, place, seq, op, nums, name, dash, head in _operators(batch):
                if place == 2:
                    # Without what leads it, it's on no board.
                    if board is None or op is None or board.error or last != (key, part):
                        continue
                    try:
                        for i, node in enumerate(step(board, seq, op, nums, name, dash)):
                            node["board_id"], node["op_seq"], node["sub_seq"] = key, seq, i
                            out.append(node)
                    except Rejected as e:
                        board.error = (e.kind, e.message)
                        out.append(_error(key, seq, e.kind, e.message))
                elif place == 0:
                    out += end()
                    last, ends = (key, part), part == head["last_slice"]
                    board = pickle.loads(head["state"]) if head["state"] is not None else Board(float(head["height"]))
                elif last == (key, part):
                    _lead(board, name, head)
            yield _made(out, schema)
        yield _made(end(), schema)

    return run


def _error(board: str, seq: int, kind: str, message: str) -> dict:
    return {"board_id": board, "error_seq": seq, "error_kind": kind, "error_message": message}


def _starts(operators: DataFrame, slices: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """board_id, slice_no, state of each slice but the first, of boards with more than one."""
    many = slices.where("first_slice < last_slice").select("board_id", "height").distinct()
    rows = operators.select(*_LIVE).join(many, "board_id", "left_semi")
    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    live = rows.repartition(n, "board_id", "slice_no").sortWithinPartitions("board_id", "slice_no", "seq").mapInArrow(_live, given)
    led = _led(live, many.withColumn("slice_no", F.lit(None).cast("long")), names)
    return led.repartition(n, "board_id").sortWithinPartitions("board_id", "place", "slice_no", F.col("op").isNotNull(), "seq").mapInArrow(_states, _STATE)


def _chains(schema: pa.Schema):
    """Clips come by board and position: each with all that lie under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["board_id"] != last:
                    last, held = row["board_id"], {}
                held[row["op_seq"]] = (row["clip"], {"rule": row["rule"], "commands": row["commands"]})
                clips, at = [], row["op_seq"]
                while at is not None:
                    at, clip = held[at]
                    clips.append(clip)
                yield pa.RecordBatch.from_pylist([{"board_id": last, "clip": row["op_seq"], "clips": clips[::-1]}], schema)

    return run


def interpret(operators: DataFrame, boards: DataFrame, resources: DataFrame, alphas: DataFrame, colorspaces: DataFrame, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(nodes, errors). nodes: board_id, op_seq, sub_seq and payloads; a traced artwork's href names its resource.

    A board with an error has no nodes. A board of more than `size` positions is folded in several tasks, with equal results.
    clips_finite says of a node's clips what validate checks, so that they need not be made for it.
    """
    spark = operators.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Without a position a row comes first, as in one fold.
    rows = operators.withColumn("slice_no", F.coalesce(_slice(size), F.lit(-(1 << 62))))
    of_board = Window.partitionBy("board_id")
    parts = rows.select("board_id", "slice_no").distinct().join(boards.select("board_id", "height"), "board_id")
    slices = materialize(parts.withColumns({"first_slice": F.min("slice_no").over(of_board), "last_slice": F.max("slice_no").over(of_board)}))
    names = _names(resources, alphas, colorspaces)
    starts = spark.createDataFrame([], _STATE) if slices.where("first_slice < last_slice").isEmpty() else _starts(rows, slices, names, n)
    led = _led(rows, slices.join(starts, ["board_id", "slice_no"], "left"), names)
    schema = to_arrow_schema(spark.createDataFrame([], _OUT).schema)
    dealt = led.repartition(n, "board_id", "slice_no").sortWithinPartitions("board_id", "slice_no", "place", "seq")
    folded = materialize(dealt.mapInArrow(_folded(schema), _OUT))
    first = F.min(F.struct("error_seq", "error_kind", "error_message"))
    errors = folded.where("error_kind IS NOT NULL").groupBy("board_id").agg(first.alias("e")).select("board_id", "e.error_kind", "e.error_message")
    drawn = folded.where("error_kind IS NULL").join(errors, "board_id", "left_anti")
    clips = drawn.where("kind = 'clip'").select("board_id", "op_seq", "clip", "rule", "commands")
    whole = f"board_id string, clip bigint, clips {CLIPS}"
    chains = clips.repartition(n, "board_id").sortWithinPartitions("board_id", "op_seq").mapInArrow(_chains(to_arrow_schema(spark.createDataFrame([], whole).schema)), whole)
    # One row for each clip, said in a way that lets the join go where clips aren't read.
    chains = chains.groupBy("board_id", "clip").agg(F.first("clips").alias("clips"))
    nodes = drawn.where("kind <> 'clip'").join(chains, ["board_id", "clip"], "left")
    listed = F.coalesce("clips", F.array().cast(CLIPS)).alias("clips")
    return nodes.select("board_id", "op_seq", "sub_seq", "kind", "asset_id", "matrix", "opacity", listed, "clips_finite", "commands", "style", "href"), errors


def place_shapes(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every placement of a resource gets its own copy of its shapes(board_id, resource, shape_seq, path, color, opacity)."""
    art = nodes.where("kind = 'vector-artwork'").select("board_id", "op_seq", "sub_seq", F.col("href").alias("resource"), "matrix")
    moved = art.join(shapes.withColumnRenamed("opacity", "shape_opacity"), ["board_id", "resource"])
    shape = F.struct("shape_seq", geometry.placed(F.col("path"), F.col("matrix")).alias("path"), "color", F.col("shape_opacity").alias("opacity"))
    held = moved.groupBy("board_id", "op_seq", "sub_seq").agg(F.transform(F.array_sort(F.collect_list(shape)), lambda s: F.struct(s["path"].alias("path"), s["color"].alias("color"), s["opacity"].alias("opacity"))).alias("shapes"))
    return nodes.join(held, ["board_id", "op_seq", "sub_seq"], "left")


def scene_nodes(content: DataFrame, links: DataFrame) -> DataFrame:
    """Content and link nodes as one table in paint order: content by operator, then links. node_seq is unique on a board."""
    from inkfold.operators.validate import NODES

    a = content.withColumn("node_seq", F.col("op_seq") * 2 + F.col("sub_seq"))
    b = links.select("board_id", (F.lit(1 << 40) + F.col("annot_seq")).alias("node_seq"), F.lit("link").alias("kind"), "target", "bounds")
    both = a.drop("op_seq", "sub_seq").unionByName(b, allowMissingColumns=True)
    empty = content.sparkSession.createDataFrame([], NODES)
    art = F.col("kind") == "vector-artwork"
    told = [c for c in ("clips_finite",) if c in content.columns]
    return empty.unionByName(both, allowMissingColumns=True).withColumns({"matrix": F.when(~art, F.col("matrix")), "href": F.when(~art, F.col("href"))}).select(*empty.columns, *told)
