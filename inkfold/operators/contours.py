"""Edges closed into contours, simplified, and drawn as polygons or curves. Small helpers on one contour's points."""

from __future__ import annotations

import math

from inkfold.constants import COLLINEAR, CORNER_COSINE, TOLERANCE_SQUARED

Point = tuple[float, float]

#: Which sides of a cell a contour joins, by which corners are inside (1 top left, 2 top right, 4 bottom right, 8 bottom
#: left). Sides: 0 top, 1 right, 2 bottom, 3 left. Fixed values.
SEGMENTS = {
    1: ((3, 0),), 2: ((0, 1),), 3: ((3, 1),), 4: ((1, 2),), 5: ((3, 0), (1, 2)), 6: ((0, 2),), 7: ((3, 2),),
    8: ((2, 3),), 9: ((0, 2),), 10: ((0, 1), (2, 3)), 11: ((1, 2),), 12: ((1, 3),), 13: ((0, 1),), 14: ((3, 0),),
}


def close(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Walk edges into contours: from the least point on, always to the least neighbor, each edge once."""
    near: dict[Point, list[Point]] = {}
    for p, q in set(edges):
        near.setdefault(p, []).append(q)
        near.setdefault(q, []).append(p)
    for ends in near.values():
        ends.sort(reverse=True)  # the least is the last
    out = []
    for origin in sorted(near):
        while near[origin]:
            at, walked = origin, []
            while near[at]:
                walked.append(at)
                to = near[at].pop()
                near[to].remove(at)
                at = to
                if at == origin:
                    break
            else:
                walked.append(at)
            out.append(walked)
    return out


def area(points: list[Point]) -> float:
    total = 0.0
    for (x, y), (nx, ny) in zip(points, points[1:] + points[:1], strict=True):
        total += x * ny - nx * y
    return total


def _squared(a: Point, b: Point) -> float:
    return (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2


def _from_line(a: Point, b: Point, p: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    if length == 0:
        return _squared(a, p)
    cross = dy * (p[0] - a[0]) - dx * (p[1] - a[1])
    return cross * cross / length


def _last_largest(values: list[float]) -> int:
    best = 0
    for i, v in enumerate(values):
        if v >= values[best]:
            best = i
    return best


def _kept(points: list[Point]) -> list[Point]:
    """An open run: ends stay, and the farthest point of each stretch that departs by more than the tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        far = [_from_line(points[lo], points[hi], p) for p in points[lo + 1 : hi]]
        at = _last_largest(far)
        if far[at] > TOLERANCE_SQUARED:
            mid = lo + 1 + at
            keep.add(mid)
            todo += [(lo, mid), (mid, hi)]
    return [points[i] for i in sorted(keep)]


def simplify(points: list[Point]) -> list[Point]:
    """A closed contour without collinear points, and without those within the tolerance unless its turn would change."""
    around = zip(points[-1:] + points[:-1], points, points[1:] + points[:1], strict=True)
    clean = [q for p, q, r in around if abs((q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])) > COLLINEAR]
    if len(clean) <= 4:
        return clean
    far = _last_largest([_squared(clean[0], p) for p in clean])
    simple = _kept(clean[: far + 1])[:-1] + _kept(clean[far:] + clean[:1])[:-1]
    return simple if area(simple) * area(clean) > 0 else clean


def _unit(a: Point, b: Point) -> Point | None:
    size = math.sqrt(_squared(a, b))
    return None if size == 0 else ((b[0] - a[0]) / size, (b[1] - a[1]) / size)


def _tangent(before: Point, at: Point, after: Point) -> Point | None:
    """The direction from the point before to the one after; none at a corner."""
    into, out, along = _unit(before, at), _unit(at, after), _unit(before, after)
    if into is None or out is None or along is None or into[0] * out[0] + into[1] * out[1] < CORNER_COSINE:
        return None
    return along


def path(points: list[Point], width: int, height: int, curved: bool) -> dict | None:
    """A contour in the unit square: its start and its segments; curves have two handles a third of a segment long."""
    if not points:
        return None

    def unit(p: Point) -> dict:
        return {"x": p[0] / width, "y": p[1] / height}

    if not curved or len(points) < 3:
        return {"start": unit(points[0]), "segments": [{"first": None, "second": None, "end": unit(p)} for p in points[1:]]}
    n = len(points)
    tangents = [_tangent(points[i - 1], points[i], points[(i + 1) % n]) for i in range(n)]

    def handle(at: Point, tangent: Point | None, reach: float) -> Point:
        return at if tangent is None else (at[0] + tangent[0] * reach, at[1] + tangent[1] * reach)

    segments = []
    for i, start in enumerate(points):
        end = points[(i + 1) % n]
        reach = math.sqrt(_squared(start, end)) / 3
        segments.append({"first": unit(handle(start, tangents[i], reach)), "second": unit(handle(end, tangents[(i + 1) % n], -reach)), "end": unit(end)})
    return {"start": unit(points[0]), "segments": segments}
