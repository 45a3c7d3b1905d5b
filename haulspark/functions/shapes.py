"""Lines and polygons as Column expressions: tests against boxes, point in polygon, clipping.

A point is struct<lon, lat>, a line an array of points, a polygon an array of rings, the first of which is its outside
and the others holes; a ring may repeat its first point at the end or not.  All is planar in the units given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column | float, Column | float, Column | float, Column | float]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def steps(line: Column) -> Column:
    """(a, b) for each two points in a row."""
    return let(line, lambda p: F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def edges(ring: Column) -> Column:
    """(a, b) for each edge of a ring, the closing one too."""
    return let(ring, lambda p: F.transform(p, lambda a, i: F.struct(a.alias("a"), F.element_at(p, ((i + 1) % F.size(p) + 1).cast("int")).alias("b"))))


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges))


def step_meets_box(s: Column, box: Box) -> Column:
    """Whether a straight piece touches a closed box: their extents meet and the box's corners are not all strictly
    on one side of the line."""
    x0, y0, x1, y1 = (F.lit(v) if not isinstance(v, Column) else v for v in box)
    a, b = s["a"], s["b"]
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    sides = [dx * (y - a["lat"]) - dy * (x - a["lon"]) for x in (x0, x1) for y in (y0, y1)]
    near = (F.least(a["lon"], b["lon"]) <= x1) & (F.greatest(a["lon"], b["lon"]) >= x0) & (F.least(a["lat"], b["lat"]) <= y1) & (F.greatest(a["lat"], b["lat"]) >= y0)
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def crosses(s: Column, lon: Column, lat: Column) -> Column:
    """Whether the ray from a point to the east crosses an edge."""
    a, b = s["a"], s["b"]
    across = (a["lat"] > lat) != (b["lat"] > lat)
    return across & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(across, b["lat"] - a["lat"]) + a["lon"])


def odd(edges_: Column, lon: Column, lat: Column) -> Column:
    """Whether the ray from a point crosses an odd number of edges."""
    return F.size(F.filter(edges_, lambda s: F.coalesce(crosses(s, lon, lat), F.lit(False)))) % 2 == 1


def polygon_has(rings: Column, lon: Column, lat: Column) -> Column:
    """Whether a polygon contains a point, by the even-odd rule; of two polygons that share an edge one has its points."""
    return odd(all_edges(rings), lon, lat)


def line_meets_box(line: Column, box: Box) -> Column:
    """Whether any piece of a line touches a closed box; a line of one point is that point."""
    return F.exists(steps(F.when(F.size(line) == 1, F.concat(line, line)).otherwise(line)), lambda s: step_meets_box(s, box))


def polygon_meets_box(rings: Column, box: Box) -> Column:
    """Whether a polygon and a closed box share a place: an edge touches the box, or the box is inside."""
    x0, y0 = (F.lit(v) if not isinstance(v, Column) else v for v in box[:2])
    return let(all_edges(rings), lambda e: F.exists(e, lambda s: step_meets_box(s, box)) | odd(e, x0, y0))


def _half(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """A ring cut to one side of a line along an axis."""
    other = "lat" if axis == "lon" else "lon"
    within = lambda p: p[axis] >= bound if above else p[axis] <= bound

    def meet(a: Column, b: Column) -> Column:
        at = a[other] + (b[other] - a[other]) * (bound - a[axis]) / (b[axis] - a[axis])
        return point(bound, at) if axis == "lon" else point(at, bound)

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(within(a) & within(b), F.array(b)).when(within(a), F.array(meet(a, b))).when(within(b), F.array(meet(a, b), b)).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))

    return F.flatten(F.transform(edges(ring), on))


def clip_ring(ring: Column, box: Box) -> Column:
    """The part of a ring within a box, as one ring; where several parts are left, edges along the box join them,
    which leaves the area right.  Empty where nothing is left."""
    x0, y0, x1, y1 = (F.lit(v) if not isinstance(v, Column) else v for v in box)
    for axis, bound, above in (("lon", x0, True), ("lon", x1, False), ("lat", y0, True), ("lat", y1, False)):
        ring = _half(ring, axis, bound, above)
    return ring


def clip_rings(rings: Column, box: Box) -> Column:
    """A polygon's rings within a box; holes of which nothing is left are gone, and all is if the outside is."""
    cut = F.transform(rings, lambda r: clip_ring(r, box))
    return let(cut, lambda c: F.when(F.size(F.element_at(c, 1)) > 2, F.filter(c, lambda r: F.size(r) > 2)).otherwise(F.slice(c, 1, 0)))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a ring: positive where it turns from the first axis to the second."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda t, s: t + s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])


def extent(rings: Column) -> Column:
    """(x0, y0, x1, y1) of a polygon's outside."""
    side = lambda f, axis: f(F.transform(F.element_at(rings, 1), lambda p: p[axis]))
    return F.struct(side(F.array_min, "lon").alias("x0"), side(F.array_min, "lat").alias("y0"), side(F.array_max, "lon").alias("x1"), side(F.array_max, "lat").alias("y1"))
