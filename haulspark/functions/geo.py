"""Points, lines and grids as Column expressions.

A line is ``array<struct<lon,lat>>``.  Distances are great-circle on a sphere, in metres; positions along a line are
planar in degrees, as the reference's are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_M = 6371008.8
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
US_BOXES = (
    (-125.0, 24.4, -66.9, 49.4), (-179.9, 51.0, -129.9, 71.5), (-160.6, 18.8, -154.7, 22.5), (-67.6, 17.5, -64.4, 18.6), (144.2, 12.9, 146.2, 20.8),
    (-171.2, -14.7, -168.0, -10.8), (-83.0, 23.5, -79.8, 24.4),
)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def spheroid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the WGS 84 spheroid by Lambert's formula, right to some metres in a thousand kilometres; not for
    antipodes."""
    a, f = 6_378_137.0, 1 / 298.257223563
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.when(h.isNotNull(), F.least(F.lit(1.0), h))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(s == 0, 0.0).otherwise(a * (s - f / 2 * (x + y)))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Standard geohash: interleaved bits of both coordinates, five to a character."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.lit(2**n - 1), F.greatest(F.lit(0), F.floor((v - low) / span * F.lit(float(2**n))))).cast("bigint")
    x, y = cell(lon, -180.0, 360.0, n_lon), cell(lat, -90.0, 180.0, n_lat)
    chars = []
    for k in range(precision):
        code = F.lit(0).cast("bigint")
        for b in range(5 * k, 5 * k + 5):
            source, shift = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            code = code.bitwiseOR(F.shiftleft(F.shiftright(source, shift).bitwiseAND(F.lit(1)), 4 - (b - 5 * k)))
        chars.append(F.substring(F.lit(GEOHASH), (code + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*chars))


def in_boxes(lon: Column, lat: Column, boxes=US_BOXES) -> Column:
    out = F.lit(False)
    for x0, y0, x1, y1 in boxes:
        out = out | (lon.between(x0, x1) & lat.between(y0, y1))
    return out


def wkt_points(wkt: Column) -> Column:
    """Every vertex of a WKT geometry of any type, further ordinates left out; null where it can't be read."""
    head = r"(?i)^\s*[a-z]+\s*(?:zm|z|m)?\s*\("
    body = F.regexp_replace(F.regexp_replace(wkt, r"(?i)^\s*[a-z]+\s*(?:zm|z|m)?\s*(?=\()", ""), "[()]", " ")
    parts = F.transform(F.split(body, ","), lambda s: F.filter(F.split(s, r"\s+"), lambda x: x != ""))
    points = F.transform(parts, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat")))
    good = F.forall(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.when(wkt.rlike(head) & good, points)


def judge_points(points: Column) -> Column:
    """Why vertices are rejected, or null: any out of range; none in the country; all there once swapped."""
    out = F.exists(points, lambda p: ((p["lat"] == 0) & (p["lon"] == 0)) | (F.abs(p["lat"]) > 90) | (F.abs(p["lon"]) > 180))
    inside = F.exists(points, lambda p: in_boxes(p["lon"], p["lat"]))
    swapped = F.forall(points, lambda p: in_boxes(p["lat"], p["lon"]))
    return F.when(out, "coords_out_of_range").when(inside, F.lit(None)).when(swapped, "latlon_swapped").otherwise("coords_not_in_us")


def line_length_m(line: Column) -> Column:
    n = F.size(line)
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def line_wkt(line: Column) -> Column:
    """LINESTRING text; null for fewer than two points."""
    body = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    return F.when(F.size(line) >= 2, F.concat(F.lit("LINESTRING ("), body, F.lit(")")))


def segments(line: Column) -> Column:
    """(a, b, before): the line's two-point pieces with the planar length before each."""
    n = F.size(line)
    pieces = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _planar(a, b).alias("len")))
    return F.transform(pieces, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["len"].alias("len"), F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0.0), lambda t, x: t + x["len"]).alias("before")))


def _planar(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(b["lon"] - a["lon"], 2) + F.pow(b["lat"] - a["lat"], 2))


def locate(line: Column, lon: Column, lat: Column) -> Column:
    """Fraction of a line, planar in degrees, at which it is nearest to a point; the first such place for ties."""

    def near(s: Column) -> Column:
        dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
        t = F.when(s["len"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - s["a"]["lon"]) * dx + (lat - s["a"]["lat"]) * dy) / (s["len"] * s["len"]))))
        d = F.sqrt(F.pow(lon - s["a"]["lon"] - t * dx, 2) + F.pow(lat - s["a"]["lat"] - t * dy, 2))
        return F.struct(d.alias("d"), (s["before"] + t * s["len"]).alias("at"))

    best = F.array_min(F.transform(segments(line), near))
    total = F.aggregate(segments(line), F.lit(0.0), lambda t, s: t + s["len"])
    return F.when(total == 0, F.lit(0.0)).otherwise(best["at"] / total)


def cut(line: Column, start: Column, end: Column) -> Column:
    """The part of a line between two fractions of its planar length, its ends interpolated."""
    segs = segments(line)
    total = F.aggregate(segs, F.lit(0.0), lambda t, s: t + s["len"])

    def at(f: Column) -> Column:
        target = f * total
        s = F.coalesce(F.try_element_at(F.filter(segs, lambda s: (s["before"] + s["len"] >= target) & (s["len"] > 0)), F.lit(1)), F.element_at(segs, -1))
        t = F.when(s["len"] == 0, F.lit(0.0)).otherwise((target - s["before"]) / s["len"])
        return F.struct((s["a"]["lon"] + t * (s["b"]["lon"] - s["a"]["lon"])).alias("lon"), (s["a"]["lat"] + t * (s["b"]["lat"] - s["a"]["lat"])).alias("lat"))

    inner = F.transform(F.filter(segs, lambda s: (s["before"] > start * total) & (s["before"] < end * total)), lambda s: s["a"])
    return F.concat(F.array(at(start)), inner, F.array(at(end)))


def grid_cell(v: Column, size: float) -> Column:
    """The nearest multiple of a cell size, as a number of cells; halves away from zero."""
    return F.round(v / F.lit(float(size)), 0).cast("bigint")


def mercator(lon: Column, lat: Column) -> Column:
    """Web Mercator metres."""
    r = F.lit(6378137.0)
    clipped = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    return F.struct((r * F.radians(lon)).alias("x"), (r * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(clipped) / 2))).alias("y"))


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """Web Mercator bounds of a tile: x0, y0, x1, y1."""
    world = 20037508.342789244
    side = 2 * world / 2**z
    return (-world + x * side, world - (y + 1) * side, -world + (x + 1) * side, world - y * side)


def tile_of(lon: Column, lat: Column, z: int) -> Column:
    """The tile that holds a point at a zoom level."""
    n, m = 2**z, mercator(lon, lat)
    world = 20037508.342789244
    clip = lambda c: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(c))).cast("int")
    return F.struct(clip((m["x"] + world) / (2 * world) * n).alias("x"), clip((world - m["y"]) / (2 * world) * n).alias("y"))
