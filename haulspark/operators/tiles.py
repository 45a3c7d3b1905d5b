"""Vector tiles and generalized corridors.

The envelope, the choice of rows and the projection are expressions; only the wire format, and joining lines end to
end, run in Python, a group at a time and bounded by the tile's cap or the corridor.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import mercator, tile_bounds, tile_of
from haulspark.functions.shapes import let, point, steps, twice_area
from haulspark.operators import polygons
from haulspark.operators.chains import corridor_lines
from haulspark.session import spread

EXTENT = 4096


@dataclass(frozen=True)
class Layer:
    """Which rows and which form of a layer a zoom level shows."""

    name: str
    clustered_below: int = 0
    generalized_below: int = 0
    cap: int = 5000
    importance: str | None = None
    row_filter: str | None = None
    min_zoom: int = 0

    def source_for(self, z: int) -> str:
        return "cluster" if z < self.clustered_below else "generalized" if z < self.generalized_below else "raw"

    def rows(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """The rows that are on the map; columns that a table lacks, as generalized ones do, are null."""
        out = df.where(self.row_filter) if self.row_filter else df
        return out.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _number(7, int(v))
    if isinstance(v, int):
        return _number(6, (v << 1) ^ (v >> 63))
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def _zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 31)


def _commands(parts: list[list[tuple[int, int]]], closed: bool = False) -> bytes:
    """A point, lines or rings: move to the first place of each part, then on to the others, each relative to the one
    before; rings are closed without naming their first place again."""
    out, x, y = b"", 0, 0
    for part in parts:
        for i, (px, py) in enumerate(part):
            if i < 2:
                out += _varint(1 << 3 | 1) if not i else _varint((len(part) - 1) << 3 | 2)
            out += _varint(_zigzag(px - x)) + _varint(_zigzag(py - y))
            x, y = px, py
        if closed:
            out += _varint(1 << 3 | 7)
    return out


def encode_points(layer: str, rows: list[tuple[int, int, dict]]) -> bytes:
    """A tile of one point layer: (x, y, properties) in tile units; null properties are left out."""
    return encode(layer, [([[(x, y)]], props) for x, y, props in rows], 1)


def encode(layer: str, rows: list[tuple[list[list[tuple[int, int]]], dict]], kind: int) -> bytes:
    """A tile of one layer of points (kind 1), lines (2) or polygons (3): (parts, properties) in tile units."""
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    features = b""
    for parts, props in rows:
        tags = b""
        for k, v in props.items():
            if v is not None:
                tags += _varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values)))
        features += _field(2, _field(2, tags) + _number(3, kind) + _field(4, _commands(parts, kind == 3)))
    body = _number(15, 2) + _field(1, layer.encode()) + features + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values) + _number(5, EXTENT)
    return _field(3, body)


def _capped(t: DataFrame, order: list[Column], id_col: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each tile, numbered _n: first within shares of a tile, then of what these keep, since a
    tile of a low zoom level may hold all rows."""
    share = F.pmod(F.xxhash64(id_col), F.lit(64))
    first = t.withColumn("_s", share).withColumn("_n", F.row_number().over(Window.partitionBy("x", "y", "_s").orderBy(*order))).where(F.col("_n") <= cap).drop("_s", "_n")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("x", "y").orderBy(*order))).where(F.col("_n") <= cap)


def point_tiles(points: DataFrame, layer: Layer, z: int, properties: list[str], id_col: str) -> DataFrame:
    """(x, y, n, tile) of every tile at a zoom level with points: at most ``layer.cap`` points each, the most important
    first (nulls last), then by id; clustered layers give a point per grid cell with its count."""
    t = layer.rows(points, properties).where("lon is not null and lat is not null").withColumn("t", tile_of(F.col("lon"), F.col("lat"), z)).withColumn("m", mercator(F.col("lon"), F.col("lat")))
    side = 2 * 20037508.342789244 / 2**z
    px = F.floor((F.col("m.x") + 20037508.342789244 - F.col("t.x") * side) / side * EXTENT).cast("int")
    py = F.floor((20037508.342789244 - F.col("m.y") - F.col("t.y") * side) / side * EXTENT).cast("int")
    t = t.select(F.col("t.x").alias("x"), F.col("t.y").alias("y"), px.alias("px"), py.alias("py"), *properties, *([id_col] if id_col not in properties else []))
    if layer.source_for(z) == "cluster":
        g = t.groupBy("x", "y", F.floor(F.col("px") / 64).alias("gx"), F.floor(F.col("py") / 64).alias("gy"))
        t = g.agg(F.avg("px").cast("int").alias("px"), F.avg("py").cast("int").alias("py"), F.count(F.lit(1)).alias("point_count"), F.min(id_col).alias(id_col)).drop("gx", "gy")
        properties = ["point_count"]
    t = _capped(t, _order(t, layer, id_col), id_col, layer.cap)
    name, props = layer.name, list(properties)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        rows = [(int(r["px"]), int(r["py"]), {p: _plain(r[p]) for p in props}) for r in pdf.to_dict("records")]
        return pd.DataFrame({"x": [pdf["x"].iloc[0]], "y": [pdf["y"].iloc[0]], "n": [len(rows)], "tile": [encode_points(name, rows)]})

    return t.groupBy("x", "y").applyInPandas(one, "x int, y int, n int, tile binary")


def _plain(v):
    return None if v is None or v is pd.NA or isinstance(v, float) and v != v else v.item() if hasattr(v, "item") else v


#: A line is cut this far outside its tile, in shares of the tile.
MARGIN = 64 / EXTENT


def clip(line: list[tuple[float, float]]) -> list[list[tuple[int, int]]]:
    """The parts of a line, given in shares of a tile, that lie within the tile and its margin, in tile units."""
    low, high = -MARGIN, 1 + MARGIN
    parts: list[list[tuple[int, int]]] = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        dx, dy, t0, t1 = bx - ax, by - ay, 0.0, 1.0
        for p, d in ((ax, dx), (ay, dy)):
            if d:
                a, b = sorted(((low - p) / d, (high - p) / d))
                t0, t1 = max(t0, a), min(t1, b)
            elif not low <= p <= high:
                t1 = -1.0
        if t0 <= t1:
            start, end = ((round((ax + t * dx) * EXTENT), round((ay + t * dy) * EXTENT)) for t in (t0, t1))
            if parts and parts[-1][-1] == start:
                parts[-1] += [end] * (end != start)
            elif end != start:
                parts.append([start, end])
    return parts


def line_parts(lines: DataFrame, z: int, keep: list[str]) -> DataFrame:
    """(*keep, x, y, parts): what each line has within each tile of a level that it meets, and a margin, in tile units.

    A line's pieces walk from tile to tile, one column of tiles after the other, so the rows follow its length and not
    its extent.  ``parts`` has (i, sx, sy, ex, ey) for each piece, in order; what rounds to a single place is left out.
    Rows that are equal in ``keep`` and line are one.
    """
    half, side, last = 20037508.342789244, 2 * 20037508.342789244 / 2**z, 2**z - 1
    spot = lambda p: let(mercator(p["lon"], p["lat"]), lambda m: point((m["x"] + half) / side, (half - m["y"]) / side))
    t = lines.where(F.size("line") > 1).select(*keep, F.xxhash64("line").alias("_line"), F.posexplode(steps(F.transform("line", spot))).alias("i", "s"))
    ax, ay, dx, dy = F.col("s.a.lon"), F.col("s.a.lat"), F.col("s.b.lon") - F.col("s.a.lon"), F.col("s.b.lat") - F.col("s.a.lat")

    def within(at, step, low, high):
        """The stretch of a piece, from 0 to 1, in which one coordinate lies between two bounds: (t0, t1), t0 > t1 for none."""
        a, b = (low - at) / F.when(step != 0, step), (high - at) / F.when(step != 0, step)
        still = (at >= low) & (at <= high)
        return F.coalesce(F.greatest(F.lit(0.0), F.least(a, b)), F.when(still, 0.0).otherwise(1.0)), F.coalesce(F.least(F.lit(1.0), F.greatest(a, b)), F.when(still, 1.0).otherwise(0.0))

    tiles_of = lambda a, b: F.sequence(*[F.greatest(F.lit(0), F.least(F.lit(last), F.floor(v))).cast("int") for v in (F.least(a, b) - MARGIN, F.greatest(a, b) + MARGIN)])
    t = t.withColumn("x", F.explode(tiles_of(ax, ax + dx)))
    t0, t1 = within(ax, dx, F.col("x") - MARGIN, F.col("x") + 1 + MARGIN)
    t = t.withColumn("t0", t0).withColumn("t1", t1).where("t0 <= t1").withColumn("y", F.explode(tiles_of(ay + F.col("t0") * dy, ay + F.col("t1") * dy)))
    u0, u1 = within(ay, dy, F.col("y") - MARGIN, F.col("y") + 1 + MARGIN)
    t = t.withColumn("t0", F.greatest("t0", u0)).withColumn("t1", F.least("t1", u1)).where("t0 <= t1")
    unit = lambda at, step, tile, u: F.rint((at + F.col(u) * step - F.col(tile)) * EXTENT).cast("int")
    t = t.select(*keep, "_line", "x", "y", "i", unit(ax, dx, "x", "t0").alias("sx"), unit(ay, dy, "y", "t0").alias("sy"), unit(ax, dx, "x", "t1").alias("ex"), unit(ay, dy, "y", "t1").alias("ey"))
    t = t.where("sx <> ex or sy <> ey").groupBy(*keep, "_line", "x", "y")
    return t.agg(F.array_sort(F.collect_set(F.struct("i", "sx", "sy", "ex", "ey"))).alias("parts")).drop("_line")


def joined(parts) -> list[list[tuple[int, int]]]:
    """Pieces in order, as lines that go on where a piece starts at the end of the one before."""
    out: list[list[tuple[int, int]]] = []
    for p in parts:
        start, end = (p["sx"], p["sy"]), (p["ex"], p["ey"])
        if out and out[-1][-1] == start:
            out[-1].append(end)
        else:
            out.append([start, end])
    return out


def _order(t: DataFrame, layer: Layer, id_col: str) -> list[Column]:
    return ([F.desc_nulls_last(layer.importance)] if layer.importance and layer.importance in t.columns else []) + [F.asc(id_col)]


def line_tiles(lines: DataFrame, layer: Layer, z: int, properties: list[str], id_col: str) -> DataFrame:
    """(x, y, n, tile, ids) of every tile at a zoom level that a line meets, at most ``layer.cap`` lines each, the most
    important first (nulls last), then by id, which ``ids`` has in that order.  What doesn't meet a tile is cut away
    before the cap counts.  Lines of fewer than two places are left out; there are no tiles below min_zoom."""
    rows = layer.rows(lines, properties).where(F.lit(z >= layer.min_zoom))
    t = line_parts(rows, z, list(dict.fromkeys([id_col, *properties, *([layer.importance] if layer.importance in rows.columns else [])])))
    return _encoded(_capped(t, _order(t, layer, id_col), id_col, layer.cap), layer.name, properties, id_col, 2, joined)


def _encoded(t: DataFrame, name: str, properties: list[str], id_col: str, kind: int, form) -> DataFrame:
    props, ids = list(properties), dict(t.dtypes)[id_col]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        found = [(form(r["parts"]), {p: _plain(r[p]) for p in props}) for r in pdf.to_dict("records")]
        return pd.DataFrame({"x": [int(pdf["x"].iloc[0])], "y": [int(pdf["y"].iloc[0])], "n": [len(found)], "tile": [encode(name, found, kind)], "ids": [pdf[id_col].tolist()]})

    return t.groupBy("x", "y").applyInPandas(one, f"x int, y int, n int, tile binary, ids array<{ids}>")


def polygon_parts(polygons_: DataFrame, z: int, keep: list[str]) -> DataFrame:
    """(*keep, x, y, parts): the rings of each polygon (``rings`` in degrees) within each tile of a level and a margin,
    in tile units, without repeated places; the outside turns one way and holes the other.  What rounds to nothing is
    left out.  Each different polygon is cut once, however many rows have it."""
    kinds = polygons.shapes(polygons_)
    p = polygons.by_tile(spread(kinds, "_shape").select("_shape", polygons.mercator_rings(F.col("rings")).alias("rings")), z, MARGIN / 2**z)
    place = lambda p: F.struct(F.rint((p["lon"] * 2**z - F.col("x")) * EXTENT).cast("int").alias("x"), F.rint((p["lat"] * 2**z - F.col("y")) * EXTENT).cast("int").alias("y"))
    apart = lambda r: let(r, lambda q: F.filter(q, lambda v, i: v != F.element_at(q, ((i + F.size(q) - 1) % F.size(q) + 1).cast("int"))))
    area = lambda r: twice_area(F.transform(r, lambda v: point(v["x"].cast("double"), v["y"].cast("double"))))
    sized = F.transform("rings", lambda r, i: let(apart(F.transform(r, place)), lambda q: F.struct(i.alias("i"), q.alias("r"), area(q).alias("a"))))
    p = p.withColumn("rings", F.filter(sized, lambda r: r["a"] != 0)).where((F.size("rings") > 0) & (F.element_at("rings", 1)["i"] == 0))
    turned = F.transform("rings", lambda r: F.when((r["a"] > 0) == (r["i"] == 0), r["r"]).otherwise(F.reverse(r["r"])))
    units = F.transform("rings", lambda r: F.when(r["i"] == 0, F.abs(r["a"])).otherwise(-F.abs(r["a"])))
    p = p.select("_shape", "x", "y", turned.alias("parts"), (F.aggregate(units, F.lit(0.0), lambda t, v: t + v) / 2).alias("area"))
    own = polygons_.join(kinds.hint("merge"), "rings").select(*keep, "_shape")
    return own.join(p.hint("merge"), "_shape").select(*keep, "x", "y", "parts", "area")


def polygon_tiles(polygons_: DataFrame, layer: Layer, z: int, properties: list[str], id_col: str) -> DataFrame:
    """(x, y, n, tile, ids) of every tile at a zoom level that a polygon meets, capped and in order as ``line_tiles``.
    ``rings`` holds the outside and then holes, in degrees."""
    rows = layer.rows(polygons_, properties).where(F.lit(z >= layer.min_zoom))
    t = polygon_parts(rows, z, list(dict.fromkeys([id_col, *properties, *([layer.importance] if layer.importance in rows.columns else [])])))
    rings = lambda parts: [[(v["x"], v["y"]) for v in r] for r in parts]
    return _encoded(_capped(t, _order(t, layer, id_col), id_col, layer.cap), layer.name, properties, id_col, 3, rings)


def in_tile(points: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """The points of one tile: a bound on the columns that the scan can use, not a computed one."""
    import math

    x0, y0, x1, y1 = tile_bounds(z, x, y)
    lon = lambda v: math.degrees(v / 6378137.0)
    lat = lambda v: math.degrees(2 * math.atan(math.exp(v / 6378137.0)) - math.pi / 2)
    return points.where((F.col("lon") >= lon(x0)) & (F.col("lon") < lon(x1)) & (F.col("lat") > lat(y0)) & (F.col("lat") <= lat(y1)))


# ---- corridors ---------------------------------------------------------------------------------------------


def merge_lines(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Lines joined end to end where exactly two meet; each part is walked once."""
    ends = defaultdict(list)
    for i, line in enumerate(lines):
        ends[line[0]].append(i)
        ends[line[-1]].append(i)
    left, out = set(range(len(lines))), []

    def follow(tip):
        """The places on from a line's end, as far as exactly two lines meet."""
        on = []
        while len(ends[tip]) == 2 and (others := [i for i in ends[tip] if i in left]):
            left.discard(others[0])
            line = lines[others[0]]
            on += line[1:] if line[0] == tip else line[-2::-1]
            tip = on[-1]
        return on

    for i, line in enumerate(lines):
        if i in left:
            left.discard(i)
            after = follow(line[-1])
            out.append(follow(line[0])[::-1] + list(line) + after)
    return out


def simplify(line: list[tuple[float, float]], tolerance: float, circle: bool = True, places: bool = False) -> list:
    """Douglas-Peucker; the ends stay, and a closed line keeps a third point, if ``circle``.  With ``places`` the
    numbers of the points that stay."""
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    if circle and line[0] == line[-1] and len(line) > 3:
        far = max(range(1, len(line) - 1), key=lambda i: (line[i][0] - line[0][0]) ** 2 + (line[i][1] - line[0][1]) ** 2)
        keep.add(far)
        stack = [(0, far), (far, len(line) - 1)]
    x, y = np.array(line, float).T
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy, px, py = x[b] - x[a], y[b] - y[a], x[a + 1 : b], y[a + 1 : b]
        size = np.sqrt(dx * dx + dy * dy)
        away = np.abs(dx * (y[a] - py) - (x[a] - px) * dy) / size if size else np.sqrt((px - x[a]) ** 2 + (py - y[a]) ** 2)
        at = int(away.argmax())
        if away[at] > tolerance:
            keep.add(a + 1 + at)
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return sorted(keep) if places else [line[i] for i in sorted(keep)]


def generalize(segments: DataFrame, keys: list[str], tolerance_deg: float = 0.002) -> DataFrame:
    """One row per corridor: keys, segments, points_before, points_after and lines, merged end to end and simplified
    without new crossings; lines are in the order of their least edges.  A segment of fewer than two points only counts."""
    before = segments.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("segments"), F.sum(F.when(F.size("line") > 1, F.size("line")).otherwise(0)).cast("int").alias("points_before"))
    merged = corridor_lines(segments, keys, tolerance_deg)
    after = merged.groupBy(*keys).agg(F.sum(F.size("line")).cast("int").alias("points_after"), F.sort_array(F.collect_list(F.struct("chain", "line"))).alias("l"))
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    same = F.lit(True)
    left, right = before.alias("b"), after.alias("a")
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}"))
    return left.join(right, same, "left").select(*[F.col(f"b.{k}").alias(k) for k in keys], "segments", "points_before", F.coalesce("points_after", F.lit(0)).alias("points_after"), F.coalesce(F.col("l.line"), none).alias("lines"))
