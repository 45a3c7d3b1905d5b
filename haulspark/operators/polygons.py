"""Polygons on a quadtree: pieces of polygons by tile, and points in polygons without comparing all with all.

A polygon starts in the few cells, about its own size, that its extent meets.  Each level cuts what a cell holds into
its quarters, so that the work follows a polygon's outline and not its extent; all of it is expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.shapes import all_edges, clip_rings, extent, let, odd, point, step_meets_box
from haulspark.session import spread, written

#: The point join's cells are of every third level; DEEPER times a cell of more than EDGES edges is cut into 8 x 8.
STRIDE, DEEPEST, DEEPER, EDGES = 3, 12, 2, 16
#: Degrees by which a cell is wider than the places that rounding puts into it.
SLACK = 1e-9


def _level(e: Column, deepest: int) -> Column:
    """The deepest level at which an extent in shares of the world is no larger than a cell."""
    size = F.greatest(e["x1"] - e["x0"], e["y1"] - e["y0"], F.lit(2.0**-30))
    return F.greatest(F.lit(0), F.least(F.lit(deepest), F.floor(-F.log2(size)))).cast("int")


def _grid(e: Column, z: Column, margin: float) -> Column:
    """(x, y) of the cells of a level that an extent, widened by ``margin``, meets."""
    n = F.pow(F.lit(2.0), z)
    span = lambda a, b: F.sequence(*[F.greatest(F.lit(0), F.least(n - 1, F.floor(v * n))).cast("int") for v in (a - margin, b + margin)])
    return F.flatten(F.transform(span(e["x0"], e["x1"]), lambda x: F.transform(span(e["y0"], e["y1"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _box(z: Column, x: Column, y: Column, margin: float = 0.0) -> tuple[Column, Column, Column, Column]:
    side = F.pow(F.lit(2.0), -z)
    return x * side - margin, y * side - margin, (x + 1) * side + margin, (y + 1) * side + margin


def _children(t: Column, levels: int) -> Column:
    """The cells that a cell has some levels deeper."""
    n = 2**levels
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.struct((n * t["x"] + F.floor(i / n)).cast("int").alias("x"), (n * t["y"] + i % n).cast("int").alias("y")))


def by_tile(polygons: DataFrame, z: int, margin: float = 0.0) -> DataFrame:
    """The columns of ``polygons`` with x, y and ``rings`` cut to the tile of level ``z`` and a margin, for each tile
    that a polygon meets.  ``rings`` is in shares of the world, 0 to 1 along both axes."""
    if z < 0:
        raise ValueError("levels begin at 0")
    rest = [c for c in polygons.columns if c != "rings"]
    p = polygons.where((F.size("rings") > 0) & (F.size(F.element_at("rings", 1)) > 2)).withColumn("_e", extent(F.col("rings")))
    p = p.withColumn("_z", _level(F.col("_e"), z)).withColumn("_t", F.explode(_grid(F.col("_e"), F.col("_z"), margin))).drop("_e")

    def cut(d: DataFrame) -> DataFrame:
        # explode keeps what is left, if any: a filter would be pushed below and cut twice
        left = let(clip_rings(F.col("rings"), _box(F.col("_z"), F.col("_t.x"), F.col("_t.y"), margin)), lambda r: F.when(F.size(r) > 0, F.array(r)).otherwise(F.slice(F.array(r), 1, 0)))
        return d.select(*rest, "_z", "_t", F.explode(left).alias("rings"))

    first = p.agg(F.min("_z")).first()[0]
    p = cut(p)
    for k in range(z if first is None else first, z):
        here = F.col("_z") == k  # what starts deeper waits
        p = p.withColumn("_t", F.explode(F.when(here, _children(F.col("_t"), 1)).otherwise(F.array("_t")))).withColumn("_z", F.when(here, k + 1).otherwise(F.col("_z")))
        p = cut(p)
    return p.select(*rest, F.col("_t.x").alias("x"), F.col("_t.y").alias("y"), "rings")


def cover(polygons: DataFrame, id_col: str) -> DataFrame:
    """(id_col, z, x, y, whole, edges): cells over a polygon of ``rings`` in degrees; those that lie within it as a
    whole have no edges, the others those that a ray to the east from within the cell may cross."""
    share = lambda e: F.struct(*[((e[c] + h) / (2 * h)).alias(c) for c, h in (("x0", 180.0), ("y0", 90.0), ("x1", 180.0), ("y1", 90.0))])
    p = spread(polygons.where((F.size("rings") > 0) & (F.size(F.element_at("rings", 1)) > 2)), id_col).select(id_col, "rings", share(extent(F.col("rings"))).alias("_e"))
    p = p.withColumn("z", (F.floor(_level(F.col("_e"), DEEPEST) / STRIDE) * STRIDE + STRIDE).cast("int"))
    p = p.withColumn("t", F.explode(_grid(F.col("_e"), F.col("z"), 0.0))).select(id_col, "z", "t", all_edges(F.col("rings")).alias("edges"))

    def judged(d: DataFrame) -> DataFrame:
        x0, y0, x1, y1 = box = [v * 2 * h - h + e for v, h, e in zip(_box(F.col("z"), F.col("t.x"), F.col("t.y")), (180.0, 90.0) * 2, (-SLACK, -SLACK, SLACK, SLACK), strict=True)]
        reach = F.filter("edges", lambda s: (F.least(s["a"]["lat"], s["b"]["lat"]) <= y1) & (F.greatest(s["a"]["lat"], s["b"]["lat"]) >= y0) & (F.greatest(s["a"]["lon"], s["b"]["lon"]) >= x0))
        cell = lambda e, n, whole: F.struct(F.when(whole, F.slice(e, 1, 0)).otherwise(e).alias("edges"), n.alias("n"), whole.alias("whole"))
        kept = lambda e, n: let((n == 0) & odd(e, (x0 + x1) / 2, (y0 + y1) / 2), lambda whole: F.when(whole | (n > 0), F.array(cell(e, n, whole))).otherwise(F.slice(F.array(cell(e, n, whole)), 1, 0)))
        found = let(reach, lambda e: let(F.size(F.filter(e, lambda s: step_meets_box(s, box))), lambda n: kept(e, n)))
        return d.select(id_col, "z", "t", F.explode(found).alias("c")).select(id_col, "z", "t", "c.*")

    more = F.col("n") > EDGES
    last = done = written(judged(p))
    for _ in range(DEEPER):
        deeper = last.where(more)
        if deeper.isEmpty():
            break
        last = written(judged(spread(deeper.select(id_col, (F.col("z") + STRIDE).alias("z"), F.explode(_children(F.col("t"), STRIDE)).alias("t"), "edges"), id_col, "t")))
        done = done.where(~more).unionByName(last)
    return done.select(id_col, "z", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "whole", "edges")


def shapes(polygons: DataFrame) -> DataFrame:
    """(_shape, rings): the different polygons, numbered, as a table; polygons without rings are left out."""
    return written(polygons.where(F.size("rings") > 0).select("rings").distinct().withColumn("_shape", F.monotonically_increasing_id()))


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str) -> DataFrame:
    """(point_id, polygon_id) for each point (lon, lat) within a polygon (rings), by the even-odd rule.

    Both sides meet by cell, at each of the few levels that the cover has; a cell within a polygon needs no further
    test.  Coordinates that are null or off the globe and polygons of fewer than three points are left out.

    Each different polygon is covered once and each place tested once; then polygons and last points of one shape or
    place meet these pairs by equality, so that pairs of rows are never moved.
    """
    kinds = shapes(polygons)
    cells = cover(kinds, "_shape")
    levels = sorted(r["z"] for r in cells.select("z").distinct().collect())  # a few, from DEEPEST, STRIDE and DEEPER
    x, y = (F.col("lon") + 180.0) / 360.0, (F.col("lat") + 90.0) / 180.0
    at = lambda v, z: F.least(F.lit(2**z - 1), F.greatest(F.lit(0), F.floor(v * 2.0**z))).cast("int")
    keys = F.array(*[F.struct(F.lit(z).alias("z"), at(x, z).alias("x"), at(y, z).alias("y")) for z in levels]) if levels else F.array().cast("array<struct<z:int,x:int,y:int>>")
    valid = points.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).select(point_id, "lon", "lat")
    p = valid.select("lon", "lat").distinct().select("lon", "lat", F.explode(keys).alias("k")).select("lon", "lat", "k.z", "k.x", "k.y")
    near = p.join(cells.hint("merge"), ["z", "x", "y"]).where(F.col("whole") | odd(F.col("edges"), F.col("lon"), F.col("lat"))).select("lon", "lat", "_shape")
    own = polygons.join(kinds.hint("merge"), "rings").select(polygon_id, "_shape")
    pairs = near.join(own.hint("merge"), "_shape").select("lon", "lat", polygon_id)
    return spread(pairs, "lon", "lat").join(spread(valid, "lon", "lat").hint("merge"), ["lon", "lat"]).select(point_id, polygon_id)


def mercator_rings(rings: Column) -> Column:
    """Rings in degrees as shares of the web map's square, y to the south."""
    from haulspark.functions.geo import mercator

    half = 20037508.342789244
    place = lambda p: let(mercator(p["lon"], p["lat"]), lambda m: point((m["x"] + half) / (2 * half), (half - m["y"]) / (2 * half)))
    return F.transform(rings, lambda r: F.transform(r, place))
