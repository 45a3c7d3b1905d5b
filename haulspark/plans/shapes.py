"""Queries over polygons, tiles of lines and polygons, and events by their exact shapes, with DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.operators import chains, live, polygons, spatial, tiles
from haulspark.plans.carriers import carrier, oracle
from haulspark.plans.domain import HAV, _graph_lines, now

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return put


def _point(x, y):
    return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))


def _square(h):
    x, y = F.col("lon"), F.col("lat")
    return F.array(_point(x - h, y - h), _point(x + h, y - h), _point(x + h, y + h), _point(x - h, y + h))


# ---- polygons that contain points ------------------------------------------------------------------------

def _zones(spark, sf):
    """Each place's zone: a triangle of two degrees with a square hole."""
    x, y = F.col("lon"), F.col("lat")
    ring = F.array(_point(x - 1.0, y - 1.0), _point(x + 1.0, y - 0.5), _point(x, y + 1.0))
    return carrier(spark, sf, "v_places").select("place_id", F.array(ring, _square(0.1)).alias("rings"))


def _cross(ax: str, ay: str, bx: str, by: str) -> str:
    """Whether a ray from (b.lon, b.lat) to the east crosses an edge, as 0 or 1."""
    return f"CASE WHEN (({ay}) > b.lat) <> (({by}) > b.lat) AND b.lon < (({bx}) - ({ax})) * (b.lat - ({ay})) / (({by}) - ({ay})) + ({ax}) THEN 1 ELSE 0 END"


ZONE = [("p.lon - 1.0::DOUBLE", "p.lat - 1.0::DOUBLE"), ("p.lon + 1.0::DOUBLE", "p.lat - 0.5::DOUBLE"), ("p.lon", "p.lat + 1.0::DOUBLE")]
HOLE = [(f"p.lon {i} 0.1::DOUBLE", f"p.lat {j} 0.1::DOUBLE") for i, j in ("--", "+-", "++", "-+")]
CROSSED = " + ".join(_cross(*a, *b) for ring in (ZONE, HOLE) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


@query("zone_bridges", f"SELECT place_id, nbi_id FROM {{v_places}} p JOIN {{v_bridges}} b ON b.lon BETWEEN p.lon - 1 AND p.lon + 1 AND b.lat BETWEEN p.lat - 1 AND p.lat + 1 WHERE ({CROSSED}) % 2 = 1")
def zone_bridges(spark, sf):
    """The bridges in every place's zone."""
    return polygons.points_in_polygons(carrier(spark, sf, "v_bridges").select("nbi_id", "lon", "lat"), _zones(spark, sf), "nbi_id", "place_id").select("place_id", "nbi_id")


# ---- events by their shapes ------------------------------------------------------------------------------


def _shaped_events(spark, sf):
    """A line for each third bridge, a triangle for each third, a point for the rest; every seventh has no geometry."""
    k, x, y = F.col("nbi_id"), F.col("lon"), F.col("lat")
    known = k % 7 != 0
    line = F.when(k % 3 == 0, F.array(_point(x - 3, y - 3), _point(x + 3, y + 2))).when(k % 3 == 2, F.array(_point(x, y)))
    rings = F.when(k % 3 == 1, F.array(F.array(_point(x - 3, y - 3), _point(x + 3, y - 3), _point(x - 3, y + 3))))
    side = lambda c, low: F.when(known, F.when(k % 3 == 2, c).when((k % 3 == 0) & F.lit(not low), c + (3 if c is x else 2)).otherwise(c + (-3 if low else 3)))
    return carrier(spark, sf, "v_bridges").select(
        k.alias("event_id"), F.when(k % 5 == 0, now()).alias("soft_closed_at"), F.when(known, line).alias("line"), F.when(known, rings).alias("rings"),
        side(x, True).alias("xmin"), side(y, True).alias("ymin"), side(x, False).alias("xmax"), side(y, False).alias("ymax"),
    )


def _touch(ax: str, ay: str, bx: str, by: str) -> str:
    """Whether a piece touches the box of -104 to -96 by 31 to 39."""
    sides = [f"(({bx}) - ({ax})) * ({y} - ({ay})) - (({by}) - ({ay})) * ({x} - ({ax}))" for x in (-104, -96) for y in (31, 39)]
    return f"(least({ax}, {bx}) <= -96 AND greatest({ax}, {bx}) >= -104 AND least({ay}, {by}) <= 39 AND greatest({ay}, {by}) >= 31 AND least({', '.join(sides)}) <= 0 AND greatest({', '.join(sides)}) >= 0)"


CORNERS = [("lon - 3", "lat - 3"), ("lon + 3", "lat - 3"), ("lon - 3", "lat + 3")]


@query("live_events", f"""
    SELECT nbi_id AS event_id FROM {{v_bridges}} WHERE nbi_id % 5 <> 0 AND (nbi_id % 7 = 0 OR CASE nbi_id % 3 WHEN 0 THEN {_touch('lon - 3', 'lat - 3', 'lon + 3', 'lat + 2')} WHEN 2 THEN lon BETWEEN -104 AND -96 AND lat BETWEEN 31 AND 39
      ELSE {' OR '.join(_touch(*a, *b) for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))} OR (lon - 3 <= -104 AND lat - 3 <= 31 AND -104 - (lon - 3) + 31 - (lat - 3) < 6) END)""")
def live_events(spark, sf):
    """Open events that touch a box by their shapes; those without any come along."""
    return live.events_in_box(_shaped_events(spark, sf), (-104.0, 31.0, -96.0, 39.0), include_nongeo=True).select("event_id")


# ---- tiles -------------------------------------------------------------------------------------------------

#: A place on the web map's square at level 6, y to the south, in tiles.
MX = "((6378137.0::DOUBLE * radians({x}) + 20037508.342789244::DOUBLE) / 626172.1357121639::DOUBLE)"
MY = "((20037508.342789244::DOUBLE - 6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians({y}) / 2))) / 626172.1357121639::DOUBLE)"
M = "0.015625::DOUBLE"


@query("line_tiles", f"""
    WITH l AS (SELECT edge_id, {MX.format(x='a.lon')} AS ax, {MY.format(y='a.lat')} AS ay, {MX.format(x='b.lon')} AS bx, {MY.format(y='b.lat')} AS cy FROM {{v_edges}} e JOIN {{v_places}} a ON a.place_id = e.u JOIN {{v_places}} b ON b.place_id = e.v WHERE edge_id % 7 <> 0),
    t AS (SELECT * FROM l JOIN (SELECT range AS x FROM range(64)) ON x BETWEEN least(ax, bx) - 1 - {M} AND greatest(ax, bx) + {M} JOIN (SELECT range AS y FROM range(64)) ON y BETWEEN least(ay, cy) - 1 - {M} AND greatest(ay, cy) + {M}),
    c AS (SELECT *, CASE WHEN bx = ax THEN 0.0::DOUBLE ELSE least((x - {M} - ax) / (bx - ax), (x + 1 + {M} - ax) / (bx - ax)) END AS p0, CASE WHEN bx = ax THEN 1.0::DOUBLE ELSE greatest((x - {M} - ax) / (bx - ax), (x + 1 + {M} - ax) / (bx - ax)) END AS p1,
      CASE WHEN cy = ay THEN 0.0::DOUBLE ELSE least((y - {M} - ay) / (cy - ay), (y + 1 + {M} - ay) / (cy - ay)) END AS q0, CASE WHEN cy = ay THEN 1.0::DOUBLE ELSE greatest((y - {M} - ay) / (cy - ay), (y + 1 + {M} - ay) / (cy - ay)) END AS q1 FROM t),
    k AS (SELECT *, greatest(0.0::DOUBLE, p0, q0) AS t0, least(1.0::DOUBLE, p1, q1) AS t1 FROM c),
    m AS (SELECT x, y, edge_id FROM k WHERE t0 <= t1 AND (round_even((ax + t0 * (bx - ax) - x) * 4096, 0) <> round_even((ax + t1 * (bx - ax) - x) * 4096, 0) OR round_even((ay + t0 * (cy - ay) - y) * 4096, 0) <> round_even((ay + t1 * (cy - ay) - y) * 4096, 0))),
    n AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY edge_id DESC) AS r FROM m)
    SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY r) AS ids FROM n WHERE r <= 50 GROUP BY x, y""")
def line_tiles(spark, sf):
    """Tiles of the edges that are on the map; states of the edges are a column that this table lacks."""
    layer = tiles.Layer("edges", cap=50, importance="edge_id", row_filter="edge_id % 7 <> 0", min_zoom=3)
    return tiles.line_tiles(_graph_lines(spark, sf), layer, 6, ["edge_id", "state"], "edge_id").select("x", "y", "n", F.array_join("ids", ",").alias("ids"))


def _units(v: str, tile: str) -> str:
    """A coordinate in tile units, within the tile and its margin."""
    return f"round_even((least({tile} + 1 + {M}, greatest({tile} - {M}, {v})) - {tile}) * 4096, 0)"


@query("polygon_tiles", f"""
    WITH p AS (SELECT nbi_id, lon, lat, {MX.format(x='(lon - 0.5::DOUBLE)')} AS x0, {MX.format(x='(lon + 0.5::DOUBLE)')} AS x1, {MY.format(y='(lat + 0.5::DOUBLE)')} AS y0, {MY.format(y='(lat - 0.5::DOUBLE)')} AS y1,
      {MX.format(x='(lon - 0.2::DOUBLE)')} AS u0, {MX.format(x='(lon + 0.2::DOUBLE)')} AS u1, {MY.format(y='(lat + 0.2::DOUBLE)')} AS v0, {MY.format(y='(lat - 0.2::DOUBLE)')} AS v1 FROM {{v_bridges}}),
    t AS (SELECT * FROM p JOIN (SELECT range AS x FROM range(64)) ON x BETWEEN x0 - 1 - {M} AND x1 + {M} JOIN (SELECT range AS y FROM range(64)) ON y BETWEEN y0 - 1 - {M} AND y1 + {M}),
    a AS (SELECT x, y, nbi_id, ({_units('x1', 'x')} - {_units('x0', 'x')}) * ({_units('y1', 'y')} - {_units('y0', 'y')}) AS outer_, ({_units('u1', 'x')} - {_units('u0', 'x')}) * ({_units('v1', 'y')} - {_units('v0', 'y')}) AS hole FROM t)
    SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(outer_ - hole) AS DOUBLE) AS area FROM a WHERE outer_ <> 0 GROUP BY x, y""")
def polygon_tiles(spark, sf):
    """Squares around all bridges, each with a square hole, by tile: how many, and their area in tile units."""
    squares = carrier(spark, sf, "v_bridges").select("nbi_id", F.array(_square(0.5), _square(0.2)).alias("rings"))
    return tiles.polygon_parts(squares, 6, ["nbi_id"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


# ---- corridors ---------------------------------------------------------------------------------------------


@query("corridor_chains", """
    WITH RECURSIVE l AS (SELECT edge_id % 4 AS route, edge_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v),
    ends AS (SELECT route, edge_id, 0 AS side, x0 AS x, y0 AS y FROM l UNION ALL SELECT route, edge_id, 1, x1, y1 FROM l),
    two AS (SELECT route, x, y FROM ends GROUP BY route, x, y HAVING count(*) = 2 AND min(edge_id) <> max(edge_id)),
    links AS (SELECT a.route, a.edge_id AS edge, 1 - a.side AS way, b.edge_id AS after, b.side AS after_way FROM two t JOIN ends a ON a.route = t.route AND a.x = t.x AND a.y = t.y JOIN ends b ON b.route = t.route AND b.x = t.x AND b.y = t.y AND b.edge_id <> a.edge_id),
    darts AS (SELECT route, edge_id AS edge, w AS way FROM l, (SELECT unnest([0, 1]) AS w)),
    walk(route, s_edge, s_way, edge, way, pos) AS (SELECT d.route, d.edge, d.way, d.edge, d.way, 0 FROM darts d WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.route = d.route AND k.after = d.edge AND k.after_way = d.way)
      UNION ALL SELECT w.route, s_edge, s_way, k.after, k.after_way, pos + 1 FROM walk w JOIN links k ON k.route = w.route AND k.edge = w.edge AND k.way = w.way)
    SELECT route, min(edge) AS chain, count(*) AS lines, string_agg(CAST(edge AS VARCHAR), ',' ORDER BY pos) AS edges FROM walk GROUP BY route, s_edge, s_way HAVING min_by(way, edge) = 0""")
def corridor_chains(spark, sf):
    """The lines of four corridors joined end to end, in order."""
    lines = _graph_lines(spark, sf).withColumn("route", F.col("edge_id") % 4)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "edge_id"))), lambda s: s["edge_id"].cast("string")), ",").alias("edges")
    return chains.chains(lines, ["route"]).groupBy("route", "chain").agg(F.count(F.lit(1)).alias("lines"), listed)


# ---- the whole globe -------------------------------------------------------------------------------------


def _globe(k: str, a: int, b: int) -> str:
    """Places all over the globe, many of them at the 180th meridian and at the poles; for Spark and DuckDB alike."""
    lon = f"CAST(CASE {k} % 5 WHEN 0 THEN 17990 + ({k} * {a}) % 20 WHEN 1 THEN ({k} * {a}) % 20 - 18000 ELSE ({k} * {a}) % 36000 - 18000 END AS DOUBLE) / CAST(100 AS DOUBLE)"
    lat = f"CAST(CASE {k} % 3 WHEN 0 THEN 8500 + ({k} * {b}) % 500 ELSE ({k} * {b}) % 18000 - 9000 END AS DOUBLE) / CAST(100 AS DOUBLE)"
    return f"{lon} AS lon, {lat} AS lat"


PLACES, BRIDGES = _globe("place_id", 7919, 104729), _globe("nbi_id", 7907, 104717)


def _on_globe(spark, sf):
    places, bridges = carrier(spark, sf, "v_places"), carrier(spark, sf, "v_bridges")
    return places.selectExpr("place_id", *_columns(PLACES)), bridges.selectExpr("nbi_id", *_columns(BRIDGES))


def _columns(text: str) -> list[str]:
    lon, lat = text.split(" AS lon, ")
    return [f"{lon} AS lon", lat]


GLOBE = f"FROM (SELECT place_id, {PLACES} FROM {{v_places}}) a JOIN (SELECT nbi_id, {BRIDGES} FROM {{v_bridges}}) b ON " + HAV.format(a="a", b="b")


@query("globe_within", "SELECT a.place_id, b.nbi_id, round(" + HAV.format(a="a", b="b") + f", 1) AS dist_m {GLOBE} <= 150000")
def globe_within(spark, sf):
    """Pairs within 150 km all over the globe, also across the 180th meridian and at the poles."""
    a, b = _on_globe(spark, sf)
    return spatial.dwithin(a.select("place_id", "lon", "lat"), b.select("nbi_id", "lon", "lat"), 150_000.0, digits=1).select("l.place_id", "r.nbi_id", "dist_m")


@query("globe_nearest", "SELECT place_id, rank, nbi_id, dist_m FROM (SELECT a.place_id, b.nbi_id, round(d, 1) AS dist_m, CAST(row_number() OVER (PARTITION BY a.place_id ORDER BY d, b.nbi_id) AS INTEGER) AS rank FROM (SELECT place_id, "
       + PLACES + " FROM {v_places}) a JOIN LATERAL (SELECT nbi_id, " + HAV.format(a="a", b="b") + " AS d FROM (SELECT nbi_id, " + BRIDGES + " FROM {v_bridges}) b) b ON true) t WHERE rank <= 2")
def globe_nearest(spark, sf):
    """The two bridges nearest to every place, however far."""
    a, b = _on_globe(spark, sf)
    return spatial.nearest(a, b, "place_id", "nbi_id", 2).select("place_id", "rank", "nbi_id", F.round("dist_m", 1).alias("dist_m"))
