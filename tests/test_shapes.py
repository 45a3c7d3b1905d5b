"""Lines and polygons: boxes, point in polygon, tiles, against brute force in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haulspark.functions import shapes
from haulspark.operators import polygons, tiles

RINGS = "array<array<struct<lon:double,lat:double>>>"
LINE = "array<struct<lon:double,lat:double>>"


def has(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def star(r, cx, cy, size, n):
    """A ring that turns about a centre."""
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + size * r.uniform(0.2, 1) * math.cos(t), cy + size * r.uniform(0.2, 1) * math.sin(t)) for t in turns]


def shapes_of(seed, n):
    r, out = random.Random(seed), []
    for i in range(n):
        cx, cy, size = r.uniform(-120, -80), r.uniform(28, 45), r.choice([0.01, 0.3, 3.0, 12.0])
        rings = [star(r, cx, cy, size, r.randint(3, 60))]
        if r.random() < 0.4:
            rings.append([(cx + size * 0.1 * x, cy + size * 0.1 * y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
        out.append((i, [ring + ring[:1] if r.random() < 0.5 else ring for ring in rings]))
    return out


def test_points_in_polygons(spark):
    rows, r = shapes_of(1, 40), random.Random(2)
    points = [(i, r.uniform(-130, -70), r.uniform(20, 50)) for i in range(700)] + [(700 + i, rings[0][0][0] + 0.01, rings[0][0][1]) for i, rings in rows] + [(900, None, 1.0), (901, 500.0, 1.0), (902, float("nan"), 1.0)]
    rows += [(100, []), (101, [[(0.0, 0.0), (1.0, 1.0)]]), (102, [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]]), (103, None)]
    p = spark.createDataFrame(rows, f"zone int, rings {RINGS}")
    got = polygons.points_in_polygons(spark.createDataFrame(points, "pid int, lon double, lat double"), p, "pid", "zone").collect()
    good = [(i, x, y) for i, x, y in points if x is not None and abs(x) <= 180]
    assert sorted((x["pid"], x["zone"]) for x in got) == sorted((i, k) for i, x, y in good for k, rings in rows if k not in (101, 103) and has(rings, x, y))
    assert polygons.points_in_polygons(spark.createDataFrame(points, "pid int, lon double, lat double"), p.limit(0), "pid", "zone").count() == 0


def test_a_cover_keeps_few_edges_in_a_cell(spark):
    ring = [(-100 + 10 * math.cos(t / 500 * math.pi), 38 + 10 * math.sin(t / 500 * math.pi)) for t in range(1000)]
    c = polygons.cover(spark.createDataFrame([(1, [ring])], f"zone int, rings {RINGS}"), "zone").collect()
    assert sum(x["whole"] for x in c) > 3 and {x["z"] for x in c} <= {6, 9} and max(len(x["edges"]) for x in c) < 500
    inside = sum(4.0 ** -x["z"] for x in c if x["whole"]) * 360 * 180
    around = sum(4.0 ** -x["z"] for x in c) * 360 * 180
    assert inside < math.pi * 100 < around < 1.6 * math.pi * 100


def meets(rings, box):
    x0, y0, x1, y1 = box
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            t0, t1 = 0.0, 1.0
            for p, d, low, high in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
                if d:
                    u, v = sorted(((low - p) / d, (high - p) / d))
                    t0, t1 = max(t0, u), min(t1, v)
                elif not low <= p <= high:
                    t1 = -1.0
            if t0 <= t1:
                return True
    return has(rings, x0, y0)


def test_shapes_in_boxes(spark):
    rows = shapes_of(3, 60) + [(200, [[(-101.0, 36.0), (-99.0, 36.0), (-99.0, 38.0), (-101.0, 38.0)], [(-100.6, 36.4), (-99.4, 36.4), (-99.4, 37.6), (-100.6, 37.6)]])]
    df = spark.createDataFrame(rows, f"i int, rings {RINGS}")
    for box in ((-105.0, 30.0, -95.0, 40.0), (-100.5, 36.5, -99.5, 37.5), (-100.0, 36.0, -100.0, 36.0), (-81.0, 44.0, -80.0, 45.0)):
        got = {x["i"]: (x["p"], x["l"]) for x in df.select("i", shapes.polygon_meets_box(F.col("rings"), box).alias("p"), shapes.line_meets_box(F.element_at("rings", 1), box).alias("l")).collect()}
        for i, rings in rows:
            line = rings[0]
            assert got[i] == (meets(rings, box), any(meets([[a, b]], box) for a, b in zip(line, line[1:]))), (i, box)
    assert df.where("i = 200").select(shapes.polygon_meets_box(F.col("rings"), (-100.5, 36.5, -99.5, 37.5)).alias("p")).first()["p"] is False  # within the hole


def test_line_tiles_are_cut_before_they_are_capped(spark):
    diagonal = [(-125.0, 25.0), (-65.0, 50.0)]
    short = [(-100.05, 46.0), (-100.0, 46.05)]
    df = spark.createDataFrame([(1, diagonal, 10), (2, short, 1)], f"id int, line {LINE}, rank int")
    for cap in (1, 100):
        got = tiles.line_tiles(df, tiles.Layer("l", cap=cap, importance="rank"), 7, ["id"], "id").collect()
        assert [r["ids"] for r in got if 2 in r["ids"]] == [[2]]
    assert 20 < len(got) < 60
    deep = tiles.line_parts(df.where("id = 1"), 12, ["id"]).count()
    assert deep < 3 * 2**12 * 60 / 360  # about two tiles for each column, not their product


def test_line_parts_equal_clipping_each_tile(spark):
    r = random.Random(4)
    lines = [(i, [(r.uniform(-179, 179), r.uniform(-80, 80)) for _ in range(r.randint(2, 6))]) for i in range(12)] + [(50, [(10.0, 10.0), (10.0, 60.0), (10.0, 60.0)]), (51, [(5.0, 5.0)]), (52, None)]
    z, half = 4, 20037508.342789244
    got = {(r["id"], r["x"], r["y"]): tiles.joined(r["parts"]) for r in tiles.line_parts(spark.createDataFrame(lines, f"id int, line {LINE}"), z, ["id"]).collect()}
    want = {}
    for i, line in lines:
        w = [((6378137.0 * math.radians(x) + half) / (2 * half) * 16, (half - 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(y) / 2))) / (2 * half) * 16) for x, y in line or ()]
        for x in range(16):
            for y in range(16):
                if parts := tiles.clip([(a - x, b - y) for a, b in w]):
                    want[i, x, y] = parts
    assert got.keys() == want.keys()
    for k, parts in got.items():
        flat = lambda p: [v for part in p for xy in part for v in xy]
        assert len(flat(parts)) == len(flat(want[k])) and max(abs(a - b) for a, b in zip(flat(parts), flat(want[k]))) <= 1


def test_polygon_parts_have_the_area_of_the_polygon(spark):
    rows, z, half = shapes_of(7, 25), 6, 20037508.342789244
    place = lambda x, y: ((6378137.0 * math.radians(x) + half) / (2 * half), (half - 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(y) / 2))) / (2 * half))
    got = tiles.polygon_parts(spark.createDataFrame(rows, f"id int, rings {RINGS}"), z, ["id"]).collect()
    margin = tiles.MARGIN
    r = random.Random(1)
    for g in got:
        turn = [sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(p, [*p[1:], p[0]])) for p in g["parts"]]
        assert turn[0] > 0 and all(t < 0 for t in turn[1:])
        assert all(-65 <= v[c] <= 4161 for p in g["parts"] for v in p for c in "xy")
    for g in r.sample(got, 25):  # places drawn in the tile lie in the part just if they lie in the polygon
        rings = [[place(*p) for p in ring] for ring in dict(rows)[g["id"]]]
        parts = [[(v["x"], v["y"]) for v in p] for p in g["parts"]]
        wrong = 0
        for _ in range(200):
            u, v = r.uniform(-margin, 1 + margin), r.uniform(-margin, 1 + margin)
            wrong += has(rings, (g["x"] + u) / 2**z, (g["y"] + v) / 2**z) != has(parts, u * 4096, v * 4096)
        assert wrong <= 2
    seen = {(g["id"], g["x"], g["y"]) for g in got}
    for i, rings in rows:  # and no tile is missing
        rings = [[place(*p) for p in ring] for ring in rings]
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        for _ in range(200):
            x, y = r.uniform(min(xs), max(xs)), r.uniform(min(ys), max(ys))
            if has(rings, x, y):
                assert (i, int(x * 2**z), int(y * 2**z)) in seen


@pytest.mark.parametrize("cap", [1, 10])
def test_polygon_tiles(spark, cap):
    square = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    rows = [(1, [square(-100.0, 40.0, 20.0), square(-100.0, 40.0, 1.0)], 5, "a"), (2, [square(-100.0, 40.0, 0.5)], 1, "b"), (3, [square(-100.0, 40.0, 0.5)], None, None), (4, [[(0.0, 0.0), (1.0, 1.0)]], 9, "c"), (5, None, 9, "c")]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}, rank int, name string")
    got = tiles.polygon_tiles(df, tiles.Layer("p", cap=cap, importance="rank"), 7, ["id", "name"], "id").collect()
    assert all(r["n"] == len(r["ids"]) <= cap and r["ids"] == [1, 2, 3][: r["n"]] or r["ids"] in ([2, 3][:cap],) for r in got)
    assert len(got) > 100 and bytes(got[0]["tile"]).count(b"\x0f") >= 1
    assert tiles.polygon_tiles(df, tiles.Layer("p", min_zoom=8), 7, ["id"], "id").count() == 0


def test_equal_polygons_are_cut_once(spark, monkeypatch):
    seen = []
    for f in ("cover", "by_tile"):
        monkeypatch.setattr(polygons, f, lambda df, *a, f=getattr(polygons, f): (seen.append(df.count()), f(df, *a))[1])
    p = lambda x, y: (float(x), float(y))
    kinds = [[[p(0, 0), p(4, 0), p(4, 4), p(0, 4)]], [[p(2, 2), p(6, 2), p(6, 6)]], []]
    rows = spark.createDataFrame([(i, kinds[i % 3]) for i in range(90)], "pid int, rings array<array<struct<lon:double,lat:double>>>")
    points = spark.createDataFrame([(i, *[(1.0, 1.0), (3.5, 2.5), (9.0, 9.0)][i % 3]) for i in range(60)] + [(99, None, 1.0)], "id int, lon double, lat double")
    got = [(r["id"], r["pid"]) for r in polygons.points_in_polygons(points, rows, "id", "pid").collect()]
    want = {(i, j) for i in range(60) for j in range(90) if (i % 3, j % 3) in ((0, 0), (1, 0), (1, 1))}
    assert len(got) == len(set(got)) and set(got) == want
    parts = tiles.polygon_parts(rows, 3, ["pid"]).collect()
    assert {r["pid"] % 3 for r in parts} == {0, 1} and len(parts) == 30 * len({(r["pid"] % 3, r["x"], r["y"]) for r in parts})
    assert seen == [2, 2]
