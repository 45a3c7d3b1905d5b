"""Path search against brute force, over cells smaller than the graphs."""

import heapq
import random

import pytest

from haulspark.operators import graph, routing
from haulspark.operators.components import components


def dijkstra(edges, starts, goals):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap, done = None, [(c, 0, (n,), n) for n, c in starts.items() if n in near], set()
    heapq.heapify(heap)
    while heap:
        d, h, path, n = heapq.heappop(heap)
        if n in done:
            continue
        done.add(n)
        if n in goals and (best is None or (d + goals[n], h, path) < best):
            best = (d + goals[n], h, path)
        for m, w in near[n]:
            heapq.heappush(heap, (d + w, h + 1, (*path, m), m))
    return best


def test_chain_of_two_thousand_edges(spark, monkeypatch):
    monkeypatch.setattr(routing, "CELL_NODES", 512)
    e = spark.range(2000).selectExpr("id AS u", "id + 1 AS v", "cast(1 AS double) AS length_m")
    pairs = spark.createDataFrame([(1, 0, 2000), (2, 1500, 3), (3, 5, 5), (4, 7, 90_000), (5, None, 3)], "pair_id int, origin bigint, goal bigint")
    got = {r["pair_id"]: r for r in graph.shortest_paths(e, pairs).collect()}
    assert {k: (r["distance"], r["hops"]) for k, r in got.items()} == {1: (2000.0, 2000), 2: (1497.0, 1497), 3: (0.0, 0)}
    assert got[1]["path"] == list(range(2001)) and got[3]["path"] == [5]


@pytest.mark.parametrize("cell", [7, 1000])
def test_search_equals_dijkstra(spark, monkeypatch, cell):
    monkeypatch.setattr(routing, "CELL_NODES", cell)
    monkeypatch.setattr(routing, "PAIRS", 5)
    r = random.Random(cell)
    edges = [(r.randrange(60), r.randrange(60), float(r.randint(0, 6))) for _ in range(110)]
    trips = {i: ({r.randrange(60): float(r.randint(0, 4)) for _ in range(2)}, {r.randrange(66): float(r.randint(0, 4)) for _ in range(2)}) for i in range(25)}
    end = lambda k: spark.createDataFrame([(i, n, c) for i, t in trips.items() for n, c in t[k].items()], "pair_id int, node bigint, cost double")
    got = {x["pair_id"]: x for x in routing.search(spark.createDataFrame(edges, "u bigint, v bigint, length_m double"), end(0), end(1)).collect()}
    for i, (starts, goals) in trips.items():
        want = dijkstra(edges, starts, goals)
        row = got.get(i)
        if want is None:
            assert row is None or row["distance"] is None
        else:
            assert (row["distance"], row["hops"], tuple(row["path"])) == want and row["explored"] > 0


ROADS = [(1, 0, 1, 100.0, None), (2, 1, 2, 100.0, "posted 10 lb"), (3, 1, 3, 150.0, None), (4, 3, 2, 150.0, None), (5, 2, 4, 100.0, None), (6, 5, 6, 10.0, None), (7, 4, 7, 100.0, "structure closed to all traffic"), (8, 1, 2, 400.0, None)]


def test_routes_between_places_on_edges(spark):
    edges = spark.createDataFrame(ROADS, "edge_id int, u bigint, v bigint, length_m double, why string")
    trips = [(1, 1, 0.25, 5, 0.5), (2, 1, 0.1, 1, 0.7), (3, 2, 0.1, 2, 0.5), (4, 1, 0.5, 6, 0.5), (5, 5, 0.9, 7, 0.5), (6, None, 0.1, 1, 0.5), (7, 99, 0.5, 1, 0.5), (8, 6, 0.2, 6, 0.2), (9, 3, 0.5, 4, 0.5)]
    routed = routing.routes(edges, spark.createDataFrame(trips, "pair_id int, o_edge int, o_frac double, g_edge int, g_frac double")).cache()
    got = {r["pair_id"]: r for r in routed.collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "ok", 2: "ok", 3: "no_compliant_path", 4: "no_compliant_path", 5: "ok", 6: "not_on_network", 7: "not_on_network", 8: "ok", 9: "ok"}
    assert got[1]["distance"] == 75 + 300 + 50 and got[1]["path"] == [1, 3, 2] and got[1]["edge_ids"] == [3, 4] and got[1]["edges_excluded"] == 1 and got[1]["exclusion_examples"] == ["posted 10 lb"]
    assert got[2]["distance"] == pytest.approx(60) and got[2]["edge_ids"] == [1] and got[3]["exclusion_examples"] == ["posted 10 lb"]
    assert got[8]["distance"] == 0 and got[9]["distance"] == 150 and got[9]["path"] == [3]
    assert got[5]["distance"] == pytest.approx(10 + 50)  # the first and the last edge are seeded, whatever their limits
    assert routing.require(routed, 1)["hops" if "hops" in routed.columns else "distance"] is not None
    with pytest.raises(routing.NoRoute) as e:
        routing.require(routed, 4)
    assert e.value.code == "no_compliant_path"
    with pytest.raises(routing.NoRoute) as e:
        routing.require(routed, 12)
    assert e.value.code == "not_on_network"


LINE = "array<struct<lon:double,lat:double>>"


def test_routes_between_points(spark):
    lines = [(1, 0, 1, 1000.0, None, 1, [(-100.0, 40.0), (-99.0, 40.0)]), (2, 1, 2, 1000.0, None, 1, [(-99.0, 40.0), (-98.0, 40.0)]), (3, 8, 9, 500.0, None, 2, [(-100.0, 40.05), (-99.5, 40.05)])]
    edges = spark.createDataFrame(lines, f"edge_id int, u bigint, v bigint, length_m double, why string, component int, line {LINE}")
    points = spark.createDataFrame([(1, -99.75, 40.04), (2, -98.5, 40.01), (3, -50.0, 10.0)], "point_id int, lon double, lat double")
    c = graph.snap_candidates(points, edges)
    got = {r["pair_id"]: r for r in routing.route_points(spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "pair_id int, origin_id int, goal_id int"), edges, c).collect()}
    assert got[1]["status"] == "ok" and got[1]["distance"] == pytest.approx(750 + 500, abs=2) and got[1]["path"] == [1] and 5000 < got[1]["access_m"] < 6000  # the nearer stub is of another component
    assert got[2]["status"] == "not_on_network"


def test_mainland(spark):
    e = spark.createDataFrame([(1, 1, 2, "truck_route"), (2, 2, 3, "connector"), (3, 7, 8, "truck_route")], "edge_id int, u bigint, v bigint, kind string")
    assert [r["edge_id"] for r in graph.mainland_edges(e, graph.ranked_components(e)).collect()] == [1]


def test_components_of_stars_pairs_loops_and_random_graphs(spark):
    r = random.Random(9)
    for edges in ([(5, k) for k in range(6, 400)] + [(900, k) for k in range(401, 500)] + [(5, 450), (1000, 1001), (2000, 2000), (1002, 1002), (1002, 1003), (None, 4)], [(r.randrange(200), r.randrange(200)) for _ in range(140)], [(1, 1)], []):
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
        assert len(got) == len(parent) and {x["node"]: x["component"] for x in got} == {n: find(n) for n in parent}


def test_unfinished_components_raise(spark):
    e = spark.range(40).selectExpr("id AS u", "id + 1 AS v")
    assert components(e).where("component = 0").count() == 41
    with pytest.raises(RuntimeError, match="not complete"):
        components(e, max_rounds=1)


def test_time_and_rounds_do_not_follow_the_path(spark, monkeypatch):
    """A state holds no path: one cell takes as long with a long way behind it, and pieces are put in order by jumps."""
    import pandas as pd

    n = routing.CELL_NODES
    chain = pd.DataFrame({"u": range(n), "v": range(1, n + 1), "w": 1.0, "inside": True, "to": 0, "blocked": False, "edge_id": 0})
    sizes = []
    for behind in (1, 20_000):
        front = pd.DataFrame({"pair_id": [1], "round": [0], "cell": [0], "limit": [float("inf")], "d": [float(behind)], "hops": [behind], "node": [0], "goal_nodes": [[n]], "goal_costs": [[0.0]]})
        out = routing._explore(front, chain)
        sizes.append(out.memory_usage(deep=True).sum())
        assert out[out["kind"] == routing.GOAL]["d"].tolist() == [behind + n]
    assert sizes[0] == sizes[1]
    monkeypatch.setattr(routing, "CELL_NODES", 16)
    e = spark.range(200).selectExpr("id AS u", "id + 1 AS v", "cast(1 AS double) AS length_m")
    got = routing.shortest_paths(e, spark.createDataFrame([(1, 3, 198), (2, 150, 20)], "pair_id int, origin bigint, goal bigint")).collect()
    assert {r["pair_id"]: r["path"] for r in got} == {1: list(range(3, 199)), 2: list(range(150, 19, -1))}
    assert routing.distances(e, spark.createDataFrame([(1, 3, 198)], "pair_id int, origin bigint, goal bigint")).first()["distance"] == 195.0


def test_cells_are_patches_along_the_curve(spark, monkeypatch):
    side = 24
    monkeypatch.setattr(routing, "CELL_NODES", 64)
    node = lambda x, y: x * side + y
    edges = [(node(x, y), node(x + a, y + b), 1.0 + (x * y) % 3) for x in range(side) for y in range(side) for a, b in ((0, 1), (1, 0)) if x + a < side and y + b < side]
    e = spark.createDataFrame(edges, "u bigint, v bigint, length_m double")
    places = spark.createDataFrame([(node(x, y), -100 + x / 100, 40 + y / 100) for x in range(side) for y in range(side)], "node bigint, lon double, lat double")
    crossing = lambda p: routing._cells(e, p)[1].where("not inside").count()
    assert crossing(places) < crossing(None)
    pairs = spark.createDataFrame([(i, i * 37 % side**2, i * 101 % side**2) for i in range(12)], "pair_id int, origin bigint, goal bigint")
    for p in (places, None):
        for r in routing.shortest_paths(e, pairs, p).collect():
            i = r["pair_id"]
            assert (r["distance"], r["hops"], tuple(r["path"])) == dijkstra(edges, {i * 37 % side**2: 0.0}, {i * 101 % side**2: 0.0})


def test_curve_interleaves(one):
    from pyspark.sql import functions as F

    for lon, lat in ((-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (-97.123, 31.77)):
        x, y = (min(2**24 - 1, int((v + h) / (2 * h) * 2**24)) for v, h in ((lon, 180), (lat, 90)))
        assert one(routing.curve(F.col("a"), F.col("b")), a=lon, b=lat) == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(24))


def test_edges_are_copied_by_the_pairs_of_a_cell(spark, monkeypatch):
    """Copies of a cell's edges follow the pairs in that cell, not the pairs of the whole graph."""
    monkeypatch.setattr(routing, "CELL_NODES", 64)
    monkeypatch.setattr(routing, "PAIRS", 32)
    seen, explore = spark.sparkContext.accumulator(0), routing._explore

    def counted(front, edges):
        seen.add(len(edges))
        return explore(front, edges)

    monkeypatch.setattr(routing, "_explore", counted)
    n = 20 * 64
    e = spark.range(n - 1).selectExpr("id AS u", "id + 1 AS v", "cast(1 AS double) AS length_m")
    pairs = spark.range(n - 1).selectExpr("id AS pair_id", "id AS origin", "id + 1 AS goal")
    got = routing.distances(e, pairs).collect()
    assert len(got) == n - 1 and all(r["distance"] == 1.0 for r in got)
    assert 2 * (n - 1) < seen.value < 8 * 2 * (n - 1)
