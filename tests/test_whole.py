"""Queries against brute force on the smallest tables."""

import heapq
import math

import pytest

from haulspark.operators import conflate, graph, spatial
from haulspark.plans import domain, roads
from haulspark.plans.carriers import carrier

SF = "/root/testdata/sf0.001"


def metres(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def bridges(spark):
    return carrier(spark, SF, "v_bridges").collect()


@pytest.fixture(scope="module")
def places(spark):
    return carrier(spark, SF, "v_places").collect()


def test_licences_of_all_shops(spark, bridges):
    want = {}
    for s in bridges:
        k = s["nbi_id"]
        rank = lambda n, k=k: 1 if n % 4 == k % 4 else 2 if n % 3 == k % 3 else 3
        pri, late = min((rank(x["nbi_id"]), -x["nbi_id"]) for x in bridges if x["name"] == s["name"])
        want[k] = (-late, {1: "name_zip", 2: "name_city"}[pri])
    got = roads.QUERIES["licence_cascade"](spark, SF).collect()
    assert len(got) == len(bridges) and {r["shop_id"]: (r["licence_id"], r["rule"]) for r in got} == want


@pytest.mark.parametrize("name, radius, columns", [("map_match", 50_000, ("shop_id", "osm_id")), ("chain_witness", 70_000, ("place_id", "brand"))])
def test_nearest_of_all(spark, bridges, places, name, radius, columns):
    want = {}
    for p in places:
        d, k, brand = min((metres(p, b), b["nbi_id"], b["brand"]) for b in bridges)
        if d <= radius:
            want[p["place_id"]] = (k if name == "map_match" else brand, round(d, 1))
    got = roads.QUERIES[name](spark, SF).collect()
    assert {r[columns[0]]: (r[columns[1]], r["dist_m"]) for r in got} == want and len(got) == len(want)


def test_swap_keeps_all_rows(spark, bridges):
    got = domain.QUERIES["swap_then_read"](spark, SF).collect()
    assert sorted(got) == sorted((b["nbi_id"], b["clearance_in"]) for b in bridges)


def test_conflation_of_all_rows(spark, bridges):
    a, b = (carrier(spark, SF, f"v_src_{s}").collect() for s in "ab")
    assert len(a) == len(b) == len(bridges)
    grams = lambda name: {f"  {w} "[i : i + 3] for w in name.lower().replace("#12", "").split() for i in range(len(w) + 1)}
    want, scored = {}, []
    for x in a:
        for y in b:
            d = metres(x, y)
            g, h = grams(x["name"]), grams(y["name"])
            sim = len(g & h) / len(g | h)
            if d <= 150 and sim > 0.3:
                s = 0.6 * sim + 0.25 * (1 - d / 150) + 0.15 * (x["brand"] == y["brand"])
                want[x["rid"], y["rid"]] = "merge" if s >= 0.85 else "distinct" if s <= 0.55 else "gray"
                scored += [(-s, x["rid"], y["rid"])] if s >= 0.85 else []
    assert {(r["o"], r["f"]): r["band"] for r in domain.QUERIES["conflate_pairs"](spark, SF).collect()} == want
    taken = []
    for _, o, f in sorted(scored):
        if all(o != p and f != q for p, q in taken):
            taken.append((o, f))
    assert sorted((r["o"], r["f"]) for r in domain.QUERIES["conflate_match"](spark, SF).collect()) == sorted(taken)
    merged = domain.QUERIES["conflate_merge"](spark, SF).collect()
    assert len(merged) == len(a) + len(b) - len(taken) and sorted(r["o"] for r in merged if r["o"] is not None) == sorted(x["rid"] for x in a)
    assert sum(1 + r["dropped"] + (r["cell_flag"] == "cell_name_merge") for r in domain.QUERIES["collisions"](spark, SF).collect()) == len(merged)


def dijkstra(edges, origin):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap = {}, [(0.0, origin)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for m, w in near.get(n, ()):
                heapq.heappush(heap, (d + w, m))
    return best


def test_shortest_paths_over_all_edges(spark):
    edges = [(r["u"], r["v"], r["length_m"]) for r in carrier(spark, "/root/testdata/sf0.01", "v_edges").collect()]
    nodes = {n for u, v, _ in edges for n in (u, v)}
    want = {u: best[u + 37] for u in nodes if u + 37 in nodes and u + 37 in (best := dijkstra(edges, u))}
    got = domain.QUERIES["shortest_path"](spark, "/root/testdata/sf0.01").collect()
    assert max(want) > 45 and {r["pair_id"]: r["distance"] for r in got} == want and len(got) == len(want)


def test_shortest_path_by_high_nodes(spark):
    edges = [(0, 37, 50.0), (0, 90, 1.0), (90, 91, 1.0), (91, 37, 1.0), (5, 6, 1.0)]
    e = spark.createDataFrame(edges, "u bigint, v bigint, length_m double")
    pairs = spark.createDataFrame([(1, 0, 37), (2, 0, 6)], "pair_id int, origin bigint, goal bigint")
    assert [tuple(r) for r in graph.shortest_paths(e, pairs).collect()] == [(1, 3.0, 3, [0, 90, 91, 37])]


LINE = "array<struct<lon:double,lat:double>>"


def off_line(p, line, n=4000):
    """Metres from a point to a line, by closely set points on it."""
    spots = [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for a, b in zip(line, line[1:] or line) for i in range(n + 1)]
    return min(metres(p, {"lon": x, "lat": y}) for x, y in spots)


def test_nearest_line(spark):
    lines = [(1, [(-120.0, 30.0), (-80.0, 45.0)]), (2, [(-100.0, 31.0), (-99.0, 31.2), (-99.0, 33.0)]), (3, [(-70.0, 45.0)]), (4, [(-99.0, 33.0), (-98.0, 33.0)]), (5, [])]
    points = [(1, -99.5, 31.0), (2, -99.1, 32.0), (3, -71.0, 44.0), (4, -110.0, 33.0), (5, -99.0, 33.2), (6, None, None), (7, 20.0, -30.0)]
    got = {r["p"]: (r["i"], r["dist_m"]) for r in spatial.nearest_line(spark.createDataFrame(points, "p int, lon double, lat double"), spark.createDataFrame(lines, f"i int, line {LINE}"), "p", "i").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    for p, x, y in points:
        if x is not None:
            d, i = min((round(off_line({"lon": x, "lat": y}, line), 0), i) for i, line in lines if line)
            assert got[p][0] == i and got[p][1] == pytest.approx(d, abs=max(30, 1e-4 * d))


def test_station_state_is_computed(spark):
    got = {r["nbi_id"]: r for r in domain.QUERIES["station_state"](spark, SF).collect()}
    at = {p["place_id"]: p for p in carrier(spark, SF, "v_places").collect()}
    edges = [(r["u"], r["edge_id"], [(at[n]["lon"], at[n]["lat"]) for n in (r["u"], r["v"])]) for r in carrier(spark, SF, "v_edges").collect() if r["u"] in at and r["v"] in at]
    left = [b for b in carrier(spark, SF, "v_bridges").collect() if b["nbi_id"] % 3 == 2 or b["nbi_id"] % 3 == 1 and b["posting"] is None]
    for b in left[:12]:
        assert got[b["nbi_id"]]["state"] == at[min((off_line(b, line), k, u) for u, k, line in edges)[2]]["state"]
    assert len(left) > 5 and {got[b["nbi_id"]]["state_source"] for b in left} == {"nearest truck route"} and "NEAR" not in {r["state"] for r in got.values()}


def test_snap_candidates(spark):
    stubs = [(i, [(-100.0, 40.0 + i / 1e4), (-99.99, 40.0 + i / 1e4)], 2) for i in range(70)]
    e = spark.createDataFrame([*stubs, (100, [(-100.0, 40.1), (-99.0, 40.1)], 1), (101, [(-100.0, 40.15), (-99.0, 40.15)], 1), (102, [(-100.0, 40.12), (-99.0, 40.12)], 3)], f"edge_id int, line {LINE}, component int")
    got = graph.snap_candidates(spark.createDataFrame([(1, -99.995, 39.999), (2, -90.0, 40.0)], "point_id int, lon double, lat double"), e).collect()
    assert sorted((r["point_id"], r["component"], r["edge_id"]) for r in got) == [(1, 1, 100), (1, 2, 0)]  # 3 is beyond the 60 nearest


def test_path_status(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 99), (4, None, 1), (5, 2, 3)], "pair_id int, origin bigint, goal bigint")
    paths = lambda *ids: spark.createDataFrame([(i, 5.0) for i in ids], "pair_id int, distance double")
    got = graph.path_status(pairs, spark.createDataFrame([(1,), (2,), (3,)], "node_id bigint"), paths(1), paths(1, 5)).collect()
    assert {r["pair_id"]: r["status"] for r in got} == {1: "ok", 2: "no_path", 3: "not_on_network", 4: "not_on_network", 5: "no_compliant_path"}


def test_losers_of_the_matching_are_gray(spark):
    p = spark.createDataFrame([(1, 1, 0.95, "merge"), (1, 2, 0.9, "merge"), (3, 3, 0.6, "gray"), (4, 4, 0.2, "distinct")], "o bigint, f bigint, score double, band string")
    got = conflate.gray_ids(p, conflate.match_one_to_one(p.where("band = 'merge'"))).collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 3), ("b", 2), ("b", 3)]
