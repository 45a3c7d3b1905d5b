import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from haulspark.functions.geo import EARTH_M
from haulspark.operators import conflate, gates, graph, presence, spatial
from haulspark.operators.components import components
from haulspark.sinks import tables as sinks
from haulspark.sources import feeds
from haulspark.streaming import tracking


def haversine(x1, y1, x2, y2):
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(a))


def points(spark, n, seed, name="id", box=(-100, 30, -98, 32)):
    r = random.Random(seed)
    rows = [(i, r.uniform(box[0], box[2]), r.uniform(box[1], box[3])) for i in range(n)] + [(n, None, None)]
    return rows, spark.createDataFrame(rows, f"{name} int, lon double, lat double")


@pytest.mark.parametrize("radius", [1500.0, 20_000.0, 150_000.0])
def test_dwithin_is_exact(spark, radius):
    a, da = points(spark, 150, 1)
    b, db = points(spark, 120, 2)
    want = {(i, j) for i, x, y in a[:-1] for j, u, v in b[:-1] if haversine(x, y, u, v) <= radius}
    got = [(r["i"], r["j"]) for r in spatial.dwithin(da, db, radius).select(F.col("l.id").alias("i"), F.col("r.id").alias("j")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_is_exact(spark):
    a, da = points(spark, 60, 3)
    b, db = points(spark, 40, 4, "rid", box=(-120, 25, -70, 48))
    got = {(r["id"], r["rank"]): r["rid"] for r in spatial.nearest(da.where("lon is not null"), db.where("lon is not null"), "id", "rid", k=2, start_m=10_000.0).collect()}
    for i, x, y in a[:-1]:
        best = sorted((haversine(x, y, u, v), j) for j, u, v in b[:-1])[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in best]
    assert spatial.nearest(da, db.limit(0), "id", "rid").count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*edges, (None, 1)], "u int, v int")).collect()}
    assert got == {x: find(x) for u, v in edges for x in (u, v)}
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_shortest_paths_equal_dijkstra(spark):
    import heapq

    r = random.Random(6)
    edges = [(i, r.randrange(40), r.randrange(40), float(r.randrange(1, 9))) for i in range(90)]
    near = {}
    for _, u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))

    def dijkstra(s, t):
        seen, heap = {}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in seen:
                continue
            seen[x] = d
            for y, w in near.get(x, ()):
                heapq.heappush(heap, (d + w, y))
        return seen.get(t)

    pairs = [(k, r.randrange(40), r.randrange(40)) for k in range(6)] + [(6, 3, 3), (7, 0, 999)]
    got = {x["pair_id"]: x for x in graph.shortest_paths(spark.createDataFrame(edges, "edge_id int, u int, v int, length_m double"), spark.createDataFrame(pairs, "pair_id int, origin int, goal int")).collect()}
    for k, s, t in pairs:
        assert (got[k]["distance"] if k in got else None) == dijkstra(s, t)
        if k in got:
            assert got[k]["path"][0] == s and got[k]["path"][-1] == t and len(got[k]["path"]) == got[k]["hops"] + 1


def test_routes_respect_the_vehicle(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 2, 1.0), (3, 0, 2, 5.0)], "edge_id int, u int, v int, length_m double")
    limits = spark.createDataFrame([(1, 150.0, None, False, False), (2, None, None, False, True)], "edge_id int, min_clearance_in double, max_weight_lb double, closed boolean, hazmat_blocked boolean")
    pair = spark.createDataFrame([(1, 0, 2)], "pair_id int, origin int, goal int")
    far = lambda v: graph.route(edges, limits, pair, v).first()["distance"]
    assert far(graph.Vehicle()) == 2.0 and far(graph.Vehicle(height_in=140)) == 2.0
    assert far(graph.Vehicle(height_in=162)) == 5.0 and far(graph.Vehicle(hazmat=True)) == 5.0
    assert len(graph.Vehicle(width_in=120, length_ft=60, weight_lb=90_000).warnings()) == 3


def test_noding_cuts_where_nodes_touch(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0)]), (2, [(0.5, 0.0), (0.5, 1.0)])], "edge_id int, line array<struct<lon:double,lat:double>>")
    nodes = graph.build_nodes(lines)
    got = graph.node_lines(lines, nodes).orderBy("edge_id", "piece").select("edge_id", "line").collect()
    assert [(r["edge_id"], [tuple(p) for p in r["line"]]) for r in got] == [(1, [(0.0, 0.0), (0.5, 0.0)]), (1, [(0.5, 0.0), (1.0, 0.0)]), (2, [(0.5, 0.0), (0.5, 1.0)])]
    assert nodes.count() == 4


def test_connectors_join_dead_ends_once(spark):
    nodes = spark.createDataFrame([(1, -100.0, 40.0, 1), (2, -100.0001, 40.0, 1), (3, -101.0, 40.0, 1), (4, -101.0001, 40.0, 3)], "node_id int, lon double, lat double, degree int")
    assert {(r["u"], r["v"]) for r in graph.connectors(nodes).collect()} == {(1, 2), (3, 4)}


def test_greedy_matching(spark):
    r = random.Random(7)
    pairs = [(o, f, r.choice([0.86, 0.9, 0.95])) for o in range(25) for f in range(25) if r.random() < 0.3]
    want, used_o, used_f = set(), set(), set()
    for o, f, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if o not in used_o and f not in used_f:
            want.add((o, f))
            used_o.add(o)
            used_f.add(f)
    got = conflate.match_one_to_one(spark.createDataFrame(pairs, "o int, f int, score double")).collect()
    assert {(x["o"], x["f"]) for x in got} == want
    assert conflate.match_one_to_one(spark.createDataFrame([], "o int, f int, score double")).count() == 0


def test_conflation_end_to_end(spark):
    a = spark.createDataFrame([(1, "Joe Truck Stop #12", -100.0, 40.0, "Joe", 0.9), (2, "Far Away", -90.0, 35.0, None, 0.4), (3, "Twin", -80.0, 33.0, None, 0.9), (4, "TWIN", -80.0, 33.0, None, 0.2)], "rid bigint, name string, lon double, lat double, brand string, conf double")
    b = spark.createDataFrame([(7, "JOE TRUCK STOP", -100.0002, 40.0, "joe"), (8, "Other Place", -100.0003, 40.0, None)], "rid bigint, name string, lon double, lat double, brand string")
    p = conflate.candidate_pairs(a, b)
    m = conflate.match_one_to_one(p.where("band = 'merge'"))
    rows = conflate.merge(a, b, m)
    assert {r["src"] for r in rows.collect()} == {"merged", "a", "b"} and rows.count() == 5
    done = conflate.resolve_collisions(rows)
    assert done.count() == 4 and done.agg(F.sum("dropped")).first()[0] == 1


def test_gates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4), (None, 5), (None, 6)], "k string, ord int")
    ok, rejects = gates.split(gates.duplicate_reason(df, "k", "ord"))
    assert sorted(r["ord"] for r in ok.collect()) == [2, 4, 5, 6]
    assert sorted(json.loads(r["raw_record"])["ord"] for r in rejects.collect()) == [1, 3]
    was = spark.createDataFrame([("c", "1"), ("c", None), ("c", "2")], "check_id string, entity_id string")
    now = spark.createDataFrame([("c", "2"), ("c", "3")], "check_id string, entity_id string")
    assert {(r["entity_id"], r["action"]) for r in gates.reconcile_conflicts(was, now).collect()} == {("1", "close"), (None, "close"), ("2", "keep"), ("3", "open")}


def test_snapshot_swap(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    sinks.snapshot_swap(spark.range(5), t)
    with pytest.raises(sinks.RefusedLoad):
        sinks.snapshot_swap(spark.range(2), t, min_rows=3)
    assert sinks.current(spark, t).count() == 5
    sinks.snapshot_swap(spark.range(7), t)
    assert sinks.current(spark, t).count() == 7
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{t}-none")


def test_lifecycle(spark):
    live = spark.createDataFrame([("s", "1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), None, "x")], "source_id string, event_id string, first_seen timestamp, last_seen timestamp, soft_closed_at timestamp, p string")
    empty = spark.createDataFrame([], "source_id string, event_id string, p string")
    t = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    polled = spark.createDataFrame([("s",)], "source_id string")
    closed = sinks.event_lifecycle(live, empty, t(2), sources=polled)
    assert closed.first()["soft_closed_at"] == dt.datetime(2024, 1, 2)
    again = sinks.event_lifecycle(closed, spark.createDataFrame([("s", "1", "y")], empty.schema), t(3)).first()
    assert again["soft_closed_at"] is None and again["first_seen"] == dt.datetime(2024, 1, 1) and again["p"] == "y"
    assert sinks.event_lifecycle(live, empty, t(2)).first()["soft_closed_at"] is None  # its source was not polled


def test_upsert_and_csv(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert {(r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    sinks.export_csv(spark.createDataFrame([(2, ["x", "y"]), (1, None)], "id int, tags array<string>"), f"{tmp_path}/csv", first=1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()[0]["id"] == "1"


def test_rescore_keeps_other_flags(spark):
    df = spark.createDataFrame([(1, ["mine", "conflict_open", "mine"], None)], "id int, flags array<string>, observed_at timestamp")
    none = spark.createDataFrame([], "status string, entity_type string, entity_id string")
    out = presence.rescore(df, none, F.lit(0.9), F.lit("2024-01-01").cast("timestamp"), 10.0, {"id": 1}, F.col("id"), "t").first()
    assert out["flags"] == ["mine", "mine", "vintage_unknown"] and out["changed"]


def test_liveness_table(spark):
    places = spark.createDataFrame([(1, None, True), (2, True, None), (3, None, None)], "place_id int, closed boolean, licence_active boolean")
    ledger = spark.createDataFrame([("places", "2", "fsq", dt.datetime(2024, 1, 1), None), ("places", "2", "osm", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3))], "entity_type string, entity_id string, source_id string, last_seen_at timestamp, missing_since timestamp")
    out = {r["place_id"]: r for r in presence.rescore_liveness(places, ledger, None, F.lit("2024-01-02").cast("timestamp"), 365.0).collect()}
    assert out[2]["live_state"] == "closed" and out[2]["last_seen_src"] == "osm" and "vanished_from_source" in out[2]["reasons"]
    assert out[1]["reasons"] == ["licence_active", "never_confirmed"] and out[3]["liveness"] == 0


def test_feeds(spark):
    doc = lambda o: spark.createDataFrame([("f", json.dumps(o))], "path string, content string")
    prices = feeds.weekly_prices(doc({"response": {"data": [{"period": "2024-01-01", "duoarea": "R1X", "value": "3.9"}, {"period": "2024-01-01", "duoarea": "ZZ", "value": 4}, {"period": "2024-01-01", "duoarea": "NUS", "value": None}]}}))
    assert {(r["region"], r["price_usd_gal"]) for r in prices.collect()} == {("PADD1A", 3.9), ("ZZ", 4.0)}
    with pytest.raises(feeds.NotAFeed):
        feeds.weather_alerts(doc({"status": "error"})).collect()
    assert feeds.weather_alerts(doc({"features": []})).count() == 0
    zone = {"features": [{"id": "1", "geometry": {"type": "LineString", "coordinates": [[-100.0, 40.0], [-100.1, 40.1]]}, "properties": {"core_details": {"road_names": ["I-35"], "update_date": "2024-01-01T00:00:00Z"}, "start_date_accuracy": "verified"}}], "feed_info": {}}
    row = feeds.work_zones(doc(zone)).first()
    assert row["event_id"] == "wzdx/1" and row["geom_wkt"] == "LINESTRING (-100.0 40.0,-100.1 40.1)" and row["is_start_date_verified"] is True and row["is_end_date_verified"] is None and row["road_names"] == ["I-35"]
    with pytest.raises(feeds.NotAFeed):
        feeds.work_zones(doc({"features": [{"properties": {}}]})).collect()
    cc = lambda **k: {"cc": {"index": "7", "inService": "true", "location": {"longitude": "-120", "latitude": "39"}, **k}}
    got = feeds.chain_controls(doc({"data": [cc(statusData={"status": "R-0"}), cc(statusData={"status": ""}), cc(inService="false")]})).collect()
    assert [r["active"] for r in got] == [False, None] and got[0]["geom_wkt"] == "POINT (-120.0 39.0)"
    html = '<tr><a href="?state=TX"><td class="regular">$3.1</td><td class="x diesel">$ 3.7720</td></tr><tr><a href="?state=QQ"><td class="diesel">$1.0</td>'
    assert [tuple(r) for r in feeds.state_prices(spark.createDataFrame([("f", html)], "path string, content string")).collect()] == [("TX", 3.772)]


def test_bridge_records_merge(spark):
    cols = "STATE_CODE_001 STRUCTURE_NUMBER_008 RECORD_TYPE_005A LAT_016 LONG_017 MIN_VERT_CLR_010 VERT_CLR_OVER_MT_053 VERT_CLR_UND_054B FACILITY_CARRIED_007 FEATURES_DESC_006A OPERATING_RATING_064 INVENTORY_RATING_066 OPEN_CLOSED_POSTED_041".split()
    rows = [("48", "A1", "2", "30000000", "097000000", "4.5", "99.99", "0", "UNDER", None, "30", "20", "A"), ("48", "A1", "1", "30000000", "097000000", "99.99", "99.99", "5.0", "I-35", "CREEK", "40", "25", "P"), ("06", "B", "1", None, None, "99.99", None, None, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, dt.date(2025, 1, 1)) for r in rows], ", ".join(f"{c} string" for c in cols) + ", observed_at date").coalesce(1)
    got = {r["nbi_id"]: r for r in feeds.merge_bridges(df).collect()}
    a = got["48A1"]
    assert a["name"] == "I-35 / CREEK" and a["state"] == "TX" and a["min_vert_clearance_in"] == pytest.approx(177.2) and a["record_types"] == ["1", "2"] and a["lon"] == -97.0
    assert got["06B"]["min_vert_clearance_in"] is None and got["06B"]["lat"] is None


def test_bridge_archive(spark, tmp_path):
    import zipfile

    cols = "STATE_CODE_001,STRUCTURE_NUMBER_008,RECORD_TYPE_005A,LAT_016,LONG_017,MIN_VERT_CLR_010,VERT_CLR_OVER_MT_053,VERT_CLR_UND_054B,FACILITY_CARRIED_007,FEATURES_DESC_006A,OPERATING_RATING_064,INVENTORY_RATING_066,OPEN_CLOSED_POSTED_041"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.csv", "x")
        z.writestr("2024All.txt", f"{cols}\n48,'A,1',1,30000000,097000000,4.5,,,'CALLE ÑU',,30,20,A\n".encode("latin-1"))
    got = feeds.bridges(spark, f"{tmp_path}/a.zip", f"file://{tmp_path}/out").collect()
    assert [(r["nbi_id"], r["name"], r["observed_at"]) for r in got] == [("48A,1", "CALLE ÑU", dt.date(2024, 1, 1))]


def test_streamed_dedup_and_lifecycle_equal_batch(spark, tmp_path):
    schema = "device_id int, observed_at timestamp, ping_id int, lon double, lat double, speed_kph double"
    rows = [(d, dt.datetime(2024, 1, 1, 0, m), 10 * d + m, -100.0, 40.0, 50.0) for d in range(3) for m in range(5)]
    r = random.Random(8)
    for i in range(3):
        part = rows[i::3] + r.sample(rows, 4)
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = tracking.dedup_fixes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), "1 day")
    q = stream.writeStream.format("memory").queryName("fixes").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("fixes")
    assert sorted(map(tuple, got.select("device_id", "observed_at").collect())) == sorted((a, b) for a, b, *_ in rows)
    assert {(x["device_id"], x["ping_count"]) for x in tracking.last_state(got).collect()} == {(d, 5) for d in range(3)}

    table = f"file://{tmp_path}/events"
    sinks.snapshot_swap(spark.createDataFrame([], "source_id string, event_id string, first_seen timestamp, last_seen timestamp, soft_closed_at timestamp, p string"), table, min_rows=0)
    for i, batch in enumerate([[("s", "1", "a"), ("s", "2", "b")], [("s", "2", "c")], [("s", None, None)]]):
        spark.createDataFrame(batch, "source_id string, event_id string, p string").coalesce(1).write.json(f"{tmp_path}/ev/{i}")
    sink = tracking.lifecycle_sink(table, lambda i: F.lit(f"2024-01-{i + 1:02d} 00:00:00").cast("timestamp"))
    q = spark.readStream.schema("source_id string, event_id string, p string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/ev/*").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(x["event_id"], x["soft_closed_at"] is not None) for x in sinks.current(spark, table).collect()} == {("1", True), ("2", True)}


def test_ping_rules(spark):
    rows = [(1, 0.0, 0.0, 50.0, "2024-01-01 00:00:00"), (2, 999.0, 0.0, 50.0, "2024-01-01 00:00:00"), (3, 0.0, 0.0, 250.0, "2024-01-01 00:00:00"), (4, 0.0, 0.0, None, "2024-01-01 00:02:01")]
    df = spark.createDataFrame(rows, "i int, lon double, lat double, speed_kph double, t string").withColumn("observed_at", F.col("t").cast("timestamp"))
    got = df.orderBy("i").select(tracking.ping_reason(F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("r")).collect()
    assert [r["r"] for r in got] == [None, "out_of_bounds", "bad_speed", "in_future"]


def test_line_tiles(spark):
    from haulspark.operators import tiles

    line = "array<struct<lon:double,lat:double>>"
    lines = [(1, [(-100.0, 40.0), (-80.0, 40.0)], 5), (2, [(-100.0, 40.0), (-99.9, 40.05), (-99.8, 40.0)], None), (3, [(-100.0, 40.0)], 1), (4, [], 1), (5, [(-90.0, 10.0), (-90.0, 60.0)], 9)]
    df = spark.createDataFrame(lines, f"id int, line {line}, rank int")
    rows = tiles.line_tiles(df, tiles.Layer("l", importance="rank", row_filter="id <> 5"), 6, ["id", "lacking"], "id").collect()
    first = int((-100 + 180) / 360 * 64)
    assert sorted(r["x"] for r in rows) == list(range(first, int(100 / 360 * 64) + 1)) and len({r["y"] for r in rows}) == 1
    assert {r["x"]: r["n"] for r in rows}[first] == 2 and all(r["n"] <= 2 for r in rows) and all(b"lacking" not in bytes(r["tile"]) for r in rows)
    assert tiles.line_tiles(df, tiles.Layer("l", min_zoom=7), 6, ["id"], "id").count() == 0
    assert {r["n"] for r in tiles.line_tiles(df, tiles.Layer("l", cap=1), 6, ["id"], "id").collect()} == {1}
    assert tiles.clip([(-1.0, 0.5), (2.0, 0.5)]) == [[(-64, 2048), (4160, 2048)]] and tiles.clip([(2.0, 2.0), (3.0, 3.0)]) == [] and len(tiles.clip([(0.5, 0.5), (0.5, 2.0), (0.6, 2.0), (0.6, 0.5)])) == 2


def test_long_chains_of_lines_are_joined_in_linear_time():
    import time

    from haulspark.operators import tiles

    start = time.time()
    chain = [[(float(i), 0.0), (i + 1.0, 0.0)] if i % 2 else [(i + 1.0, 0.0), (float(i), 0.0)] for i in range(60_000)]
    out = tiles.merge_lines(chain)
    assert len(out) == 1 and len(out[0]) == 60_001 and out[0] in ([(float(i), 0.0) for i in range(60_001)], [(float(i), 0.0) for i in range(60_000, -1, -1)]) and time.time() - start < 10


def test_pointers_are_never_overwritten(spark, tmp_path, monkeypatch):
    from haulspark.sinks import tables

    table = f"file://{tmp_path}/t"
    for n in (3, 5):
        tables.snapshot_swap(spark.range(n), table)
        assert tables.current(spark, table).count() == n
    with pytest.raises(tables.RefusedLoad):
        tables.snapshot_swap(spark.range(0), table)
    assert tables._pointers(spark, table) == ["pointer-000000000001", "pointer-000000000002"] and tables.current(spark, table).count() == 5
    names = tables._pointers
    monkeypatch.setattr(tables, "_pointers", lambda s, t: names(s, t)[:1])  # as a writer that was faster would make it
    with pytest.raises(tables.RefusedLoad, match="another writer"):
        tables.snapshot_swap(spark.range(7), table)
    monkeypatch.undo()
    assert tables.current(spark, table).count() == 5


def test_refresh_by_checksum(spark, tmp_path):
    import hashlib

    from haulspark import control

    target, data = f"file://{tmp_path}/big.bin", [b"abc" * 1000, b"def"]
    md5 = hashlib.md5(b"".join(data)).hexdigest()
    assert control.fetch_if_changed(spark, target, md5, lambda: data, dry_run=True)[0]
    assert control.fetch_if_changed(spark, target, md5, lambda: data) == (True, f"replaced ({md5[:12]})")
    assert control.fetch_if_changed(spark, target, md5, lambda: data)[0] is False
    with pytest.raises(ValueError, match="old file stays"):
        control.fetch_if_changed(spark, target, "0" * 32, lambda: [b"other"])
    assert (tmp_path / "big.bin").read_bytes() == b"".join(data)


def test_collisions_keep_both_rows_values(spark):
    rows = [(1, None, "Joe", -100.0, 40.0, None, 0.2, 5, "a", ["a"], False), (None, 2, "JOE", -100.0, 40.0, "brand", None, 9, "b", ["b"], True), (3, None, "Sue", -90.0, 40.0, "x", 0.9, None, "a", ["a"], False), (4, None, "SUE", -90.0, 40.0, None, 0.9, 3, "a", ["a"], False)]
    df = spark.createDataFrame(rows, "o bigint, f bigint, name string, lon double, lat double, brand string, conf double, observed_at int, src string, present_in array<string>, gray boolean")
    got = {r["cell_flag"]: r for r in conflate.resolve_collisions(df).collect()}
    m = got["cell_name_merge"]
    assert (m["o"], m["f"], m["name"], m["brand"], m["observed_at"], m["src"], m["present_in"], m["gray"], m["dropped"]) == (1, 2, "JOE", "brand", 9, "merged", ["a", "b"], True, 0)
    c = got["cell_name_collision"]
    assert (c["o"], c["brand"], c["dropped"]) == (4, None, 1)  # the dated row stays


def test_live_alerts_and_zones(spark):
    from haulspark.operators import live

    docs = ['{"zones": ["A", "B"]}', '{"zones": [], "geocode": {"UGC": ["C"]}}', '{"affectedZones": ["D"]}', "{}", None, "junk"]
    assert [r["z"] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(live.zones(F.col("d")).alias("z")).collect()] == [["A", "B"], ["C"], ["D"], [], [], []]


def test_paged_series_that_do_not_end_raise():
    from haulspark import control

    page = json.dumps({"response": {"total": 1000, "data": [1]}}).encode()
    with pytest.raises(ConnectionError, match="20 of 1000"):
        control.fetch_keyed(lambda url, params: page, "u", "k")


def test_conflation_broadcasts_no_side(spark, monkeypatch):
    plans = []
    look = lambda df: (df.collect(), plans.append(df._jdf.queryExecution().executedPlan().toString()))
    monkeypatch.setattr(conflate, "checkpoint", lambda df: (look(df), df.localCheckpoint())[1])
    a = spark.createDataFrame([(1, "Big Rig Repair", -97.0, 35.0, "X", 0.9), (2, "Joe's Diesel", -97.0, 36.0, "Y", 0.1)], "rid long, name string, lon double, lat double, brand string, conf double")
    b = a.drop("conf").withColumn("rid", F.col("rid") + 10)
    p = conflate.candidate_pairs(a, b).localCheckpoint()
    m = conflate.match_one_to_one(p.where("band = 'merge'"))
    merged = conflate.merge(a, b, m, p)
    look(conflate.gray_ids(p, m))
    look(merged)
    assert sorted((r["o"], r["f"]) for r in merged.collect()) == [(1, 11), (2, 12)]
    assert len(plans) >= 5 and not [x for x in plans if "Broadcast" in x]
