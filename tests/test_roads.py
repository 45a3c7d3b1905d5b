import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulspark.operators import corridor, shops, tiles

LINE = "array<struct<lon:double,lat:double>>"


def test_features_along_a_path(spark):
    path = spark.createDataFrame([(1, 1, [(-100.0, 40.0), (-99.0, 40.0)], 85_000.0, 0.0, "I", "35"), (1, 2, [(-99.0, 40.0), (-99.0, 41.0)], 111_000.0, 85_000.0, "U", "81")], f"path_id int, seq int, line {LINE}, length_m double, cum_m double, sign_type string, sign_num string")
    f = spark.createDataFrame([(1, -99.5, 40.0001), (2, -99.0, 40.5), (3, -98.0, 40.5), (4, None, None), (5, -99.0, 40.0)], "fid int, lon double, lat double")
    got = {r["fid"]: r for r in corridor.features_near(path, f, 500.0, "fid").collect()}
    assert set(got) == {1, 2, 5}
    assert got[1]["m_along"] == pytest.approx(42_500, abs=1) and got[1]["offset_m"] == pytest.approx(11.1, abs=0.1) and got[1]["on_sign_num"] == "35"
    assert got[2]["m_along"] == pytest.approx(85_000 + 55_500, abs=1) and got[5]["m_along"] == pytest.approx(85_000, abs=1)


def test_restrictions(spark):
    cols = "i int, facility string, over10 string, over53 string, under54 string, posting string, on_sign_type string, on_sign_num string"
    rows = [(1, "I-35 SB", "4.0", "99.99", "3.0", "K", "I", "35"), (2, "CR 7", "4.0", None, "3.0", "P", "I", "35"), (3, None, "4.0", None, "3.0", "P", "I", "35"), (4, "I-35", "99.99", None, None, "A", "I", "35")]
    got = {r["i"]: r for r in corridor.bridge_restrictions(spark.createDataFrame(rows, cols), 162.0).collect()}
    assert got[1]["clearance_in"] == 157.5 and len(got[1]["reasons"]) == 2 and got[1]["relation"] == "you drive over it"
    assert got[2]["clearance_in"] == 118.1 and got[2]["reasons"] == ["9'10\" recorded beneath this structure"]
    assert got[3]["clearance_in"] == 118.1 and len(got[3]["reasons"]) == 2
    assert got[4]["clearance_in"] is None and got[4]["reasons"] == [] and got[4]["clearance_text"] == "unknown"
    t = spark.createDataFrame([(150.0, True, ["L10=1"]), (None, None, None)], "clearance_in double, hazmat_restricted boolean, hazmat_codes array<string>")
    assert [len(r["reasons"]) for r in corridor.tunnel_restrictions(t, 162.0).collect()] == [2, 0]


def test_shop_bands(spark):
    cols = "shop_id int, name string, state string, lat double, lon double, phone string, src_confidence double, source_names array<string>, licence_verified boolean, licence_expired boolean, osm_match_id string"
    rows = [
        (1, "Good Shop", "TX", 32.0, -97.0, "+1 214-555-0100", 0.9, ["meta"], True, False, "n/1"), (2, "Вакансии", "TX", 33.0, -97.0, None, 0.9, ["meta"], None, None, None),
        (3, "A", "TX", 34.0, -97.0, "911", 0.5, ["Overture"], None, None, None), (4, "B", "TX", 34.0, -97.0, None, 0.5, [], True, True, None), (5, "C", "OK", 34.0, -97.0, "2145550100", None, None, None, None, None), (6, None, "TX", None, None, None, None, None, None, None, None),
    ]
    got = {r["shop_id"]: r for r in shops.verify(spark.createDataFrame(rows, cols), spark.createDataFrame([("214", "TX")], "area_code string, area_state string")).collect()}
    assert got[1]["status"] == "verified" and got[1]["n_independent"] == 3 and got[1]["flags"] == ["state_licensed", "osm_corroborated"]
    assert got[2]["status"] == "unverified" and "name_nonlatin_or_blank" in got[2]["flags"]
    assert got[3]["cluster_dup"] and "phone_malformed" in got[3]["flags"] and got[3]["n_independent"] == 0
    assert "licence_expired" in got[4]["flags"] and "phone_state_mismatch" in got[5]["flags"] and got[6]["confidence"] == 0


def test_licence_cascade(spark):
    s = spark.createDataFrame([(1, "Joe & Sons Inc", "TX", 32.0, -97.0, "75001-1", "Dallas", "1 Main St"), (2, "Trading Name", "TX", 32.5, -97.0, "75002", "Plano", "5 North Oak Avenue, Ste 2"), (3, "Near Matching", "TX", 33.0, -97.0, None, None, None), (4, "None", "TX", 34.0, -97.0, "1", "x", None)], "shop_id int, name string, state string, lat double, lon double, zip string, city string, address string")
    d = dt.date
    li = spark.createDataFrame([("a", "JOE AND SONS", "TX", None, None, "75001", "DALLAS", None, d(2020, 1, 1)), ("b", "Joe Sons", "TX", None, None, "75001", "X", None, d(2030, 1, 1)), ("c", "Legal LLC", "TX", None, None, "75002", None, "5 N Oak Ave", None), ("d", "Near Matching Two", "TX", 33.0005, -97.0, None, None, None, d(2019, 1, 1))], "licence_id string, name string, state string, lat double, lon double, zip string, city string, address string, expiry date")
    got = {r["shop_id"]: (r["licence_id"], r["rule"], r["expired"]) for r in shops.join_licences(s, li, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {1: ("b", "name_zip", False), 2: ("c", "addr_zip", False), 3: ("d", "geo_name", True)}


def read_tile(data):
    def varint(b, i):
        n = s = 0
        while True:
            n |= (b[i] & 0x7F) << s
            s += 7
            i += 1
            if not b[i - 1] & 0x80:
                return n, i

    def fields(b):
        i = 0
        while i < len(b):
            k, i = varint(b, i)
            if k & 7 == 0:
                v, i = varint(b, i)
            elif k & 7 == 1:
                v, i = b[i : i + 8], i + 8
            else:
                n, i = varint(b, i)
                v, i = b[i : i + n], i + n
            yield k >> 3, v

    layer = dict(fields(data))[3]
    return [v for k, v in fields(layer) if k == 2], [v for k, v in fields(layer) if k == 3]


def test_tiles(spark):
    pts = spark.createDataFrame([(i, -100.0 + i * 0.01, 40.0, None if i % 3 else i) for i in range(50)] + [(99, None, None, 1)], "id int, lon double, lat double, rank int")
    out = tiles.point_tiles(pts, tiles.Layer("pts", cap=10, importance="rank"), 8, ["rank", "id"], "id").collect()
    assert all(r["n"] <= 10 and len(read_tile(bytes(r["tile"]))[0]) == r["n"] for r in out)
    whole = tiles.point_tiles(pts, tiles.Layer("pts", clustered_below=9), 8, ["rank"], "id").collect()
    assert sum(r["n"] for r in whole) < 50 and read_tile(bytes(whole[0]["tile"]))[1] == [b"point_count"]
    t = pts.where("lon is not null").select(F.col("id"), tiles.tile_of(F.col("lon"), F.col("lat"), 8).alias("t")).first()["t"]
    assert tiles.in_tile(pts, 8, t["x"], t["y"]).count() > 0


def test_corridors(spark):
    seg = spark.createDataFrame([("I35", 1, [(0.0, 0.0), (0.5, 0.0001), (1.0, 0.0)]), ("I35", 2, [(2.0, 0.0), (1.0, 0.0)]), ("I35", 3, [(5.0, 5.0), (6.0, 6.0)]), ("US1", 4, [(0.0, 0.0), (0.0, 1.0)])], f"route string, edge_id int, line {LINE}")
    got = {r["route"]: r for r in tiles.generalize(seg, ["route"]).collect()}
    assert (got["I35"]["segments"], got["I35"]["points_before"], got["I35"]["points_after"], len(got["I35"]["lines"])) == (3, 7, 4, 2)
    assert tiles.simplify([(0, 0), (1, 1), (2, 0), (0, 0)], 0.1) == [(0, 0), (1, 1), (2, 0), (0, 0)]
