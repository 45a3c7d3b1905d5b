import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulspark.functions import geo, score, tags, text, units


def run(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    return [r["v"] for r in df.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


LENGTHS = {
    "13'6\"": 162.0, "14'": 168.0, "13 ft": 156.0, "13ft6in": 162.0, "6' 6\"": 78.0, "12'0\"": 144.0, "4.1": 161.4, "4,1": 161.4, "4.1 m": 161.4, "420 cm": 165.4,
    '78"': 78.0, "78 inches": 78.0, "4;5": None, "0": None, "none": None, "default": None, "": None, "4..1": None, "-3": None, "9999999": None, "1,2,3": None,
}
WEIGHTS = {
    "15": 33069.0, "15 t": 33069.0, "3500 kg": 7716.0, "26,000 lbs": 26000.0, "26000 lb": 26000.0, "10 st": 20000.0, "3 lt": 6720.0, "15 bananas": None, "0": None, "": None,
    "2 tonnes": 4409.0, "1 mt": 2205.0, "junk": None,
}


def test_lengths(spark):
    assert run(spark, units.length_in, LENGTHS) == list(LENGTHS.values())


def test_weights(spark):
    assert run(spark, units.weight_lb, WEIGHTS) == list(WEIGHTS.values())


def test_clearances(spark):
    got = run(spark, units.clearance_in, ["4.11", "99.99", "0", "", "junk", None])
    assert got[0] == pytest.approx(161.8, abs=0.2) and got[1:] == [None] * 5


def test_feet_inches(spark):
    assert run(spark, units.feet_inches, [162.0, 0.0, 13.5, None], "double") == ["13'6\"", "0'0\"", "1'2\"", "unknown"]


def test_names(spark):
    assert run(spark, text.squeeze, ["Love's Travel Stop #291", None]) == ["lovestravelstop291", ""]
    assert run(spark, text.norm_name, ["Love's Travel Stop #291", "PILOT TVL CTR", None]) == ["love s travel stop", "pilot travel center", ""]
    assert run(spark, text.company_key, ["A-1 All & German Car Corp", "The Company", "!!", None]) == ["A1ALLGERMANCAR", None, None, None]
    assert run(spark, text.address_key, ["12 North Main Street Ste 4", "5th Avenue", "PO Box 9", None]) == ["12NMAINST", "5AVE", None, None]


def test_trigrams(spark):
    sim = lambda a, b: spark.range(1).select(text.trigram_similarity(F.lit(a), F.lit(b)).alias("v")).first()["v"]
    assert sim("word", "two words") == pytest.approx(4 / 11)
    assert sim("two words", "words two") == 1.0
    assert sim("", "x") == 0.0


def test_phones(spark):
    assert run(spark, lambda c: text.is_nanp(text.phone10(c)), ["+1 (214) 555-0100", "911-555-0100", "114 555 0100", "555", None]) == [True, False, False, False, False]


@pytest.mark.parametrize(
    ("facility", "want"),
    [("I-35 SB", True), ("IH 35", True), ("INTERSTATE 35", True), ("I-355", False), ("I3512", False), ("I35", True), ("CO. RD. E2130", False), ("US 81", False), ("", None), (None, None), ("I-35E", True), ("RAMP I-35", False)],
)
def test_carries_route(spark, facility, want):
    got = spark.range(1).select(text.carries_route(F.lit(facility).cast("string"), F.lit("I"), F.lit("35")).alias("v")).first()["v"]
    assert got is want


def test_geohash(spark):
    assert spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("v")).first()["v"] == "u4pruydqqvj"


def test_wkt_and_lines(spark):
    pts = run(spark, geo.wkt_points, ["POINT (1 2)", "LINESTRING Z (1 2 3, 4 5 6)", "MULTIPOLYGON (((1 2, 3 4)))", "POINT EMPTY", "junk", "POINT (a b)", None])
    assert [None if p is None else len(p) for p in pts] == [1, 2, 2, None, None, None, None]


def test_tag_flags(spark):
    rows = [{"amenity": "fuel", "highway": "services", "shop": "truck_repair"}, {"man_made": "weighbridge"}, {"highway": "rest_area", "fuel:HGV_diesel": "yes"}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t map<string,string>").orderBy("i")
    got = df.select(tags.kinds(F.col("t")).alias("k"), tags.has_diesel(F.col("t")).alias("d")).collect()
    assert [r["k"] for r in got] == [["fuel", "truck_repair"], ["weigh"], ["rest"], []]
    assert [r["d"] for r in got] == [None, None, True, None]


def test_confidence(spark):
    def conf(t, f, c, a, geo=False, n=0):
        s = score.confidence(F.lit(t), F.lit(f), F.lit(c), F.lit(a), F.lit(geo), F.lit(n))
        return spark.range(1).select(s.alias("s")).first()["s"]["confidence"]

    assert conf(0.95, 0.88, 1.0, 1.0) == 95
    assert conf(0.55, 0.68, 0.6, 0.5) == 58
    assert conf(0.95, 0.88, 1.0, 0.0, n=1) == 65
    assert conf(1.0, 1.0, 1.0, 0.0, n=5) == 60
    assert conf(1.0, 1.0, 1.0, 0.0, geo=True, n=3) == 45
    assert conf(0.0, 0.0, 0.0, 0.0, geo=True) == 0 and conf(1.0, 1.0, 1.0, 1.0) == 100
    assert run(spark, units.percent, [0.125], "double") == [13]


def test_decay(spark):
    now = F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    df = spark.range(1).select(*[score.decay(at(s), now, 10.0).alias(f"c{i}") for i, s in enumerate(["2024-01-01 00:00:00", "2025-01-01 00:00:00", None])])
    assert list(df.first()) == [0.5, 1.0, 0.0]


def test_liveness(spark):
    def live(p, s, a, missing=False, expired=False, closed=False):
        x = score.liveness(F.lit(p), F.lit(s), F.lit(a), F.lit(missing), F.lit(expired), F.lit(closed))
        r = spark.range(1).select(x.alias("s")).first()["s"]
        return r["liveness"], r["live_state"]

    assert live(1.0, 0.8, 1.0) == (94, "open")
    assert live(1.0, 0.5, 0.0) == (65, "likely_open")
    assert live(1.0, 1.0, 1.0, closed=True) == (0, "closed")
    assert live(0.0, 0.0, 0.0)[1] == "likely_closed"


def test_dates_are_strict(spark):
    assert run(spark, lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")), ["2024-02-30", "2024-02-28", "x", None]) == [None, dt.date(2024, 2, 28), None, None]


def test_spheroid(one):
    from haulspark.functions.geo import spheroid_m

    at = lambda *p: one(spheroid_m(*[F.col(n) for n in "abcd"]), **dict(zip("abcd", p, strict=True)))
    assert at(-100.0, 40.0, -100.0, 40.0) == 0
    assert at(0.0, 0.0, 1.0, 0.0) == pytest.approx(111_319.49, abs=0.1)  # a degree of the equator
    assert at(0.0, 45.0, 0.0, 46.0) == pytest.approx(111_141.5, abs=2)  # a degree of the meridian
    assert at(-96.8, 32.78, -97.52, 35.47) == pytest.approx(305_800, rel=5e-3)
