"""Queries over shops, corridors, tiles, tags of feeds and registries, with DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions import score
from haulspark.operators import corridor, graph, presence, shops, tiles
from haulspark.plans.carriers import carrier, oracle, table
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


def _shops(spark, sf):
    b, k = carrier(spark, sf, "v_bridges"), F.col("nbi_id")
    phone = F.when(k % 3 == 0, F.concat(F.lit("+1 214 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 3 == 1, "911")
    return b.select(
        k.alias("shop_id"), F.when(k % 13 == 0, "Вакансии").otherwise(F.col("name")).alias("name"), F.when(k % 2 == 0, "TX").otherwise("OK").alias("state"), F.when(k % 5 == 0, F.lit(40.0)).otherwise(F.col("lat")).alias("lat"),
        F.when(k % 5 == 0, F.lit(-100.0)).otherwise(F.col("lon")).alias("lon"), phone.alias("phone"), (F.col("size") / 50.0).alias("src_confidence"), F.array(F.lit("Overture"), F.lit("meta")).alias("source_names"), (k % 4 == 0).alias("licence_verified"), (k % 8 == 0).alias("licence_expired"),
        F.when(k % 7 == 0, k.cast("string")).alias("osm_match_id"))


@query("shop_bands", """
    WITH s AS (SELECT nbi_id AS k, least(1.0::DOUBLE, size / 50.0::DOUBLE) AS conf, nbi_id % 3 = 0 AS ok, nbi_id % 3 = 0 AND nbi_id % 2 = 0 AS st, CASE WHEN nbi_id % 5 = 0 THEN -100.0::DOUBLE ELSE lon END AS lon, CASE WHEN nbi_id % 5 = 0 THEN 40.0::DOUBLE ELSE lat END AS lat,
        nbi_id % 13 = 0 AS spam, 1 + (CASE WHEN nbi_id % 4 = 0 AND nbi_id % 8 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN nbi_id % 7 = 0 THEN 1 ELSE 0 END) AS n FROM {v_bridges}),
    d AS (SELECT *, count(*) OVER (PARTITION BY round(lat, 5), round(lon, 5)) >= 3 AS dup FROM s),
    c AS (SELECT *, greatest(0, least(100, CAST(floor(conf * 40) AS INTEGER) + (CASE WHEN ok THEN 10 ELSE 0 END) + (CASE WHEN st THEN 15 ELSE 0 END) + (CASE WHEN NOT dup THEN 15 ELSE -15 END) + (CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 12 ELSE 20 END) - (CASE WHEN spam THEN 40 ELSE 0 END))) AS confidence FROM d)
    SELECT k AS shop_id, CAST(n AS INTEGER) AS n_independent, CAST(confidence AS INTEGER) AS confidence, CASE WHEN spam THEN 'unverified' WHEN confidence >= 70 AND ok AND NOT dup AND n >= 2 THEN 'verified' WHEN confidence >= 45 THEN 'probable' ELSE 'unverified' END AS status FROM c""")
def shop_bands(spark, sf):
    codes = F.broadcast(spark.createDataFrame([("214", "TX")], "area_code string, area_state string"))
    return shops.verify(_shops(spark, sf), codes).select("shop_id", "n_independent", "confidence", "status")


@query("licence_cascade", """
    WITH m AS (SELECT s.nbi_id AS shop_id, l.nbi_id AS licence_id, CASE WHEN s.nbi_id % 4 = l.nbi_id % 4 THEN 1 ELSE 2 END AS pri, l.nbi_id AS late FROM {v_bridges} s JOIN {v_bridges} l ON s.name = l.name AND (s.nbi_id % 4 = l.nbi_id % 4 OR s.nbi_id % 3 = l.nbi_id % 3))
    SELECT shop_id, licence_id, CASE pri WHEN 1 THEN 'name_zip' ELSE 'name_city' END AS rule FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY pri, late DESC) AS n FROM m) t WHERE n = 1""")
def licence_cascade(spark, sf):
    b, k = carrier(spark, sf, "v_bridges"), F.col("nbi_id")
    none = F.lit(None).cast("double")
    town = F.concat(F.lit("TOWN"), (k % 3).cast("string"))
    zip_ = F.concat(F.lit("7500"), (k % 4).cast("string"))
    s = b.select(k.alias("shop_id"), "name", F.lit("TX").alias("state"), none.alias("lat"), none.alias("lon"), zip_.alias("zip"), F.lower(town).alias("city"), F.lit(None).cast("string").alias("address"))
    li = b.select(k.alias("licence_id"), F.concat(F.upper("name"), F.lit(" INC.")).alias("name"), F.lit("TX").alias("state"), none.alias("lat"), none.alias("lon"), zip_.alias("zip"), town.alias("city"), F.lit(None).cast("string").alias("address"), F.date_add(F.lit("2020-01-01").cast("date"), k.cast("int")).alias("expiry"))
    return shops.join_licences(s, li, F.lit("2024-01-01").cast("date")).select("shop_id", "licence_id", "rule")


@query("map_match", "SELECT shop_id, osm_id, dist_m FROM (SELECT a.place_id AS shop_id, b.nbi_id AS osm_id, round(d, 1) AS dist_m, row_number() OVER (PARTITION BY a.place_id ORDER BY d, b.nbi_id) AS n FROM {v_places} a JOIN LATERAL (SELECT nbi_id, lon, lat, " + HAV.format(a="a", b="b") + " AS d FROM {v_bridges} b) b ON d <= 50000) t WHERE n = 1")
def map_match(spark, sf):
    m = shops.match_map(carrier(spark, sf, "v_places").withColumnRenamed("place_id", "shop_id"), carrier(spark, sf, "v_bridges").withColumnRenamed("nbi_id", "osm_id"), 50_000.0)
    return m.select("shop_id", "osm_id", F.round("dist_m", 1).alias("dist_m"))


def _path(spark, sf):
    """A straight road at 37 N in two edges."""
    rows = [(1, 1, [(-120.0, 37.0), (-100.0, 37.0)], 1000.0, 0.0, "I", "35"), (1, 2, [(-100.0, 37.0), (-80.0, 37.0)], 500.0, 1000.0, "U", "81")]
    return spark.createDataFrame(rows, "path_id int, seq int, line array<struct<lon:double,lat:double>>, length_m double, cum_m double, sign_type string, sign_num string")


ALONG = """p AS (SELECT nbi_id, facility, posting, size, CASE WHEN lon <= -100 THEN 1 ELSE 2 END AS seq, CASE WHEN lon <= -100 THEN (lon + 120) / 20 * 1000 ELSE 1000 + (lon + 100) / 20 * 500 END AS m_along,
      2*6371008.8::DOUBLE*asin(sqrt(pow(sin(radians(37 - lat)/2), 2))) AS offset_m FROM {v_bridges} WHERE lon BETWEEN -120 AND -80)"""


@query("corridor_features", f"WITH {ALONG} SELECT nbi_id, seq AS on_seq, round(m_along, 3) AS m_along, round(offset_m, 1) AS offset_m FROM p WHERE offset_m <= 30000")
def corridor_features(spark, sf):
    near = corridor.features_near(_path(spark, sf), carrier(spark, sf, "v_bridges").where("lon between -120 and -80").select("nbi_id", "lon", "lat"), 30_000.0, "nbi_id")
    return near.select("nbi_id", F.when(F.col("on_sign_num") == "35", 1).otherwise(2).alias("on_seq"), F.round("m_along", 3).alias("m_along"), F.round("offset_m", 1).alias("offset_m"))


@query("corridor_restrictions", f"""
    WITH {ALONG}, c AS (SELECT *, CASE WHEN facility IS NULL THEN NULL ELSE facility = CASE WHEN seq = 1 THEN 'I-35 SB' ELSE 'US 81' END END AS on_it, CASE WHEN size % 3 <> 0 THEN round((3 + (size % 10) / 10.0::DOUBLE) * 39.3700787::DOUBLE, 1) END AS over, round((3 + (size % 7) / 10.0::DOUBLE) * 39.3700787::DOUBLE, 1) AS under FROM p WHERE offset_m <= 30000),
    d AS (SELECT *, CASE WHEN on_it THEN over WHEN NOT on_it THEN under ELSE least(over, under) END AS clear FROM c)
    SELECT nbi_id, clear AS clearance_in, CAST((CASE WHEN clear < 140 THEN 1 ELSE 0 END) + (CASE WHEN posting IN ('P', 'K') AND on_it IS NOT FALSE THEN 1 ELSE 0 END) AS INTEGER) AS n_reasons FROM d""")
def corridor_restrictions(spark, sf):
    s = F.col("size")
    m = lambda n: (3 + (s % n) / 10.0).cast("string")
    b = carrier(spark, sf, "v_bridges").where("lon between -120 and -80").select("nbi_id", "lon", "lat", "facility", "posting", F.when(s % 3 != 0, m(10)).otherwise("99.99").alias("over10"), F.lit(None).cast("string").alias("over53"), m(7).alias("under54"))
    r = corridor.bridge_restrictions(corridor.features_near(_path(spark, sf), b, 30_000.0, "nbi_id"), 140.0)
    return r.select("nbi_id", "clearance_in", F.size("reasons").alias("n_reasons"))


@query("fuel_details", """
    WITH w AS (SELECT region, max_by(price, week_of) AS weekly_price FROM {v_prices} GROUP BY region), d AS (SELECT region AS state, max_by(price, week_of) * 2 AS daily_price FROM {v_prices} WHERE region <> 'NATION_3' GROUP BY region)
    SELECT place_id AS osm_id, p.state, weekly_price, daily_price FROM {v_places} p LEFT JOIN w ON w.region = p.state LEFT JOIN d ON d.state = p.state""")
def fuel_details(spark, sf):
    p, w = carrier(spark, sf, "v_places"), carrier(spark, sf, "v_prices")
    near = p.select(F.col("place_id").alias("osm_id"))
    states = p.select(F.col("place_id").alias("osm_id"), "state")
    daily = w.where("region <> 'NATION_3'").select(F.col("region").alias("state"), F.col("week_of").alias("observed_on"), (F.col("price") * 2).alias("price"))
    return corridor.fuel_details(near, states, w, daily, F.col("state")).select("osm_id", "state", "weekly_price", "daily_price")


@query("path_rollup", """
    WITH e AS (SELECT edge_id % 3 AS path_id, edge_id, length_m, edge_id % 5 = 0 AS c FROM {v_edges})
    SELECT CAST(path_id AS BIGINT) AS path_id, sum(length_m) AS length_m, count(*) FILTER (WHERE c) AS connectors, coalesce(sum(length_m) FILTER (WHERE c), 0) AS connector_m FROM e GROUP BY path_id""")
def path_rollup(spark, sf):
    k = F.col("edge_id")
    e = carrier(spark, sf, "v_edges").select((k % 3).alias("path_id"), "edge_id", "length_m", F.when(k % 5 == 0, "connector").otherwise("truck_route").alias("kind"), F.lit("I").alias("sign_type"), (k % 4).cast("string").alias("sign_num"), F.lit("TX").alias("state"), F.lit(0).alias("structures_unknown_clearance"))
    return corridor.path_rollup(e).select("path_id", "length_m", "connectors", "connector_m")


@query("snap_pairs", """
    WITH o AS (SELECT edge_id % 5 AS pair_id, u AS node, length_m AS a, u % 2 AS c FROM {v_edges}), g AS (SELECT edge_id % 5 AS pair_id, v AS node, length_m AS a, v % 2 AS c FROM {v_edges}),
    j AS (SELECT o.pair_id, o.a + g.a AS access_m, o.node AS origin, g.node AS goal, row_number() OVER (PARTITION BY o.pair_id ORDER BY o.a + g.a, o.node, g.node) AS n FROM o JOIN g ON o.pair_id = g.pair_id AND o.c = g.c)
    SELECT pair_id, access_m, origin, goal FROM j WHERE n = 1""")
def snap_pairs(spark, sf):
    e = carrier(spark, sf, "v_edges")
    side = lambda c: e.select((F.col("edge_id") % 5).alias("pair_id"), F.col(c).alias("node"), F.col("length_m").alias("access_m"), (F.col(c) % 2).alias("component"))
    return graph.snap_pairs(side("u"), side("v")).select("pair_id", "access_m", "origin", "goal")


@query("connectors", """
    WITH d AS (SELECT place_id, lon, lat FROM {v_places} WHERE place_id % 4 = 0), j AS (SELECT d.place_id AS a, b.place_id AS b, """ + HAV.format(a="d", b="b") + """ AS m FROM d JOIN {v_places} b ON d.place_id <> b.place_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m, b) AS n FROM j WHERE m <= 300000) SELECT least(a, b) AS u, greatest(a, b) AS v, round(min(m), 1) AS length_m FROM r WHERE n = 1 GROUP BY least(a, b), greatest(a, b)""")
def connectors(spark, sf):
    p = carrier(spark, sf, "v_places").select(F.col("place_id").alias("node_id"), "lon", "lat", F.when(F.col("place_id") % 4 == 0, 1).otherwise(2).alias("degree"))
    return graph.connectors(p, 300_000.0).select("u", "v", F.round("length_m", 1).alias("length_m"))


@query("graph_edges", """
    WITH l AS (SELECT edge_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v),
    p AS (SELECT row_number() OVER (ORDER BY lon, lat) AS node_id, lon, lat FROM (SELECT x0 AS lon, y0 AS lat FROM l UNION SELECT x1, y1 FROM l) t)
    SELECT edge_id, a.node_id AS u, b.node_id AS v FROM l JOIN p a ON a.lon = x0 AND a.lat = y0 JOIN p b ON b.lon = x1 AND b.lat = y1""")
def graph_edges(spark, sf):
    lines = _graph_lines(spark, sf)
    e = graph.build_edges(lines, graph.build_nodes(lines))
    return e.select("edge_id", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))


@query("chain_witness", "SELECT place_id, brand, dist_m FROM (SELECT a.place_id, b.brand, round(d, 1) AS dist_m, row_number() OVER (PARTITION BY a.place_id ORDER BY d, b.nbi_id) AS n FROM {v_places} a JOIN LATERAL (SELECT nbi_id, brand, lon, lat, " + HAV.format(a="a", b="b") + " AS d FROM {v_bridges} b) b ON d <= 70000) t WHERE n = 1")
def chain_witness(spark, sf):
    chain = carrier(spark, sf, "v_bridges").select(F.col("nbi_id").alias("site_id"), "lon", "lat", "brand")
    return presence.chain_witness(carrier(spark, sf, "v_places").select("place_id", "lon", "lat"), chain, 70_000.0).select("place_id", "brand", F.round("dist_m", 1).alias("dist_m"))


@query("table_liveness", """
    WITH l AS (SELECT place_id, CASE WHEN place_id % 3 = 0 THEN 0 ELSE 1 + place_id % 2 END AS n, place_id % 4 = 0 AND place_id % 3 <> 0 AS miss FROM {v_places})
    SELECT place_id, CAST(floor(100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * (CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) + 0.3::DOUBLE * (CASE n - miss::INT WHEN 0 THEN 0.0::DOUBLE WHEN -1 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END) - (CASE WHEN miss THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END))) + 0.5::DOUBLE) AS INTEGER) AS liveness,
      array_to_string(list_concat(CASE WHEN miss THEN ['vanished_from_source'] ELSE [] END, CASE WHEN n = 0 THEN ['never_confirmed'] ELSE [] END), ',') AS reasons FROM l""")
def table_liveness(spark, sf):
    p, k = carrier(spark, sf, "v_places"), F.col("place_id")
    sources = F.when(k % 3 != 0, F.when(k % 2 == 1, F.array(F.lit("fsq"), F.lit("osm"))).otherwise(F.array(F.lit("fsq"))))
    seen = (now() - F.expr("INTERVAL 100 DAYS")).cast("timestamp")
    ledger = p.select(k.cast("string").alias("entity_id"), F.explode(sources).alias("source_id"), seen.alias("last_seen_at"), F.when((k % 4 == 0), seen).alias("missing_since"))
    ledger = ledger.withColumn("missing_since", F.when(F.col("source_id") == "fsq", F.col("missing_since")))
    out = presence.rescore_liveness(p.select("place_id"), ledger, None, now(), 100.0)
    return out.select("place_id", "liveness", F.array_join("reasons", ",").alias("reasons"))


@query("point_tiles", """
    WITH m AS (SELECT 6378137.0::DOUBLE * radians(lon) AS x, 6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2)) AS y FROM {v_bridges})
    SELECT CAST(floor((x + 20037508.342789244::DOUBLE) / 40075016.685578488::DOUBLE * 32) AS INTEGER) AS x, CAST(floor((20037508.342789244::DOUBLE - y) / 40075016.685578488::DOUBLE * 32) AS INTEGER) AS y, least(count(*), 100) AS n FROM m GROUP BY 1, 2""")
def point_tiles(spark, sf):
    return tiles.point_tiles(carrier(spark, sf, "v_bridges"), tiles.Layer("bridges", cap=100, importance="clearance_in"), 5, ["nbi_id", "clearance_in"], "nbi_id").select("x", "y", "n")


@query("corridor_generalize", """
    WITH l AS (SELECT edge_id % 4 AS route FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v)
    SELECT route, count(*) AS segments, 2 * count(*) AS points_before, true AS thinner FROM l GROUP BY route""")
def corridor_generalize(spark, sf):
    lines = _graph_lines(spark, sf).withColumn("route", F.col("edge_id") % 4)
    return tiles.generalize(lines, ["route"], 0.002).select("route", "segments", "points_before", (F.col("points_after") <= F.col("points_before")).alias("thinner"))


@query("node_lines", """
    WITH l AS (SELECT edge_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v),
    n AS (SELECT x0 AS lon, y0 AS lat FROM l UNION SELECT x1, y1 FROM l),
    d AS (SELECT edge_id, lon, lat, ((lon - x0) * (x1 - x0) + (lat - y0) * (y1 - y0)) / nullif(pow(x1 - x0, 2) + pow(y1 - y0, 2), 0) AS t, abs((lon - x0) * (y1 - y0) - (lat - y0) * (x1 - x0)) / nullif(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 0) AS off FROM l, n),
    c AS (SELECT l.edge_id, count(lon) AS k FROM l LEFT JOIN d ON d.edge_id = l.edge_id AND off <= 0.00001 AND t > 0.000001 AND t < 0.999999 GROUP BY l.edge_id)
    SELECT edge_id, unnest(range(1, k + 2)) AS piece FROM c""")
def node_lines(spark, sf):
    lines = _graph_lines(spark, sf)
    return graph.node_lines(lines, graph.build_nodes(lines)).select("edge_id", "piece")


@query("verified_share", "SELECT count(*) AS n, count(*) FILTER (WHERE size > 25) AS fresh, round(avg(CASE WHEN clearance_in IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share FROM {v_bridges}")
def verified_share(spark, sf):
    return carrier(spark, sf, "v_bridges").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") > 25).alias("fresh"), F.round(F.avg(F.when(F.col("clearance_in").isNotNull(), 1.0).otherwise(0.0)), 9).alias("share"))


@query("org_names", "SELECT nbi_id, CASE nbi_id % 5 WHEN 0 THEN 'overture' WHEN 1 THEN 'microsoft' WHEN 2 THEN 'meta' WHEN 3 THEN 'microsoft' ELSE lower(brand) END AS org FROM {v_bridges}")
def org_names(spark, sf):
    """The organisation behind each row's feed, which is named in several ways."""
    k = F.col("nbi_id") % 5
    feed = F.when(k == 0, "Overture-signals").when(k == 1, "MSFT").when(k == 2, " Facebook").when(k == 3, "bing maps").otherwise(F.col("brand"))
    return carrier(spark, sf, "v_bridges").select("nbi_id", score.organisation(feed).alias("org"))


@query("cadence_contradictions", """
    WITH s AS (SELECT event_type AS source_id, 60 * (1 + length(event_type)) AS schedule_minutes, length(event_type) AS slo_hours FROM {events} GROUP BY event_type) SELECT source_id, schedule_minutes > slo_hours * 60 AS contradicts FROM s""")
def cadence_contradictions(spark, sf):
    s = table(spark, sf, "events").select(F.col("event_type").alias("source_id")).distinct()
    n = F.length("source_id")
    return s.select("source_id", (60 * (1 + n) > n * 60).alias("contradicts"))


@query("graph_staleness", """
    SELECT a.source_id, max(a.started_at) > (SELECT max(started_at) FROM {v_runs} WHERE source_id = 'click' AND status = 'success') AS stale FROM {v_runs} a WHERE a.status = 'success' GROUP BY a.source_id""")
def graph_staleness(spark, sf):
    ok = carrier(spark, sf, "v_runs").where("status = 'success'").groupBy("source_id").agg(F.max("started_at").alias("t"))
    built = ok.where("source_id = 'click'").select(F.col("t").alias("built"))  # one row
    return ok.join(F.broadcast(built)).select("source_id", (F.col("t") > F.col("built")).alias("stale"))
