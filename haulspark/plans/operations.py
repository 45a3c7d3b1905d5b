"""Queries over live events, alerts, digests, devices, feeds and what conflation has to hold, with DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.functions import geo, text
from haulspark.operators import conflate, corridor, fulltext, live, ops, shops, viewer
from haulspark.plans.carriers import carrier, oracle, table
from haulspark.plans.domain import NOW, _pairs, now
from haulspark.plans.roads import ALONG, _path
from haulspark.sources import feeds
from haulspark.streaming import devices, tracking

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


# ---- live events -------------------------------------------------------------------------------------------


def _events(spark, sf):
    b, k = carrier(spark, sf, "v_bridges"), F.col("nbi_id")
    side = lambda c, d: F.when(k % 4 != 0, F.col(c) + d)  # noqa: E731  every fourth alert has no geometry
    return b.select(k.alias("event_id"), F.when(k % 3 == 0, "work_zone").otherwise("weather_alert").alias("kind"), F.when(k % 5 == 0, now()).alias("soft_closed_at"), side("lon", -0.5).alias("xmin"), side("lat", -0.5).alias("ymin"), side("lon", 0.5).alias("xmax"), side("lat", 0.5).alias("ymax"))


BOX = "lon - 0.5::DOUBLE <= -95 AND lon + 0.5::DOUBLE >= -105 AND lat - 0.5::DOUBLE <= 40 AND lat + 0.5::DOUBLE >= 30"
OPEN = "FROM {v_bridges} WHERE nbi_id % 3 <> 0 AND nbi_id % 5 <> 0"


@query("alerts_in_box", f"SELECT nbi_id AS event_id {OPEN} AND nbi_id % 4 <> 0 AND {BOX}")
def alerts_in_box(spark, sf):
    return live.alerts_in_box(_events(spark, sf), (-105.0, 30.0, -95.0, 40.0)).select("event_id")


@query("alerts_with_zones", f"SELECT nbi_id AS event_id {OPEN} AND (nbi_id % 4 = 0 OR {BOX})")
def alerts_with_zones(spark, sf):
    return live.alerts_in_box(_events(spark, sf), (-105.0, 30.0, -95.0, 40.0), include_nongeo=True).select("event_id")


@query("alert_zones", """
    SELECT nbi_id, CASE nbi_id % 4 WHEN 0 THEN 'TXZ' || CAST(size AS VARCHAR) || ',A' WHEN 1 THEN 'OKC001' WHEN 2 THEN 'https://zones/' || CAST(nbi_id AS VARCHAR) ELSE '' END AS zones FROM {v_bridges}""")
def alert_zones(spark, sf):
    k, n = F.col("nbi_id"), F.col("size").cast("string")
    props = (
        F.when(k % 4 == 0, F.concat(F.lit('{"zones": ["TXZ'), n, F.lit('", "A"], "geocode": {"UGC": ["no"]}}'))).when(k % 4 == 1, F.lit('{"zones": [], "geocode": {"UGC": ["OKC001"]}, "affectedZones": ["no"]}'))
        .when(k % 4 == 2, F.concat(F.lit('{"affectedZones": ["https://zones/'), k.cast("string"), F.lit('"]}'))).otherwise(F.lit('{"headline": "none"}'))
    )
    return carrier(spark, sf, "v_bridges").select("nbi_id", F.array_join(live.zones(props), ",").alias("zones"))


# ---- shops -------------------------------------------------------------------------------------------------


@query("coverage_verdict", """
    WITH c AS (SELECT state, count(*) AS shops FROM {v_places} GROUP BY state), e AS (SELECT n_name AS state, count(*) AS estabs FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name),
    m AS (SELECT state, sum(length_m) * 10 AS miles FROM {v_edges} JOIN {v_places} ON place_id = u GROUP BY state),
    j AS (SELECT state, coalesce(shops, 0) AS shops, coalesce(estabs, 0) AS estabs, coalesce(miles, 0) AS miles FROM c FULL JOIN e USING (state) FULL JOIN m USING (state)), g AS (SELECT sum(shops)::DOUBLE / sum(estabs) AS national FROM j)
    SELECT state, CAST(shops AS BIGINT) AS shops, CASE WHEN shops::DOUBLE / nullif(estabs, 0) < national / 2 THEN 'thin_data' WHEN miles / nullif(shops, 0) >= 40 THEN 'real_scarcity' WHEN shops > 0 THEN 'covered' END AS verdict FROM j, g""")
def coverage_verdict(spark, sf):
    places = carrier(spark, sf, "v_places")
    estabs = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    miles = carrier(spark, sf, "v_edges").join(places.select(F.col("place_id").alias("u"), "state"), "u").groupBy("state").agg((F.sum("length_m") * 10).alias("miles"))
    return shops.coverage(places, estabs, miles).select("state", "shops", "verdict")


def _repair(spark, sf):
    b, k = carrier(spark, sf, "v_bridges"), F.col("nbi_id")
    return b.select(k.alias("business_id"), "name", F.when(k % 3 == 0, "towing").when(k % 3 == 1, "truck_repair").otherwise("hotel").alias("category"), "lon", "lat")


@query("mechanics_fallback", """
    WITH p AS (SELECT nbi_id, 2*6371008.8::DOUBLE*asin(sqrt(pow(sin(radians(37 - lat)/2), 2) + cos(radians(lat))*cos(radians(37))*pow(sin(radians(greatest(-120, least(-80, lon)) - lon)/2), 2))) AS offset_m FROM {v_bridges})
    SELECT nbi_id AS id, 'businesses (fallback)' AS source, round(offset_m, 1) AS offset_m FROM p WHERE offset_m <= 30000 AND nbi_id % 3 <> 2""")
def mechanics_fallback(spark, sf):
    own = _repair(spark, sf)
    none = own.where("false").select(F.col("business_id").alias("shop_id"), "name", "category", "lon", "lat", F.lit("x").alias("verification_status"), F.lit(1).alias("confidence"))
    return corridor.mechanics(_path(spark, sf), none, own, 30_000.0).select("id", "source", F.round("offset_m", 1).alias("offset_m"))


@query("conflation_workload", """
    WITH x AS (SELECT count(*) AS n FROM {v_src_a}), y AS (SELECT count(*) AS n FROM {v_src_b}) SELECT x.n AS rows_a, y.n AS rows_b, 'run_as_is' AS verdict FROM x, y""")
def conflation_workload(spark, sf):
    return conflate.workload(carrier(spark, sf, "v_src_a"), carrier(spark, sf, "v_src_b"), _pairs(spark, sf)).select("rows_a", "rows_b", "verdict")


# ---- operations --------------------------------------------------------------------------------------------

RUNS = "(SELECT *, CASE WHEN run_id % 97 = 0 THEN 'running' ELSE status END AS st FROM {v_runs})"


def _runs(spark, sf):
    r = carrier(spark, sf, "v_runs")
    return r.withColumn("status", F.when(F.col("run_id") % 97 == 0, "running").otherwise(F.col("status"))).withColumn("message", F.concat(F.lit("run "), F.col("run_id").cast("string")))


def _sources(spark, sf):
    return carrier(spark, sf, "v_runs").select("source_id").distinct().select("source_id", (F.col("source_id") != "click").alias("enabled"), F.lit(12).alias("slo_hours"))


@query("ops_alerts", f"""
    WITH r AS {RUNS}, q AS (SELECT nbi_id AS job_id, brand AS source_id, TIMESTAMP '2024-02-01 00:00:00' - to_hours(CAST(size AS INTEGER)) AS since, CASE WHEN nbi_id % 2 = 0 THEN 'deferred: disk' ELSE NULL END AS message FROM {{v_bridges}} WHERE nbi_id % 5 = 0),
    l AS (SELECT *, 'run ' || CAST(run_id AS VARCHAR) AS message FROM r)
    SELECT 'failing/' || source_id AS key, count(*) AS n, arg_max(message, struct_pack(a := started_at, b := run_id)) AS said FROM l WHERE st = 'failed' AND started_at > {NOW} - INTERVAL 720 HOURS GROUP BY source_id HAVING count(*) >= 3
    UNION ALL SELECT 'selfcheck/' || source_id, arg_max(run_id, struct_pack(a := started_at, b := run_id)), arg_max(message, struct_pack(a := started_at, b := run_id)) FROM l WHERE st = 'failed' AND source_id = 'error' AND started_at > {NOW} - INTERVAL 700 HOURS GROUP BY source_id
    UNION ALL SELECT 'never-ok/' || source_id, count(*), NULL FROM l GROUP BY source_id HAVING count(*) FILTER (WHERE st = 'success') = 0 AND count(*) >= 3
    UNION ALL SELECT 'stuck/' || CAST(run_id AS VARCHAR), CAST(floor((epoch_us({NOW}) - epoch_us(started_at)) / 3600000000) AS BIGINT), NULL FROM l WHERE st = 'running' AND started_at < {NOW} - INTERVAL 6 HOURS
    UNION ALL SELECT 'disarmed/' || source_id, 1, NULL FROM l WHERE source_id = 'click' GROUP BY source_id HAVING max(started_at) > {NOW} - INTERVAL 168 HOURS
    UNION ALL SELECT 'backlog/queue', count(*), NULL FROM q WHERE since < {NOW} - INTERVAL 6 HOURS HAVING count(*) > 0
    UNION ALL SELECT 'deferred/' || source_id, CAST(floor((epoch_us({NOW}) - epoch_us(since)) / 3600000000) AS BIGINT), message FROM q WHERE message LIKE 'deferred%' AND since < {NOW} - INTERVAL 24 HOURS""")
def ops_alerts(spark, sf):
    k = F.col("nbi_id")
    queue = carrier(spark, sf, "v_bridges").where(k % 5 == 0).select(k.alias("job_id"), F.col("brand").alias("source_id"), F.lit("queued").alias("status"), F.timestamp_add("HOUR", -F.col("size").cast("int"), now()).alias("enqueued_at"), F.when(k % 2 == 0, "deferred: disk").alias("message"))
    a = ops.alerts(_runs(spark, sf), _sources(spark, sf), queue, now(), nightly=["error"], window_h=720, nightly_h=700)
    return a.select("key", "n", F.when(F.col("key") != "backlog/queue", F.col("said")).alias("said"))


@query("digest_activity", f"""
    SELECT source_id, count(*) AS runs, count(*) FILTER (WHERE st = 'success') AS ok, count(*) FILTER (WHERE st IN ('skipped_unchanged', 'gated')) AS skipped, count(*) FILTER (WHERE st = 'failed') AS failed, count(*) FILTER (WHERE st = 'running') AS running,
      CAST(coalesce(sum(rows_published), 0) AS BIGINT) AS rows_published FROM {RUNS} r WHERE started_at >= {NOW} - INTERVAL 20 DAYS GROUP BY source_id""")
def digest_activity(spark, sf):
    return ops.activity(_runs(spark, sf), now(), 20).drop("last_at")


@query("digest_attention", f"""
    WITH r AS {RUNS}, g AS (SELECT source_id, max(started_at) FILTER (WHERE st IN ('success', 'skipped_unchanged', 'skipped_no_key')) AS ok_at, max(struct_pack(a := started_at, b := run_id)) FILTER (WHERE st <> 'failed') AS good FROM r GROUP BY source_id),
    f AS (SELECT r.source_id, count(*) FILTER (WHERE good IS NULL OR struct_pack(a := started_at, b := run_id) > good) AS streak, count(*) FILTER (WHERE st = 'failed' AND started_at >= {NOW} - INTERVAL 7 DAYS) AS failed FROM r JOIN g ON r.source_id = g.source_id GROUP BY r.source_id),
    x AS (SELECT g.source_id, CASE WHEN g.source_id <> 'click' AND (ok_at IS NULL OR ok_at < {NOW} - INTERVAL 12 HOURS) THEN 'STALE' WHEN streak >= 5 THEN 'BREAKER OPEN' WHEN failed > 0 THEN 'FAILING' END AS reason FROM g JOIN f ON g.source_id = f.source_id)
    SELECT source_id, reason FROM x WHERE reason IS NOT NULL""")
def digest_attention(spark, sf):
    return ops.attention(_runs(spark, sf), _sources(spark, sf), now())


@query("device_rejects", """
    SELECT device_id, count(*) AS rejects FROM {v_pings} WHERE device_id % 3 <> 0 AND (ping_id % 7 = 0 OR device_id % 5 = 0) GROUP BY device_id""")
def device_rejects(spark, sf):
    p = carrier(spark, sf, "v_pings")
    devices = p.where("device_id % 3 <> 0").select("device_id").distinct().select("device_id", F.sha2(F.concat(F.lit("t"), F.col("device_id").cast("string")).cast("binary"), 256).alias("token_sha256"), (F.col("device_id") % 5 != 0).alias("active"))
    token = F.when(F.col("ping_id") % 7 == 0, "wrong").otherwise(F.concat(F.lit("t"), F.col("device_id").cast("string")))
    return tracking.rejects(tracking.authorise(p.withColumn("token", token), devices))


@query("viewer_inventory", f"""
    SELECT 'bridges' AS layer, count(*) FILTER (WHERE clearance_in IS NOT NULL) AS drawn, count(*) AS held, NULL::TIMESTAMP AS newest FROM {{v_bridges}}
    UNION ALL SELECT 'pings', count(*), count(*), max(observed_at) FROM {{v_pings}}""")
def viewer_inventory(spark, sf):
    return viewer.inventory({"bridges": (carrier(spark, sf, "v_bridges"), "clearance_in is not null"), "pings": (carrier(spark, sf, "v_pings"), None)})


@query("viewer_breakdown", "SELECT coalesce(posting, 'unknown') AS posting, count(*) AS n FROM {v_bridges} WHERE clearance_in IS NOT NULL GROUP BY 1")
def viewer_breakdown(spark, sf):
    return viewer.breakdown(carrier(spark, sf, "v_bridges"), "posting", "clearance_in is not null")


@query("viewer_prices", "SELECT region, product, week_of, price FROM (SELECT *, row_number() OVER (PARTITION BY region, product ORDER BY week_of DESC, price DESC) AS n FROM {v_prices}) t WHERE n = 1")
def viewer_prices(spark, sf):
    return viewer.latest_prices(carrier(spark, sf, "v_prices"))


@query("viewer_runs", "SELECT run_id, source_id, status FROM {v_runs} ORDER BY started_at DESC, run_id DESC LIMIT 25")
def viewer_runs(spark, sf):
    return viewer.last_runs(carrier(spark, sf, "v_runs")).select("run_id", "source_id", "status")


@query("text_search", "SELECT nbi_id FROM {v_bridges} WHERE list_has_all(string_split(lower(name || ' ' || brand), ' '), ['green', 'bolt']) OR len(list_intersect(list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))), ['  b', ' bo', 'bol', 'olt', 'lt ', '  g', ' gr', 'gre', 'ree', 'een', 'en ']))::DOUBLE / len(list_distinct(list_concat(list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))), ['  b', ' bo', 'bol', 'olt', 'lt ', '  g', ' gr', 'gre', 'ree', 'een', 'en ']))) > 0.3")
def text_search(spark, sf):
    return viewer.search(carrier(spark, sf, "v_bridges"), "Bolt green", ("name", "brand")).select("nbi_id")


@query("conflate_staged", "SELECT row_number() OVER (ORDER BY nbi_id, name) AS rid, nbi_id AS source_record_id FROM {v_bridges} WHERE nbi_id % 3 <> 0 AND nbi_id % 7 <> 0 AND nbi_id % 11 <> 0 AND posting IS NOT NULL")
def conflate_staged(spark, sf):
    k = F.col("nbi_id")
    at = lambda c: F.when(k % 7 == 0, 0.0).when(k % 11 == 0, 500.0).otherwise(F.col(c)).alias(c)
    rows = carrier(spark, sf, "v_bridges").select(k.alias("source_record_id"), "name", F.col("posting").alias("category"), at("lon"), at("lat"), F.when(k % 3 == 0, "2023-01-01").alias("date_closed"))
    return conflate.staged(rows, "date_closed").select(F.col("rid").cast("bigint").alias("rid"), "source_record_id")


# ---- feeds and text ----------------------------------------------------------------------------------------


@query("national_network", """
    SELECT nbi_id AS route_id, 'I ' || CAST(size AS VARCHAR) AS route_ref, CASE WHEN nbi_id % 2 = 0 THEN 'TX' ELSE 'OK' END AS state, CASE WHEN nbi_id % 2 = 0 THEN 48000 ELSE 40000 END + size AS county_fips, CASE WHEN nbi_id % 3 <> 0 THEN 'MULTILINESTRING((1.5 2.0, 3.0 4.25))' END AS geom_wkt
    FROM {v_bridges} WHERE nbi_id % 4 <> 0""")
def national_network(spark, sf):
    k, n = F.col("nbi_id"), F.col("size").cast("string")
    geometry = F.when(k % 3 == 0, F.lit('{"type": "LineString", "coordinates": [[1.5, 2.0]]}')).when(k % 3 == 1, F.lit('{"type": "LineString", "coordinates": [[1.5, 2.0], [3.0, 4.25]]}')).otherwise(F.lit('{"type": "MultiLineString", "coordinates": [[[1.5, 2.0], [3.0, 4.25]], [[9.0, 9.0]]]}'))
    feature = F.concat(F.lit('{"type": "Feature", "properties": {"ID": '), k.cast("string"), F.lit(', "NN": '), F.when(k % 4 == 0, "0").otherwise("1"), F.lit(', "SIGNT1": "I", "SIGNN1": "'), n, F.lit('", "STFIPS": '), F.when(k % 2 == 0, "48").otherwise("40"), F.lit(', "CTFIPS": '), n, F.lit(', "YEAR": 2018}, "geometry": '), geometry, F.lit("}"))
    docs = carrier(spark, sf, "v_bridges").select(k.cast("string").alias("path"), F.concat(F.lit('{"features": ['), feature, F.lit("]}")).alias("content"))
    return feeds.national_network(docs).select("route_id", "route_ref", "state", "county_fips", "geom_wkt")


def _features(spark, sf, feature):
    """A document of one feature for every bridge."""
    k = F.col("nbi_id").cast("string")
    return carrier(spark, sf, "v_bridges").select(k.alias("path"), F.concat(F.lit('{"features": ['), feature, F.lit("]}")).alias("content"))


def _json(*parts):
    """JSON text of literals and columns in turn."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("spheroid", """
    WITH r AS (SELECT nbi_id, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat))) AS b1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(40.0::DOUBLE))) AS b2, radians(-100.0::DOUBLE - lon) AS dl FROM {v_bridges}),
    c AS (SELECT *, 2 * asin(sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2))) AS s, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q FROM r)
    SELECT nbi_id, round(CASE WHEN s = 0 THEN 0 ELSE 6378137.0::DOUBLE * (s - 1 / 298.257223563::DOUBLE / 2 * ((s - sin(s)) * pow(sin(p) * cos(q) / cos(s / 2), 2) + (s + sin(s)) * pow(cos(p) * sin(q) / sin(s / 2), 2))) END, 2) AS metres FROM c""")
def spheroid(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", F.round(geo.spheroid_m(F.col("lon"), F.col("lat"), F.lit(-100.0), F.lit(40.0)), 2).alias("metres"))


@query("feed_prices", "SELECT CASE nbi_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'PADD1A' ELSE 'X9' END AS region, DATE '2024-01-01' + CAST(size AS INTEGER) AS week_of, size / 10.0::DOUBLE AS price_usd_gal FROM {v_bridges} WHERE nbi_id % 4 <> 0")
def feed_prices(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    area = F.when(k % 3 == 0, "NUS").when(k % 3 == 1, " R1X ").otherwise("X9")
    value = F.when(k % 4 == 0, "null").otherwise((n / 10.0).cast("string"))
    row = _json('{"response": {"data": [{"duoarea": "', area, '", "period": "', F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")), '", "value": ', value, "}]}}")
    docs = carrier(spark, sf, "v_bridges").select(k.cast("string").alias("path"), row.alias("content"))
    return feeds.weekly_prices(docs).select("region", "week_of", "price_usd_gal")


@query("feed_parking", "SELECT CAST(nbi_id AS VARCHAR) AS site_id, CASE WHEN nbi_id % 3 = 0 THEN 'public_rest_area' ELSE 'truck_stop' END AS kind, 'TX' AS state, CAST(size AS DOUBLE) AS lat, -100.5::DOUBLE AS lon, CASE WHEN nbi_id % 2 = 0 THEN CAST(size AS INTEGER) END AS truck_spaces FROM {v_bridges}")
def feed_parking(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    name, spots = F.when(k % 3 == 0, "Weigh Scale 4").otherwise("Joe"), F.when(k % 2 == 0, n.cast("string")).otherwise('"many"')
    point = F.when(k % 5 == 0, _json('null, "bbox": ', n)).otherwise(_json('{"type": "Point", "coordinates": [-100.5, ', n, "]}"))
    feature = _json('{"properties": {"OBJECTID": ', k, ', "nhs_rest_stop": "', name, '", "state": " tx ", "longitude": -100.5, "latitude": ', n, ', "number_of_spots": ', spots, '}, "geometry": ', point, "}")
    return feeds.parking(_features(spark, sf, feature), "2024-01-01").select("site_id", "kind", "state", "lat", "lon", "truck_spaces")


@query("feed_tunnels", "SELECT CASE WHEN nbi_id % 4 <> 0 THEN '48' || CAST(nbi_id AS VARCHAR) END AS tunnel_id, 'TX' AS state, round(size * 12.0::DOUBLE, 1) AS min_vert_clearance_in, CASE nbi_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS hazmat_restricted FROM {v_bridges}")
def feed_tunnels(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    flag = F.when(k % 3 == 0, '"1"').when(k % 3 == 1, '"0"').otherwise('"N"')
    number = F.when(k % 4 == 0, "").otherwise(k.cast("string"))
    feature = _json('{"properties": {"state_code_i3": "48", "tunnel_number_i1": "', number, '", "min_vert_clearance_over_tunnel_": ', n, ', "hazardous_material_restriction_": ', flag, '}, "geometry": null}')
    return feeds.tunnels(_features(spark, sf, feature)).select("tunnel_id", "state", "min_vert_clearance_in", "hazmat_restricted")


@query("feed_alerts", "SELECT 'a' || CAST(nbi_id AS VARCHAR) AS event_id, CASE WHEN nbi_id % 3 = 0 THEN 'POLYGON ((1 2,3 4,5 ' || CAST(size AS VARCHAR) || ',1 2))' END AS geom_wkt FROM {v_bridges}")
def feed_alerts(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    ring = F.when(k % 3 == 0, _json('{"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, ', n, "], [1, 2]]]}")).otherwise("null")
    return feeds.weather_alerts(_features(spark, sf, _json('{"id": "a', k, '", "properties": {"sent": "2024-01-01T00:00:00Z"}, "geometry": ', ring, "}"))).select("event_id", "geom_wkt")


@query("feed_chain_sites", "SELECT 'loves:' || CAST(nbi_id AS VARCHAR) AS chain_site_id, CASE WHEN nbi_id % 2 = 0 THEN 'OK' END AS state, CASE WHEN nbi_id % 5 = 0 THEN true END AS open_24h FROM {v_bridges} WHERE nbi_id % 4 <> 0")
def feed_chain_sites(spark, sf):
    k = F.col("nbi_id")
    ref = F.when(k % 4 == 0, "").otherwise(k.cast("string"))
    feature = _json('{"properties": {"ref": "', ref, '", "brand": "L", "addr:state": "', F.when(k % 2 == 0, "ok").otherwise("Oklahoma"), '", "opening_hours": "', F.when(k % 5 == 0, feeds.ALWAYS_OPEN[0]).otherwise("Mo-Fr"), '"}, "geometry": {"type": "Point", "coordinates": [-100.0, 35.0]}}')
    return feeds.chain_sites(_features(spark, sf, feature), "loves", "2024-01-01").select("chain_site_id", "state", "open_24h")


@query("feed_state_prices", "SELECT CASE nbi_id % 2 WHEN 0 THEN 'TX' ELSE 'CA' END AS state, 3 + size / 100.0::DOUBLE AS price FROM {v_bridges} WHERE nbi_id % 3 <> 0")
def feed_state_prices(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    page = _json('<table><tr><td><a href="?x=1&state=', F.when(k % 3 == 0, "ZZ").when(k % 2 == 0, "TX").otherwise("CA"), '">s</a></td><td class="regular">$2.999</td><td class="b diesel">\n $', F.format_string("%.3f", 3 + n / 100.0), "</td></tr></table>")
    return feeds.state_prices(carrier(spark, sf, "v_bridges").select(k.cast("string").alias("path"), page.alias("content"))).select("state", F.round("price", 2).alias("price"))


@query("feed_registry", "SELECT nbi_id, CASE nbi_id % 6 WHEN 0 THEN 'inactive' WHEN 1 THEN 'no_url' WHEN 2 THEN 'needs_key' WHEN 3 THEN 'embedded_credential' WHEN 4 THEN CASE WHEN size % 2 = 0 THEN 'other_schema' ELSE 'no_state' END END AS reason FROM {v_bridges}")
def feed_registry(spark, sf):
    k, n = F.col("nbi_id"), F.col("size")
    url = F.when(k % 6 == 1, "ftp://h").when(k % 6 == 3, "https://h/f?a=1&Api_Key=x").otherwise("https://h/f?api_key=&n=1")
    rows = carrier(spark, sf, "v_bridges").select(
        "nbi_id", F.when(k % 6 == 0, "false").otherwise("TRUE").alias("active"), url.alias("url"), F.when(k % 6 == 2, "yes").alias("needAPIKey"), F.when((k % 6 == 4) & (n % 2 == 0), "cwz 1").when(k % 6 == 4, "4").otherwise("4.1").alias("version"), F.when(k % 6 == 4, "nowhere").otherwise(" Texas ").alias("state")
    )
    return feeds.classify_registry(rows, {"texas": "TX"}).select("nbi_id", "reason")


@query("feed_registry_ids", """
    WITH r AS (SELECT nbi_id, CASE nbi_id % 3 WHEN 0 THEN 'tx' WHEN 1 THEN 'ok' END AS st, lower(regexp_replace(trim(regexp_replace(name, '[^a-zA-Z0-9]+', ' ', 'g')), ' ', '_', 'g')) AS slug FROM {v_bridges})
    SELECT nbi_id, CASE WHEN st IS NOT NULL THEN 'wzdx_' || st || CASE WHEN row_number() OVER (PARTITION BY st ORDER BY nbi_id) > 1 THEN '_' || slug ELSE '' END END AS source_id FROM r""")
def feed_registry_ids(spark, sf):
    k = F.col("nbi_id")
    rows = carrier(spark, sf, "v_bridges").select(
        "nbi_id", F.lit("true").alias("active"), F.lit("https://h").alias("url"), F.lit(None).cast("string").alias("needAPIKey"), F.lit("4.1").alias("version"), F.when(k % 3 == 0, "Texas").when(k % 3 == 1, "Oklahoma").alias("state"), F.col("name").alias("feedName"), F.lit("org").alias("issuingOrganization")
    )
    return feeds.registry_ids(feeds.classify_registry(rows, {"texas": "TX", "oklahoma": "OK"}), "nbi_id").select("nbi_id", "source_id")


@query("licence_ids", "SELECT CASE WHEN n = 1 THEN id ELSE id || '/' || CAST(n AS VARCHAR) END AS id, nbi_id FROM (SELECT brand AS id, nbi_id, row_number() OVER (PARTITION BY brand ORDER BY nbi_id) AS n FROM {v_bridges} WHERE posting IN ('P', 'K'))")
def licence_ids(spark, sf):
    return feeds.licences(carrier(spark, sf, "v_bridges").select(F.col("brand").alias("id"), "nbi_id", "posting"), "id", ["P", "K"], "posting").select("id", "nbi_id")


@query("state_codes", "SELECT nbi_id, CASE nbi_id % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'OK' END AS state FROM {v_bridges}")
def state_codes(spark, sf):
    k = F.col("nbi_id")
    return carrier(spark, sf, "v_bridges").select("nbi_id", text.state_code(F.when(k % 3 == 0, " tx").when(k % 3 == 1, "OK").otherwise("Texas")).alias("state"))


@query("place_labels", "SELECT nbi_id, CASE nbi_id % 4 WHEN 0 THEN 'fuel' WHEN 1 THEN 'repair' WHEN 2 THEN 'fuel' END AS slug FROM {v_bridges}")
def place_labels(spark, sf):
    k = F.col("nbi_id")
    labels = F.when(k % 4 == 0, F.array(F.lit("Garage"), F.lit("Gas Station"))).when(k % 4 == 1, F.array(F.lit("Garage"))).when(k % 4 == 2, F.array(F.lit("x"), F.lit("Truck Stop"))).otherwise(F.array(F.lit("Museum")))
    return carrier(spark, sf, "v_bridges").select("nbi_id", feeds.first_label(labels, {"Garage": "repair", "Gas Station": "fuel", "Truck Stop": "fuel"}, ["fuel", "repair"]).alias("slug"))


@query("redacted", "SELECT nbi_id, 'https://h/x?api_key=[redacted]&n=' || CAST(size AS VARCHAR) AS url FROM {v_bridges}")
def redacted(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", text.redact(F.concat(F.lit("https://h/x?api_key="), F.col("brand"), F.lit("&n="), F.col("size").cast("string"))).alias("url"))


@query("inferred_brand", "SELECT p_partkey, CASE WHEN p_size > 25 AND (p_brand IN ('Brand#11', 'Brand#23') OR contains(lower(p_name), 'green')) THEN 'inferred' END AS def FROM {part}")
def inferred_brand(spark, sf):
    category = F.when(F.col("p_size") > 25, "fuel").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", text.inferred_brand(F.col("p_name"), F.col("p_brand"), category, ["fuel"], ["brand11", "brand23"], ["green"]).alias("def"))


@query("ping_spacing", """
    WITH RECURSIVE p AS (SELECT ping_id, device_id, observed_at, row_number() OVER (PARTITION BY device_id ORDER BY observed_at, ping_id) AS n FROM {v_pings}),
    nxt AS (SELECT a.device_id, a.n, min(b.n) AS m FROM p a JOIN p b ON a.device_id = b.device_id AND b.observed_at >= a.observed_at + INTERVAL 2 DAYS GROUP BY a.device_id, a.n),
    ok(device_id, n) AS (SELECT DISTINCT device_id, CAST(1 AS BIGINT) FROM p UNION ALL SELECT nxt.device_id, nxt.m FROM ok JOIN nxt ON nxt.device_id = ok.device_id AND nxt.n = ok.n)
    SELECT ping_id, ok.n IS NULL AS rate_limited FROM p LEFT JOIN ok ON ok.device_id = p.device_id AND ok.n = p.n""")
def ping_spacing(spark, sf):
    """Which pings come within two days of the last one of their device that was let in."""
    p = carrier(spark, sf, "v_pings").withColumn("received_at", F.col("observed_at"))
    return devices.spaced(p, 2 * 86_400).select("ping_id", "rate_limited")


WORDS = "string_split(regexp_replace(lower(name || ' ' || brand), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query("stem_index", f"""
    WITH w AS (SELECT nbi_id, unnest({WORDS}) AS w, unnest(range(1, len({WORDS}) + 1)) AS pos FROM {{v_bridges}})
    SELECT nbi_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM w WHERE w IN ('bolt', 'bolts', 'bolted', 'bolting') GROUP BY nbi_id""")
def stem_index(spark, sf):
    """Where the names and brands have forms of one word."""
    at = fulltext.index(carrier(spark, sf, "v_bridges"), "nbi_id", ("name", "brand")).where(F.col("stem").isin(fulltext.asked(spark, "bolting")))
    return at.select("nbi_id", F.array_join("positions", ",").alias("places"))


@query("stemmed_search", f"SELECT nbi_id FROM {{v_bridges}} WHERE list_has_all({WORDS}, ['bolt', 'brand'])")
def stemmed_search(spark, sf):
    """Rows that have the stems of a query in other forms than the table, through the index."""
    at = fulltext.index(carrier(spark, sf, "v_bridges"), "nbi_id", ("name", "brand"))
    return fulltext.having_all(at, "some bolting, and the brands", "nbi_id")
