"""Queries over gates, scores, text, units, space, graph, conflation, tracking and operations, with DuckDB forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.functions import geo, score, units
from haulspark.functions import tags as tagged
from haulspark.functions import text as T
from haulspark.operators import conflate, gates, graph, presence, routing, spatial
from haulspark.operators.components import components
from haulspark.plans.carriers import carrier, oracle, spark_sql, table
from haulspark.session import checkpoint
from haulspark.sinks import tables as sinks
from haulspark.streaming import tracking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return put


def both(name: str, text: str) -> None:
    QUERIES[name] = lambda spark, sf: spark_sql(spark, sf, text)
    SQL[name] = oracle(text)


def now() -> F.Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


# ---- gates -------------------------------------------------------------------------------------------------

RAW = "SELECT nbi_id, CASE WHEN nbi_id % 11 = 0 THEN NULL ELSE name END AS name, CASE nbi_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'junk' ELSE CAST(lat AS VARCHAR(30)) END AS lat, CAST(lon AS VARCHAR(30)) AS lon FROM {v_bridges}"


@query("gate1_schema", f"""
    WITH r AS ({RAW}) SELECT nbi_id, CASE WHEN name IS NULL THEN 'missing_required:name' WHEN lat IS NULL THEN 'missing_required:lat' WHEN try_cast(lat AS DOUBLE) IS NULL THEN 'unparseable:lat' END AS reject_reason FROM r""")
def gate1_schema(spark, sf):
    return spark_sql(spark, sf, RAW.replace("VARCHAR(30)", "STRING")).select("nbi_id", gates.schema_reason(["name", "lat", "lon"]).alias("reject_reason"))


@query("gate2_coords", """
    WITH r AS (SELECT nbi_id, CASE nbi_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN lat WHEN 2 THEN 10.0::DOUBLE ELSE lon END AS lon, CASE nbi_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN lon WHEN 2 THEN 50.0::DOUBLE ELSE lat END AS lat FROM {v_bridges}),
    b AS (SELECT * FROM (VALUES (-125.0,24.4,-66.9,49.4),(-179.9,51.0,-129.9,71.5),(-160.6,18.8,-154.7,22.5),(-67.6,17.5,-64.4,18.6),(144.2,12.9,146.2,20.8),(-171.2,-14.7,-168.0,-10.8),(-83.0,23.5,-79.8,24.4)) t(x0,y0,x1,y1))
    SELECT nbi_id, CASE WHEN (lon = 0 AND lat = 0) OR abs(lat) > 90 OR abs(lon) > 180 THEN 'coords_out_of_range'
      WHEN EXISTS (SELECT 1 FROM b WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) THEN NULL
      WHEN EXISTS (SELECT 1 FROM b WHERE lat BETWEEN x0 AND x1 AND lon BETWEEN y0 AND y1) THEN 'latlon_swapped' ELSE 'coords_not_in_us' END AS reject_reason FROM r""")
def gate2_coords(spark, sf):
    b, m = carrier(spark, sf, "v_bridges"), F.col("nbi_id") % 5
    lon = F.when(m == 0, 0.0).when(m == 1, F.col("lat")).when(m == 2, 10.0).otherwise(F.col("lon"))
    lat = F.when(m == 0, 0.0).when(m == 1, F.col("lon")).when(m == 2, 50.0).otherwise(F.col("lat"))
    return b.select("nbi_id", gates.coords_reason(lon, lat).alias("reject_reason"))


@query("gate2_wkt", """
    SELECT nbi_id, CASE nbi_id % 4 WHEN 0 THEN 'geom_unparseable' WHEN 1 THEN 'coords_out_of_range' WHEN 3 THEN CASE WHEN lon BETWEEN -125.0 AND -66.9 AND lat BETWEEN 24.4 AND 49.4 THEN NULL ELSE 'coords_not_in_us' END END AS reject_reason FROM {v_bridges}""")
def gate2_wkt(spark, sf):
    b, m = carrier(spark, sf, "v_bridges"), F.col("nbi_id") % 4
    pt = F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string"))
    wkt = F.when(m == 0, "POINT EMPTY").when(m == 1, F.concat(F.lit("LINESTRING ("), pt, F.lit(", 0 0)"))).when(m == 3, F.concat(F.lit("MULTIPOINT Z (("), pt, F.lit(" 7), (10 50 1))")))
    return b.select("nbi_id", gates.coords_reason(wkt=wkt).alias("reject_reason"))


@query("gate3_dedup", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN lead(1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) IS NOT NULL THEN 'duplicate_natural_key' END AS reject_reason FROM {lineitem}""")
def gate3_dedup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return gates.duplicate_reason(rows, "l_orderkey", "ord").drop("ord")


@query("gate4_conflicts", """
    WITH was AS (SELECT nbi_id AS e FROM {v_bridges} WHERE posting = 'K' AND nbi_id % 3 <> 1), found AS (SELECT nbi_id AS e FROM {v_bridges} WHERE posting = 'K' AND clearance_in IS NOT NULL)
    SELECT coalesce(f.e, w.e) AS entity_id, CASE WHEN w.e IS NULL THEN 'open' WHEN f.e IS NULL THEN 'close' ELSE 'keep' END AS action FROM found f FULL OUTER JOIN was w ON w.e = f.e""")
def gate4_conflicts(spark, sf):
    k = carrier(spark, sf, "v_bridges").where("posting = 'K'")
    row = lambda df: df.select(F.lit("closed_with_clearance").alias("check_id"), F.col("nbi_id").alias("entity_id"))
    return gates.reconcile_conflicts(row(k.where("nbi_id % 3 <> 1")), row(k.where("clearance_in is not null"))).select("entity_id", "action")


@query("gate_run_verdict", """
    WITH c AS (SELECT source_id, count(*) FILTER (WHERE rows_published > 2) AS ok, count(*) FILTER (WHERE rows_published <= 2) AS rejected, count(*) FILTER (WHERE rows_published = 1) AS geometry_rejects, max(rows_published) * 20 AS previous FROM {v_runs} GROUP BY source_id)
    SELECT source_id, CASE WHEN ok = 0 AND rejected > 0 THEN 'all_rows_rejected' WHEN ok < 100 THEN 'below_min_rows' WHEN 100.0::DOUBLE * (ok + rejected - geometry_rejects) / (ok + rejected) < 95 THEN 'geometry_valid_pct'
      WHEN previous > 0 AND 100.0::DOUBLE * abs(ok - previous) / previous > 20 THEN 'max_row_delta_pct' END AS gated_by FROM c""")
def gate_run_verdict(spark, sf):
    r = carrier(spark, sf, "v_runs")
    c = r.groupBy("source_id").agg(F.count_if(F.col("rows_published") > 2).alias("ok"), F.count_if(F.col("rows_published") <= 2).alias("rejected"), F.count_if(F.col("rows_published") == 1).alias("geometry_rejects"), (F.max("rows_published") * 20).alias("previous"))
    return gates.verdict(c, 100, 95, 20).select("source_id", "gated_by")


@query("gate_state_floor", """
    WITH a AS (SELECT state, count(*) AS n FROM {v_places} WHERE place_id % 3 <> 0 GROUP BY state), b AS (SELECT state, count(*) * 4 AS previous FROM {v_places} GROUP BY state)
    SELECT coalesce(a.state, b.state) AS state, coalesce(n, 0) AS n, previous, CASE WHEN previous >= 10 AND coalesce(n, 0) < previous * 0.5::DOUBLE THEN 'dropped' WHEN coalesce(n, 0) < 3 THEN 'below_floor' END AS violation FROM a FULL OUTER JOIN b ON a.state = b.state""")
def gate_state_floor(spark, sf):
    p = carrier(spark, sf, "v_places")
    return gates.state_floors(p.where("place_id % 3 <> 0").groupBy("state").agg(F.count(F.lit(1)).alias("n")), p.groupBy("state").agg((F.count(F.lit(1)) * 4).alias("n")))


# ---- sinks as queries --------------------------------------------------------------------------------------


@query("swap_then_read", "SELECT nbi_id, clearance_in FROM {v_bridges}")
def swap_then_read(spark, sf):
    return _swap_then_read(spark, sf, "swap", "true")


def _swap_then_read(spark, sf, folder, rows):
    from haulspark.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/{folder}-{sf.rstrip('/').split('/')[-1]}"
    b = carrier(spark, sf, "v_bridges").select("nbi_id", "clearance_in")
    sinks.snapshot_swap(b.where(rows), path, min_rows=10)
    try:  # too few rows: the version before stays
        sinks.snapshot_swap(b.where("nbi_id < 3"), path, min_rows=10)
    except sinks.RefusedLoad:
        pass
    return sinks.current(spark, path)


@query("event_lifecycle", f"""
    WITH live AS (SELECT source_id, run_id AS event_id, started_at, CASE WHEN run_id % 4 = 0 THEN started_at END AS closed, rows_published FROM {{v_runs}} WHERE run_id % 3 <> 0),
    seen AS (SELECT source_id, run_id AS event_id, rows_published + 1 AS rows_published FROM {{v_runs}} WHERE run_id % 2 = 0 AND source_id <> 'error')
    SELECT coalesce(l.source_id, s.source_id) AS source_id, coalesce(l.event_id, s.event_id) AS event_id, coalesce(l.started_at, {NOW}) AS first_seen,
      CASE WHEN s.event_id IS NOT NULL THEN NULL WHEN coalesce(l.source_id, s.source_id) <> 'error' THEN coalesce(l.closed, {NOW}) ELSE l.closed END AS soft_closed_at,
      coalesce(s.rows_published, l.rows_published) AS rows_published
    FROM live l FULL OUTER JOIN seen s ON l.source_id = s.source_id AND l.event_id = s.event_id""")
def event_lifecycle(spark, sf):
    r = carrier(spark, sf, "v_runs").withColumnRenamed("run_id", "event_id")
    live = r.where("event_id % 3 <> 0").select("source_id", "event_id", F.col("started_at").alias("first_seen"), F.col("started_at").alias("last_seen"), F.when(F.col("event_id") % 4 == 0, F.col("started_at")).alias("soft_closed_at"), "rows_published")
    seen = r.where("event_id % 2 = 0 and source_id <> 'error'").select("source_id", "event_id", (F.col("rows_published") + 1).alias("rows_published"))
    return sinks.event_lifecycle(live, seen, now()).drop("last_seen")


@query("upsert_prices", """
    SELECT region, week_of, price FROM {v_prices} WHERE region NOT IN ('NATION_1', 'NATION_2') OR week_of < DATE '2000-01-01'
    UNION ALL SELECT region, week_of, price * 2 FROM {v_prices} WHERE region IN ('NATION_1', 'NATION_2') AND week_of >= DATE '2000-01-01'""")
def upsert_prices(spark, sf):
    p = carrier(spark, sf, "v_prices").select("region", "week_of", "price")
    new = p.where("region in ('NATION_1', 'NATION_2') and week_of >= date'2000-01-01'").withColumn("price", F.col("price") * 2)
    return sinks.upsert(p, new, ["region", "week_of"])


@query("merge_buckets", """
    SELECT nbi_id, brand, CASE WHEN nbi_id < 60 THEN size + 100 ELSE size END AS size FROM {v_bridges} WHERE nbi_id % 97 <> 5 OR nbi_id >= 400
    UNION ALL SELECT nbi_id + 10000000, brand, size FROM {v_bridges} WHERE nbi_id < 20""")
def merge_buckets(spark, sf):
    """A table of buckets after a merge of changed, new and removed rows."""
    from haulspark.session import checkpoint_dir
    from haulspark.sinks import buckets

    b = carrier(spark, sf, "v_bridges").select("nbi_id", "brand", "size")
    path = f"{checkpoint_dir(spark)}/buckets-{uuid.uuid4().hex}"
    buckets.create(b, path, ["nbi_id"], 16)
    changed = b.where("nbi_id < 60").withColumn("size", F.col("size") + 100).unionByName(b.where("nbi_id < 20").withColumn("nbi_id", F.col("nbi_id") + 10_000_000))
    buckets.merge(changed, path, gone=b.where("nbi_id % 97 = 5 and nbi_id < 400"))
    return buckets.read(spark, path)


@query("replace_groups", "SELECT nbi_id, brand, size FROM {v_bridges} WHERE brand NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT nbi_id, brand, size + 1 FROM {v_bridges} WHERE brand = 'Brand#1'")
def replace_groups(spark, sf):
    old = carrier(spark, sf, "v_bridges").select("nbi_id", "brand", "size")
    new = old.where("brand in ('Brand#1', 'Brand#3')").withColumn("size", F.col("size") + 1)
    return sinks.replace_groups(old, new, "brand", ["Brand#1", "Brand#2"])


@query("retention", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC) AS n, max(CASE WHEN status = 'success' THEN started_at END) OVER (PARTITION BY source_id) AS ok FROM {{v_runs}})
    SELECT run_id, source_id FROM r WHERE started_at >= {NOW} - INTERVAL 5 DAYS OR n = 1 OR started_at = ok""")
def retention(spark, sf):
    return sinks.retention(carrier(spark, sf, "v_runs"), "source_id", "started_at", now(), 5, F.col("status") == "success").select("run_id", "source_id")


# ---- scores ------------------------------------------------------------------------------------------------

DECAY = "(CASE WHEN ({at}) IS NULL THEN 0.0::DOUBLE ELSE pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us({now}) - epoch_us({at})) / 86400e6::DOUBLE) / {half}) END)"


@query("confidence_score", f"""
    WITH s AS (SELECT run_id, CASE source_id WHEN 'click' THEN 0.95::DOUBLE WHEN 'view' THEN 0.65::DOUBLE ELSE 0.55::DOUBLE END AS t,
        {DECAY.format(now=NOW, at="CASE WHEN run_id % 10 = 0 THEN NULL ELSE started_at END", half="20.0::DOUBLE")} AS f, CASE WHEN status = 'failed' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS c, run_id % 4 AS k, run_id % 7 = 0 AS g FROM {{v_runs}})
    SELECT run_id, CAST(floor(100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE*t + 0.25::DOUBLE*f + 0.20::DOUBLE*c + 0.20::DOUBLE*(CASE WHEN k > 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)
        - ((CASE WHEN g THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + least(0.20::DOUBLE, 0.10::DOUBLE * k)))) + 0.5::DOUBLE) AS INTEGER) AS confidence, CAST(floor(f * 100.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS conf_fresh FROM s""")
def confidence_score(spark, sf):
    r = carrier(spark, sf, "v_runs")
    trust = F.when(F.col("source_id") == "click", 0.95).when(F.col("source_id") == "view", 0.65).otherwise(0.55)
    fresh = score.decay(F.when(F.col("run_id") % 10 != 0, F.col("started_at")), now(), 20.0)
    n = F.col("run_id") % 4
    s = score.confidence(trust, fresh, F.when(F.col("status") == "failed", 0.25).otherwise(1.0), score.agreement(n), F.col("run_id") % 7 == 0, n)
    return r.select("run_id", s.alias("s")).select("run_id", "s.confidence", "s.conf_fresh")


@query("completeness", "SELECT nbi_id, round((3 * (clearance_in IS NOT NULL)::INT + 2 * (posting IS NOT NULL)::INT + (facility IS NOT NULL)::INT) / 6.0::DOUBLE, 9) AS complete FROM {v_bridges}")
def completeness(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", F.round(score.completeness({"clearance_in": 3, "posting": 2, "facility": 1}), 9).alias("complete"))


@query("source_trust", """
    SELECT place_id, coalesce(CASE WHEN place_id % 5 = 0 THEN 0.8::DOUBLE END, CASE WHEN place_id % 7 = 0 THEN 0.7::DOUBLE END, CASE category WHEN 'truck_stop' THEN 0.95::DOUBLE WHEN 'fuel_station' THEN 0.55::DOUBLE END,
      CASE WHEN place_id % 3 = 0 THEN 0.95::DOUBLE WHEN place_id % 3 = 1 THEN 0.90::DOUBLE ELSE 0.55::DOUBLE END) AS trust FROM {v_places}""")
def source_trust(spark, sf):
    k = F.col("place_id")
    sid = F.when(k % 3 == 0, "nbi_annual").when(k % 3 == 1, F.concat(F.lit("wzdx_"), k.cast("string"))).otherwise("osm_fuel")
    cls = F.when(F.col("category") == "truck_stop", "federal").when(F.col("category") == "fuel_station", "community")
    return carrier(spark, sf, "v_places").select("place_id", score.trust_of(sid, F.when(k % 5 == 0, 0.8), F.when(k % 7 == 0, 0.7), cls).alias("trust"))


@query("table_rescore", f"""
    WITH n AS (SELECT p_partkey % 500 AS e, count(*) AS k FROM {{part}} WHERE p_size > 40 GROUP BY p_partkey % 500), x AS (
      SELECT b.nbi_id, coalesce(k, 0) AS k, CASE WHEN nbi_id % 3 = 0 THEN ['offroad', 'conflict_open'] WHEN nbi_id % 3 = 1 THEN ['kept'] END AS fl, posting,
        0.75::DOUBLE * (clearance_in IS NOT NULL)::INT + 0.25::DOUBLE * (posting IS NOT NULL)::INT AS c FROM {{v_bridges}} b LEFT JOIN n ON n.e = b.nbi_id)
    SELECT nbi_id, CAST(floor(100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE*0.95::DOUBLE + 0.25::DOUBLE * CASE WHEN posting IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END + 0.20::DOUBLE*c
      + 0.20::DOUBLE*(CASE WHEN k > 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) - ((CASE WHEN nbi_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + least(0.20::DOUBLE, 0.10::DOUBLE*k)))) + 0.5::DOUBLE) AS INTEGER) AS confidence,
      array_to_string(list_concat(list_filter(coalesce(fl, []), lambda f: f NOT IN ('conflict_open', 'vintage_unknown')), list_concat(CASE WHEN k > 0 THEN ['conflict_open'] ELSE [] END, CASE WHEN posting IS NULL THEN ['vintage_unknown'] ELSE [] END)), ',') AS flags FROM x""")
def table_rescore(spark, sf):
    m = F.col("nbi_id") % 3
    b = carrier(spark, sf, "v_bridges").withColumn("observed_at", F.when(F.col("posting").isNotNull(), now() - F.expr("INTERVAL 100 DAYS")))
    b = b.withColumn("flags", F.when(m == 0, F.array(F.lit("offroad"), F.lit("conflict_open"))).when(m == 1, F.array(F.lit("kept"))))
    conflicts = table(spark, sf, "part").where("p_size > 40").select(F.lit("open").alias("status"), F.lit("bridges").alias("entity_type"), (F.col("p_partkey") % 500).cast("string").alias("entity_id"))
    out = presence.rescore(b, conflicts, F.lit(0.95), now(), 100.0, {"clearance_in": 3, "posting": 1}, F.col("nbi_id"), "bridges")
    return out.select("nbi_id", "confidence", F.array_join("flags", ",").alias("flags"))


@query("presence_fold", f"""
    WITH led AS (SELECT DISTINCT CAST(place_id AS VARCHAR) AS e, 'overture' AS s FROM {{v_places}} WHERE place_id % 2 = 0), new AS (SELECT CAST(place_id AS VARCHAR) AS e, unnest(['overture', 'fsq']) AS s, place_id FROM {{v_places}} WHERE place_id % 5 <> 0)
    SELECT coalesce(l.e, n.e) AS entity_id, coalesce(l.s, n.s) AS source_id, CAST(CASE WHEN l.e IS NULL THEN 1 WHEN n.e IS NULL THEN 3 WHEN n.place_id % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS observations,
      (CASE WHEN n.e IS NULL THEN true ELSE false END) AS missing FROM led l FULL OUTER JOIN new n ON l.e = n.e AND l.s = n.s""")
def presence_fold(spark, sf):
    p = carrier(spark, sf, "v_places")
    t = lambda days: (now() - F.expr(f"INTERVAL {days} DAYS")).cast("timestamp")
    eid = F.col("place_id").cast("string").alias("entity_id")
    ledger = p.where("place_id % 2 = 0").select(F.lit("places").alias("entity_type"), eid, F.lit("overture").alias("source_id"), t(90).alias("first_seen_at"), t(30).alias("last_seen_at"), t(10).alias("missing_since"), F.lit(3).cast("bigint").alias("observations"))
    rows = p.where("place_id % 5 <> 0").select(F.lit("places").alias("entity_type"), eid, F.array(F.lit("overture"), F.lit("fsq")).alias("sources"), F.when(F.col("place_id") % 3 == 0, t(1)).otherwise(t(60)).alias("observed_at"))
    return presence.fold(ledger, rows).select("entity_id", "source_id", "observations", F.col("missing_since").isNotNull().alias("missing"))


@query("vanished", "SELECT CAST(place_id AS VARCHAR) AS entity_id, (place_id % 3 = 0 AND place_id % 2 = 1) AS gone FROM {v_places}")
def vanished(spark, sf):
    p = carrier(spark, sf, "v_places")
    source = F.when(F.col("place_id") % 2 == 0, "chain_sites").otherwise("fsq")
    ledger = p.select(F.lit("places").alias("entity_type"), F.col("place_id").cast("string").alias("entity_id"), source.alias("source_id"), F.lit(None).cast("timestamp").alias("missing_since"))
    out = presence.mark_vanished(ledger, p.where("place_id % 3 <> 0").select(F.col("place_id").alias("entity_id")), "places", now())
    return out.select("entity_id", F.col("missing_since").isNotNull().alias("gone"))


@query("liveness_score", f"""
    WITH s AS (SELECT place_id, {DECAY.format(now=NOW, at="CASE WHEN place_id % 6 = 0 THEN NULL ELSE TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(place_id AS INTEGER)) END", half="365.0::DOUBLE")} AS p,
        CASE place_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS s, CASE WHEN place_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, place_id % 7 = 0 AS m, place_id % 11 = 0 AS x, place_id % 13 = 0 AS c FROM {{v_places}}),
    r AS (SELECT *, CAST(floor(100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE*p + 0.3::DOUBLE*s + 0.2::DOUBLE*a - (CASE WHEN m THEN 0.30::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN x THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))) + 0.5::DOUBLE) AS INTEGER) AS raw FROM s)
    SELECT place_id, CASE WHEN c THEN 0 ELSE raw END AS liveness, CASE WHEN c THEN 'closed' WHEN raw >= 75 THEN 'open' WHEN raw >= 50 THEN 'likely_open' WHEN raw >= 25 THEN 'unknown' ELSE 'likely_closed' END AS live_state FROM r""")
def liveness_score(spark, sf):
    k = F.col("place_id")
    seen = F.when(k % 6 != 0, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=k.cast("int")))
    s = score.liveness(score.decay(seen, now(), 365.0), score.breadth(k % 4), F.when(k % 5 == 0, 1.0).otherwise(0.0), k % 7 == 0, k % 11 == 0, k % 13 == 0)
    return carrier(spark, sf, "v_places").select("place_id", s.alias("s")).select("place_id", "s.liveness", "s.live_state")


@query("fuel_bands", """
    WITH p AS (SELECT nbi_id, nbi_id % 3 AS n, least(100, (CASE WHEN nbi_id % 3 > 0 THEN 45 ELSE 0 END) + (CASE WHEN nbi_id % 3 > 1 THEN 10 ELSE 0 END) + (CASE WHEN brand < 'Brand#2' THEN 15 ELSE 0 END) + (CASE WHEN size > 25 THEN 15 ELSE 0 END) + (CASE WHEN posting = 'A' THEN 10 ELSE 0 END) + (CASE WHEN facility IS NOT NULL THEN 5 ELSE 0 END)) AS points FROM {v_bridges})
    SELECT nbi_id, points, CASE WHEN nbi_id % 17 = 0 THEN 'unverified' WHEN n > 0 THEN 'verified' WHEN points >= 30 THEN 'probable' ELSE 'unverified' END AS band FROM p""")
def fuel_bands(spark, sf):
    n = F.col("nbi_id") % 3
    pts = score.fuel_points(n, F.col("brand") < "Brand#2", F.col("size") > 25, F.col("posting") == "A", F.col("facility").isNotNull())
    return carrier(spark, sf, "v_bridges").select("nbi_id", pts.alias("points"), score.fuel_band(pts, n, F.col("nbi_id") % 17 != 0).alias("band"))


@query("independence", """
    SELECT place_id, array_to_string(list_sort(list_distinct(list_concat(CASE place_id % 3 WHEN 0 THEN ['overture'] WHEN 1 THEN ['overture', 'meta'] ELSE ['microsoft', 'somefeed'] END,
      list_concat(CASE WHEN place_id % 4 = 0 AND place_id % 8 <> 0 THEN ['state_licence'] ELSE [] END, CASE WHEN place_id % 5 = 0 THEN ['osm'] ELSE [] END)))), ',') AS orgs,
      CAST((CASE place_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) + (CASE WHEN place_id % 4 = 0 AND place_id % 8 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN place_id % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_independent FROM {v_places}""")
def independence(spark, sf):
    k = F.col("place_id")
    feeds = F.when(k % 3 == 0, F.array(F.lit("Overture"), F.lit("Overture-signals"))).when(k % 3 == 1, F.array(F.lit("overture"), F.lit("Facebook"), F.lit("meta"))).otherwise(F.array(F.lit("Bing"), F.lit("SomeFeed "), F.lit("msft")))
    orgs = score.organisations(feeds, k % 4 == 0, k % 8 == 0, F.when(k % 5 == 0, k))
    return carrier(spark, sf, "v_places").select("place_id", F.array_join(orgs, ",").alias("orgs"), score.independent(orgs).alias("n_independent"))


# ---- text, units, tags -------------------------------------------------------------------------------------

NAMES = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' TVL CTR #', CAST(p_size AS VARCHAR(9))) WHEN 1 THEN concat('The ', p_name, ' & Sons, Inc.') WHEN 2 THEN concat(p_name, '''s Svc Stn Hwy') WHEN 3 THEN NULL WHEN 4 THEN '!!' ELSE upper(p_name) END AS name FROM {part}"


def names(spark, sf):
    return spark_sql(spark, sf, NAMES.replace("VARCHAR(9)", "STRING").replace("'''s", "'\\'s"))


@query("squeeze", f"WITH n AS ({NAMES}) SELECT id, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]', '', 'g') AS squeezed FROM n")
def squeeze(spark, sf):
    return names(spark, sf).select("id", T.squeeze(F.col("name")).alias("squeezed"))


@query("norm_name", f"""WITH n AS ({NAMES}) SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(name, '')), '#\\s*\\d+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''),
    lambda w: CASE w WHEN 'tvl' THEN 'travel' WHEN 'ctr' THEN 'center' WHEN 'svc' THEN 'service' WHEN 'stn' THEN 'station' WHEN 'hwy' THEN 'highway' ELSE w END), ' ') AS normal FROM n""")
def norm_name(spark, sf):
    return names(spark, sf).select("id", T.norm_name(F.col("name")).alias("normal"))


@query("company_key", f"""WITH n AS ({NAMES}) SELECT id, nullif(array_to_string(list_filter(string_split(regexp_replace(upper(replace(name, '&', ' AND ')), '[^A-Z0-9 ]', ' ', 'g'), ' '),
    lambda w: w <> '' AND w NOT IN ('INC','INCORPORATED','LLC','LLP','LP','LTD','CO','CORP','CORPORATION','COMPANY','THE','AND','OF','DBA')), ''), '') AS k FROM n""")
def company_key(spark, sf):
    return names(spark, sf).select("id", T.company_key(F.col("name")).alias("k"))


@query("address_key", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), 'NMAINST') WHEN 1 THEN concat('5OAKAVE') WHEN 2 THEN concat(CAST(p_size AS VARCHAR), 'AVE') END AS k FROM {part}")
def address_key(spark, sf):
    m, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    a = F.when(m == 0, F.concat(n, F.lit(" North Main Street, Ste 4"))).when(m == 1, "5 Oak Av. Unit B").when(m == 2, F.concat(n, F.lit("th Avenue"))).otherwise("P.O. Box 12")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.address_key(a).alias("k"))


@query("trigram", """
    WITH w AS (SELECT a.s_suppkey AS x, 'red ' || a.s_suppkey AS p, 'red widget ' || (a.s_suppkey + 1) AS q FROM {supplier} a),
    g AS (SELECT x, list_distinct(flatten(list_transform(string_split(p, ' '), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
        list_distinct(flatten(list_transform(string_split(q, ' '), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM w)
    SELECT x AS id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS similarity FROM g""")
def trigram(spark, sf):
    k = F.col("s_suppkey")
    a, b = F.concat(F.lit("Red-"), k.cast("string")), F.concat(F.lit("red WIDGET, "), (k + 1).cast("string"))
    return table(spark, sf, "supplier").select(k.alias("id"), F.round(T.trigram_similarity(a, b), 9).alias("similarity"))


@query("phone", """
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '214555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '911555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '114555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS digits, c_custkey % 4 = 0 AS nanp FROM {customer}""")
def phone(spark, sf):
    k = F.col("c_custkey")
    tail, m = F.lpad((k % 10000).cast("string"), 4, "0"), k % 4
    p = F.when(m == 0, F.concat(F.lit("+1 (214) 555-"), tail)).when(m == 1, F.concat(F.lit("911.555."), tail)).when(m == 2, F.concat(F.lit("114 555 "), tail)).otherwise("555-1234")
    return table(spark, sf, "customer").select("c_custkey", T.phone10(p).alias("digits"), T.is_nanp(T.phone10(p)).alias("nanp"))


@query("carries_route", "SELECT nbi_id, CASE WHEN facility IS NULL THEN NULL ELSE facility = 'I-35 SB' END AS carries FROM {v_bridges}")
def carries_route(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", T.carries_route(F.col("facility"), F.lit("I"), F.lit("35")).alias("carries"))


@query("def_inference", "SELECT nbi_id, CASE WHEN posting = 'A' AND (lower(brand) = 'brand#7' OR name LIKE '%red%widget%') THEN 'inferred' END AS def FROM {v_bridges}")
def def_inference(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", T.inferred_brand(F.col("name"), F.col("brand"), F.col("posting"), ["A"], ["brand7"], ["redwidget"]).alias("def"))


@query("sha_key", "SELECT nbi_id, 'biz_' || substr(sha256(regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || '|' || CAST(nbi_id AS VARCHAR)), 1, 16) AS k FROM {v_bridges}")
def sha_key(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", T.short_key("biz_", T.squeeze(F.col("name")), F.col("nbi_id").cast("string")).alias("k"))


@query("length_units", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 12.0::DOUBLE + 6 WHEN 1 THEN round(p_size * 39.3700787402::DOUBLE, 1) WHEN 2 THEN round(p_size / 100.0::DOUBLE * 39.3700787402::DOUBLE, 1) WHEN 3 THEN CAST(p_size AS DOUBLE) WHEN 4 THEN round((p_size + 0.5::DOUBLE) * 39.3700787402::DOUBLE, 1) END AS inches FROM {part}""")
def length_units(spark, sf):
    n, m = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    s = F.when(m == 0, F.concat(n, F.lit("'6\""))).when(m == 1, F.concat(n, F.lit(" m"))).when(m == 2, F.concat(n, F.lit("cm"))).when(m == 3, F.concat(n, F.lit(" inches"))).when(m == 4, F.concat(n, F.lit(",5"))).otherwise(F.concat(n, F.lit(";5")))
    return table(spark, sf, "part").select("p_partkey", units.length_in(s).alias("inches"))


@query("weight_units", """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN round_even(p_size * 2204.62262185::DOUBLE, 0) WHEN 1 THEN round_even(p_size * 1000 * 2.20462262185::DOUBLE, 0) WHEN 2 THEN p_size * 1000.0::DOUBLE WHEN 3 THEN p_size * 2000.0::DOUBLE WHEN 4 THEN p_size * 2240.0::DOUBLE END AS pounds FROM {part}""")
def weight_units(spark, sf):
    n, m = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    s = F.when(m == 0, n).when(m == 1, F.concat(n, F.lit("000 kg"))).when(m == 2, F.concat(n, F.lit(",000 lbs"))).when(m == 3, F.concat(n, F.lit(" st"))).when(m == 4, F.concat(n, F.lit("lt."))).otherwise(F.concat(n, F.lit(" bananas")))
    return table(spark, sf, "part").select("p_partkey", units.weight_lb(s).alias("pounds"))


@query("packed_dms", "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN round(30 + (p_size % 60) / 60.0::DOUBLE + 12.34::DOUBLE / 3600, 9) END AS lat FROM {part}")
def packed_dms(spark, sf):
    s = F.concat(F.lit("30"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 5 == 0, "9934").otherwise("1234"))
    return table(spark, sf, "part").select("p_partkey", F.round(units.packed_dms(s, 2), 9).alias("lat"))


@query("clearance_units", "SELECT p_partkey, CASE WHEN p_size % 10 NOT IN (0, 9) THEN round((p_size / 10.0::DOUBLE) * 39.3700787::DOUBLE, 1) END AS inches FROM {part}")
def clearance_units(spark, sf):
    s = F.when(F.col("p_size") % 10 == 0, "99.99").when(F.col("p_size") % 10 == 9, "junk").otherwise((F.col("p_size") / 10.0).cast("string"))
    return table(spark, sf, "part").select("p_partkey", units.clearance_in(s).alias("inches"))


@query("feet_inches", "SELECT nbi_id, CASE WHEN clearance_in IS NULL THEN 'unknown' ELSE CAST(CAST(clearance_in AS BIGINT) // 12 AS VARCHAR) || '''' || CAST(CAST(clearance_in AS BIGINT) % 12 AS VARCHAR) || '\"' END AS reads FROM {v_bridges}")
def feet_inches(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", units.feet_inches(F.col("clearance_in")).alias("reads"))


@query("tag_kinds", """
    SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN ['fuel', 'truck_repair'] WHEN 1 THEN ['weigh'] WHEN 2 THEN ['rest'] WHEN 3 THEN ['truck_repair'] ELSE [] END) AS kind,
      CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS diesel FROM {part}""")
def tag_kinds(spark, sf):
    m = F.col("p_partkey") % 5
    tag = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    t = (
        F.when(m == 0, tag("amenity", "fuel", "highway", "services", "shop", "truck_repair", "fuel:HGV_diesel", "yes")).when(m == 1, tag("man_made", "weighbridge", "fuel:diesel", "no"))
        .when(m == 2, tag("highway", "rest_area", "fuel:diesel", "maybe")).when(m == 3, tag("service:vehicle:trailer_repair", "yes")).otherwise(tag("highway", "primary"))
    )
    return table(spark, sf, "part").select("p_partkey", F.explode(tagged.kinds(t)).alias("kind"), tagged.has_diesel(t).alias("diesel"))


@query("strict_dates", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN DATE '2024-01-01' + CAST(p_size AS INTEGER) WHEN 1 THEN DATE '2023-05-07' END AS d FROM {part}")
def strict_dates(spark, sf):
    s = F.when(F.col("p_partkey") % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).cast("string")).when(F.col("p_partkey") % 3 == 1, "05/07/2023").otherwise("2024-13-45")
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(iso, F.try_to_date(s, "MM/dd/yyyy") if hasattr(F, "try_to_date") else F.expr("NULL")).alias("d"))


@query("array_ops", """
    SELECT place_id, list_contains(a, 'fsq') AS has_fsq, list_has_any(a, ['osm', 'x']) AS overlaps, list_has_all(['overture', 'fsq', 'osm'], list_filter(a, lambda v: v IS NOT NULL)) AS within, len(list_filter(a, lambda v: v NOT IN ('overture'))) AS outside
    FROM (SELECT place_id, CASE place_id % 3 WHEN 0 THEN ['overture', 'fsq'] WHEN 1 THEN ['osm'] ELSE ['overture', 'other'] END AS a FROM {v_places}) t""")
def array_ops(spark, sf):
    m = F.col("place_id") % 3
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    a = F.when(m == 0, lits("overture", "fsq")).when(m == 1, lits("osm")).otherwise(lits("overture", "other"))
    p = carrier(spark, sf, "v_places").select("place_id", a.alias("a"))
    return p.select("place_id", F.array_contains("a", "fsq").alias("has_fsq"), F.arrays_overlap("a", lits("osm", "x")).alias("overlaps"), (F.size(F.array_except("a", lits("overture", "fsq", "osm"))) == 0).alias("within"), F.size(F.filter("a", lambda v: v != "overture")).cast("bigint").alias("outside"))


# ---- space -------------------------------------------------------------------------------------------------

HAV = "2*6371008.8::DOUBLE*asin(sqrt(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2)))"


@query("haversine", "SELECT a.place_id, round(" + HAV.format(a="a", b="b") + ", 1) AS dist_m FROM {v_places} a JOIN {v_places} b ON b.place_id = a.place_id + 1")
def haversine(spark, sf):
    p = carrier(spark, sf, "v_places").select("place_id", "lon", "lat")
    q = p.select((F.col("place_id") - 1).alias("place_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return p.join(q, "place_id").select("place_id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 1).alias("dist_m"))


@query("dwithin", "SELECT a.place_id, b.nbi_id, round(" + HAV.format(a="a", b="b") + ", 1) AS dist_m FROM {v_places} a JOIN {v_bridges} b ON " + HAV.format(a="a", b="b") + " <= 60000")
def dwithin(spark, sf):
    d = spatial.dwithin(carrier(spark, sf, "v_bridges").select("nbi_id", "lon", "lat"), carrier(spark, sf, "v_places").select("place_id", "lon", "lat"), 60_000.0, digits=1)
    return d.select("r.place_id", "l.nbi_id", "dist_m")


@query("nearest_within", "SELECT place_id, nbi_id, dist_m FROM (SELECT a.place_id, b.nbi_id, round(d, 1) AS dist_m, row_number() OVER (PARTITION BY a.place_id ORDER BY d, b.nbi_id) AS n FROM {v_places} a JOIN LATERAL (SELECT nbi_id, lon, lat, " + HAV.format(a="a", b="b") + " AS d FROM {v_bridges} b) b ON d <= 80000) t WHERE n = 1")
def nearest_within(spark, sf):
    d = spatial.nearest_within(carrier(spark, sf, "v_places").select("place_id", "lon", "lat"), carrier(spark, sf, "v_bridges").select("nbi_id", "lon", "lat"), 80_000.0, "place_id", "nbi_id")
    return d.select("place_id", F.col("r.nbi_id").alias("nbi_id"), F.round("dist_m", 1).alias("dist_m"))


@query("nearest_k", "SELECT nbi_id, rank, place_id, dist_m FROM (SELECT a.nbi_id, b.place_id, round(d, 1) AS dist_m, CAST(row_number() OVER (PARTITION BY a.nbi_id ORDER BY d, b.place_id) AS INTEGER) AS rank FROM {v_bridges} a JOIN LATERAL (SELECT place_id, lon, lat, " + HAV.format(a="a", b="b") + " AS d FROM {v_places} b) b ON true) t WHERE rank <= 3")
def nearest_k(spark, sf):
    d = spatial.nearest(carrier(spark, sf, "v_bridges").select("nbi_id", "lon", "lat"), carrier(spark, sf, "v_places").select("place_id", "lon", "lat"), "nbi_id", "place_id", k=3, start_m=400_000.0)
    return d.select("nbi_id", "rank", "place_id", F.round("dist_m", 1).alias("dist_m"))


@query("geohash", """
    WITH c AS (SELECT nbi_id, CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 131072) AS BIGINT) AS y FROM {v_bridges})
    SELECT nbi_id, array_to_string(list_transform(range(0, 7), lambda k: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(list_sum(list_transform(range(5 * k, 5 * k + 5), lambda b: (CASE WHEN b % 2 = 0 THEN (x >> CAST(17 - b // 2 AS INTEGER)) & 1 ELSE (y >> CAST(16 - b // 2 AS INTEGER)) & 1 END) << CAST(4 - (b - 5 * k) AS INTEGER))) AS BIGINT) + 1, 1)), '') AS hash FROM c""")
def geohash(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("hash"))


@query("density_grid", "SELECT CAST(round(lon / 5) AS BIGINT) AS gx, CAST(round(lat / 5) AS BIGINT) AS gy, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM {v_bridges} GROUP BY 1, 2")
def density_grid(spark, sf):
    return spatial.density_grid(carrier(spark, sf, "v_bridges"), 5.0).select("gx", "gy", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _lines(spark, sf):
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    x, y = F.col("lon"), F.col("lat")
    return carrier(spark, sf, "v_places").select("place_id", "lon", "lat", F.array(pt(x, y), pt(x + 0.3, y), pt(x + 0.3, y + 0.4)).alias("line"))


@query("line_length", "SELECT a.place_id, round(" + HAV.format(a="a", b="b") + " + " + HAV.format(a="b", b="c") + ", 1) AS length_m FROM {v_places} a JOIN (SELECT place_id, lon + 0.3::DOUBLE AS lon, lat FROM {v_places}) b ON a.place_id = b.place_id JOIN (SELECT place_id, lon + 0.3::DOUBLE AS lon, lat + 0.4::DOUBLE AS lat FROM {v_places}) c ON a.place_id = c.place_id")
def line_length(spark, sf):
    return _lines(spark, sf).select("place_id", F.round(geo.line_length_m(F.col("line")), 1).alias("length_m"))


@query("line_locate", "SELECT place_id, round((0.3::DOUBLE + 0.2::DOUBLE) / 0.7::DOUBLE, 6) AS fraction FROM {v_places}")
def line_locate(spark, sf):
    return _lines(spark, sf).select("place_id", F.round(geo.locate(F.col("line"), F.col("lon") + 0.5, F.col("lat") + 0.2), 6).alias("fraction"))


@query("line_cut", "SELECT place_id, round(lon + 0.15::DOUBLE, 6) AS x0, round(lat, 6) AS y0, round(lon + 0.3::DOUBLE, 6) AS x1, round(lat + 0.2::DOUBLE, 6) AS y1, 3 AS n FROM {v_places}")
def line_cut(spark, sf):
    c = geo.cut(F.col("line"), F.lit(0.15 / 0.7), F.lit(0.5 / 0.7))
    return _lines(spark, sf).select("place_id", c.alias("c")).select("place_id", *[F.round(F.element_at("c", i)[f], 6).alias(n) for n, i, f in (("x0", 1, "lon"), ("y0", 1, "lat"), ("x1", -1, "lon"), ("y1", -1, "lat"))], F.size("c").alias("n"))


@query("map_tiles", """
    WITH m AS (SELECT 6378137.0::DOUBLE * radians(lon) AS x, 6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2)) AS y FROM {v_bridges})
    SELECT CAST(floor((x + 20037508.342789244::DOUBLE) / 40075016.685578488::DOUBLE * 64) AS INTEGER) AS tx, CAST(floor((20037508.342789244::DOUBLE - y) / 40075016.685578488::DOUBLE * 64) AS INTEGER) AS ty, count(*) AS n FROM m GROUP BY 1, 2""")
def map_tiles(spark, sf):
    t = carrier(spark, sf, "v_bridges").select(geo.tile_of(F.col("lon"), F.col("lat"), 6).alias("t"))
    return t.groupBy(F.col("t.x").alias("tx"), F.col("t.y").alias("ty")).agg(F.count(F.lit(1)).alias("n"))


# ---- graph -------------------------------------------------------------------------------------------------


@query("components", """
    WITH RECURSIVE e AS (SELECT u, v FROM {v_edges}), b AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e),
    r(a, b) AS (SELECT a, a FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a), c AS (SELECT a AS node_id, min(b) AS root FROM r GROUP BY a), s AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS component FROM c GROUP BY root)
    SELECT node_id, component FROM c JOIN s ON c.root = s.root""")
def component_labels(spark, sf):
    return graph.ranked_components(carrier(spark, sf, "v_edges"))


#: Least distances between all nodes, in DuckDB.
NEAREST = """r(o, n, d) USING KEY (o, n) AS (SELECT n, n, 0.0::DOUBLE FROM nodes UNION
      SELECT r.o, b.b, min(r.d + b.w) FROM r JOIN b ON r.n = b.a LEFT JOIN recurring.r AS q ON q.o = r.o AND q.n = b.b WHERE q.d IS NULL OR r.d + b.w < q.d GROUP BY r.o, b.b)"""


@query("shortest_path", f"""
    WITH RECURSIVE b AS (SELECT u AS a, v AS b, length_m AS w FROM {{v_edges}} UNION ALL SELECT v, u, length_m FROM {{v_edges}}), nodes AS (SELECT DISTINCT a AS n FROM b), {NEAREST}
    SELECT o AS pair_id, d AS distance FROM r WHERE n = o + 37""")
def shortest_path(spark, sf):
    """A pair from every node to the one 37 numbers on, where there is one, over all edges."""
    e = carrier(spark, sf, "v_edges")
    nodes = e.select("u").union(e.select("v")).distinct()
    pairs = nodes.join(nodes.select((F.col("u") - 37).alias("u"), F.col("u").alias("goal")), "u")
    return graph.shortest_paths(e, pairs.select(F.col("u").alias("pair_id"), F.col("u").alias("origin"), "goal")).select("pair_id", "distance")


@query("route_trips", f"""
    WITH RECURSIVE e AS (SELECT edge_id, u, v, length_m, edge_id % 11 = 0 AS bad FROM {{v_edges}}), nodes AS (SELECT u AS n FROM e UNION SELECT v FROM e),
    b AS (SELECT u AS a, v AS b, length_m AS w FROM e WHERE NOT bad UNION ALL SELECT v, u, length_m FROM e WHERE NOT bad), {NEAREST},
    t AS (SELECT edge_id AS pair_id, edge_id AS oe, CASE WHEN edge_id % 5 = 0 THEN edge_id ELSE edge_id + 20 END AS ge FROM e),
    s AS (SELECT pair_id, n, c FROM t JOIN (SELECT edge_id, u AS n, 0.25::DOUBLE * length_m AS c FROM e UNION ALL SELECT edge_id, v, 0.75::DOUBLE * length_m FROM e) x ON x.edge_id = oe WHERE ge <> oe),
    g AS (SELECT pair_id, n, c FROM t JOIN (SELECT edge_id, u AS n, 0.5::DOUBLE * length_m AS c FROM e UNION ALL SELECT edge_id, v, 0.5::DOUBLE * length_m FROM e) x ON x.edge_id = ge WHERE ge <> oe),
    far AS (SELECT s.pair_id, min(s.c + d + g.c) AS distance FROM s JOIN g ON s.pair_id = g.pair_id JOIN r ON r.o = s.n AND r.n = g.n GROUP BY s.pair_id),
    met AS (SELECT DISTINCT s.pair_id FROM s JOIN r ON r.o = s.n JOIN (SELECT u AS n FROM e WHERE bad UNION SELECT v FROM e WHERE bad) x ON x.n = r.n)
    SELECT t.pair_id, CASE WHEN w.edge_id IS NULL THEN 'not_on_network' WHEN oe = ge THEN CASE WHEN w.bad THEN 'no_compliant_path' ELSE 'ok' END WHEN far.distance IS NOT NULL THEN 'ok' WHEN met.pair_id IS NOT NULL THEN 'no_compliant_path' ELSE 'no_path' END AS status,
      CASE WHEN oe = ge THEN CASE WHEN NOT w.bad THEN 0.25::DOUBLE * w.length_m END ELSE far.distance END AS distance
    FROM t LEFT JOIN e w ON w.edge_id = ge LEFT JOIN far ON far.pair_id = t.pair_id LEFT JOIN met ON met.pair_id = t.pair_id""")
def route_trips(spark, sf):
    """A trip from a quarter of every edge to the middle of the edge 20 numbers on, or of its own, past closed edges."""
    e = carrier(spark, sf, "v_edges")
    k = F.col("edge_id")
    limits = e.select(k, (k % 11 == 0).alias("closed"), F.lit(False).alias("hazmat_blocked"), F.lit(None).cast("double").alias("min_clearance_in"), F.lit(None).cast("double").alias("max_weight_lb"))
    trips = e.select(k.alias("pair_id"), k.alias("o_edge"), F.lit(0.25).alias("o_frac"), F.when(k % 5 == 0, k).otherwise(k + 20).alias("g_edge"), F.lit(0.5).alias("g_frac"))
    return routing.routes(graph.allowed(e, limits, graph.Vehicle()), trips).select("pair_id", "status", "distance")


@query("mainland_edges", """
    WITH RECURSIVE b AS (SELECT u AS a, v AS b FROM {v_edges} UNION SELECT v, u FROM {v_edges}), r(a, b) AS (SELECT a, a FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a),
    c AS (SELECT a, min(b) AS root FROM r GROUP BY a), m AS (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT edge_id FROM {v_edges} JOIN c ON a = u WHERE root = (SELECT root FROM m)""")
def mainland_edges(spark, sf):
    e = carrier(spark, sf, "v_edges")
    return graph.mainland_edges(e, graph.ranked_components(e)).select("edge_id")


@query("nodes_edges", """
    WITH l AS (SELECT edge_id, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v),
    p AS (SELECT x0 AS lon, y0 AS lat FROM l UNION ALL SELECT x1, y1 FROM l) SELECT row_number() OVER (ORDER BY lon, lat) AS node_id, round(lon, 6) AS lon, round(lat, 6) AS lat, count(*) AS degree FROM p GROUP BY lon, lat""")
def nodes_edges(spark, sf):
    return graph.build_nodes(_graph_lines(spark, sf)).select(F.col("node_id").cast("bigint").alias("node_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "degree")


def _graph_lines(spark, sf):
    p = carrier(spark, sf, "v_places").select("place_id", F.struct("lon", "lat").alias("p"))
    e = carrier(spark, sf, "v_edges")
    return e.join(p.select(F.col("place_id").alias("u"), F.col("p").alias("a")), "u").join(p.select(F.col("place_id").alias("v"), F.col("p").alias("b")), "v").select("edge_id", F.array("a", "b").alias("line"))


@query("edge_limits", """
    WITH p AS (SELECT nbi_id % 50 AS edge_id, nbi_id, facility, posting, CASE WHEN facility IS NULL THEN NULL ELSE facility = 'I-35 SB' END AS carries, round((4 + (size % 10) / 10.0::DOUBLE) * 39.3700787::DOUBLE, 1) AS over, round((4 + (size % 7) / 10.0::DOUBLE) * 39.3700787::DOUBLE, 1) AS under, size FROM {v_bridges})
    SELECT edge_id, min(CASE WHEN carries THEN CASE WHEN size % 3 <> 0 THEN over END ELSE CASE WHEN size % 5 <> 0 THEN under END END) AS min_clearance_in,
      min(CASE WHEN carries IS NOT FALSE AND posting = 'P' THEN round(size * 2204.62::DOUBLE, 0) END) AS max_weight_lb, coalesce(bool_or(carries IS NOT FALSE AND posting = 'K'), false) AS closed, count(*) AS structures,
      count(*) FILTER (WHERE size % 3 = 0 AND size % 5 = 0) AS structures_unknown_clearance FROM p GROUP BY edge_id""")
def edge_limits(spark, sf):
    b, s = carrier(spark, sf, "v_bridges"), F.col("size")
    m = lambda n: (4 + (s % n) / 10.0).cast("string")
    pairs = b.select(
        (F.col("nbi_id") % 50).alias("edge_id"), F.lit("I").alias("sign_type"), F.lit("35").alias("sign_num"), F.lit("bridge").alias("kind"), "facility", F.when(s % 3 != 0, m(10)).otherwise("99.99").alias("over10"),
        F.lit(None).cast("string").alias("over53"), F.when(s % 5 != 0, m(7)).otherwise("0").alias("under54"), F.coalesce("posting", F.lit("-")).alias("posting"), s.cast("string").alias("operating_rating"), F.lit(None).cast("double").alias("clearance_in"), F.lit(None).cast("boolean").alias("hazmat"),
    )
    return graph.edge_limits(pairs).drop("hazmat_blocked")


@query("blocked", "SELECT nbi_id, CASE WHEN posting = 'K' THEN 'structure closed to all traffic' WHEN clearance_in < 150 THEN 'clearance ' || CAST(CAST(clearance_in AS BIGINT) AS VARCHAR) || '\" below vehicle 150\"' END AS why FROM {v_bridges}")
def blocked(spark, sf):
    why = graph.blocked_for(graph.Vehicle(height_in=150.0), F.col("posting") == "K", F.lit(False), F.col("clearance_in"), F.lit(None).cast("double"))
    return carrier(spark, sf, "v_bridges").select("nbi_id", why.alias("why"))


# ---- conflation --------------------------------------------------------------------------------------------


PAIRS = """
    WITH n AS (SELECT 'a' AS s, rid, lon, lat, brand, regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') AS nm FROM {v_src_a} UNION ALL SELECT 'b', rid, lon, lat, brand, trim(regexp_replace(regexp_replace(lower(name), '#\\s*\\d+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) FROM {v_src_b}),
    g AS (SELECT *, list_distinct(flatten(list_transform(list_filter(string_split(nm, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM n),
    p AS (SELECT a.rid AS o, b.rid AS f, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS sim, """ + HAV.format(a="a", b="b") + """ AS d, CASE WHEN a.brand = b.brand THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM g a JOIN g b ON a.s = 'a' AND b.s = 'b' AND abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01),
    k AS (SELECT o, f, sim, d, 0.60::DOUBLE*sim + 0.25::DOUBLE*(1.0::DOUBLE - least(d, 150.0::DOUBLE)/150.0::DOUBLE) + 0.15::DOUBLE*bonus AS score FROM p WHERE d <= 150 AND sim > 0.3::DOUBLE)"""
#: Pairs taken one by one, the best score first, unless an end is taken; and the rows that are gray.
MATCHED = PAIRS + """,
    q AS (SELECT list_reduce(list_prepend({'o': NULL::BIGINT, 'f': NULL::BIGINT, 'score': NULL::DOUBLE}, coalesce(list({'o': o::BIGINT, 'f': f::BIGINT, 'score': score} ORDER BY score DESC, o, f), [])), lambda t, x: CASE WHEN x.o IS NULL OR list_contains(t.os, x.o) OR list_contains(t.fs, x.f) THEN t
      ELSE {'os': list_append(t.os, x.o), 'fs': list_append(t.fs, x.f), 'ss': list_append(t.ss, x.score)} END, {'os': []::BIGINT[], 'fs': []::BIGINT[], 'ss': []::DOUBLE[]}) AS t FROM k WHERE score >= 0.85::DOUBLE),
    m AS (SELECT unnest(t.os) AS o, unnest(t.fs) AS f, unnest(t.ss) AS score FROM q),
    h AS (SELECT o, f FROM k WHERE score > 0.55::DOUBLE AND score < 0.85::DOUBLE UNION ALL SELECT k.o, k.f FROM k LEFT JOIN m ON m.o = k.o AND m.f = k.f WHERE k.score >= 0.85::DOUBLE AND m.o IS NULL),
    z AS (SELECT 'a' AS src, o AS rid FROM h UNION SELECT 'b', f FROM h)"""
MERGED = MATCHED + """,
    a AS (SELECT s.*, EXISTS (SELECT 1 FROM z WHERE z.src = 'a' AND z.rid = s.rid) AS gray FROM {v_src_a} s), b AS (SELECT s.*, EXISTS (SELECT 1 FROM z WHERE z.src = 'b' AND z.rid = s.rid) AS gray FROM {v_src_b} s),
    x AS (SELECT o, f, CASE WHEN a.conf >= 0.5 THEN a.name ELSE b.name END AS name, CASE WHEN a.conf >= 0.5 THEN a.lon ELSE b.lon END AS lon, CASE WHEN a.conf >= 0.5 THEN a.lat ELSE b.lat END AS lat,
        CASE WHEN a.conf >= 0.5 THEN coalesce(a.brand, b.brand) ELSE coalesce(b.brand, a.brand) END AS brand, CASE WHEN a.conf >= 0.5 THEN coalesce(a.website, b.website) ELSE coalesce(b.website, a.website) END AS website,
        greatest(a.observed_at, b.observed_at) AS observed_at, a.conf AS conf, 'merged' AS src, a.gray OR b.gray AS gray FROM m JOIN a ON a.rid = o JOIN b ON b.rid = f
      UNION ALL SELECT rid, NULL, name, lon, lat, brand, website, observed_at, conf, 'a', gray FROM a WHERE rid NOT IN (SELECT o FROM m)
      UNION ALL SELECT NULL, rid, name, lon, lat, brand, website, observed_at, NULL, 'b', gray FROM b WHERE rid NOT IN (SELECT f FROM m))"""
COLLIDED = MERGED + """,
    w AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS nm, CAST(floor((lon + 180) / 360 * 262144) AS BIGINT) AS gx, CAST(floor((lat + 90) / 180 * 131072) AS BIGINT) AS gy FROM x),
    v AS (SELECT *, count(*) OVER (PARTITION BY nm, gx, gy) AS n, count(*) FILTER (WHERE src = 'a') OVER (PARTITION BY nm, gx, gy) AS na, count(*) FILTER (WHERE src = 'b') OVER (PARTITION BY nm, gx, gy) AS nb,
        row_number() OVER (PARTITION BY nm, gx, gy ORDER BY CASE src WHEN 'merged' THEN 0 ELSE 1 END, observed_at DESC NULLS LAST, o NULLS LAST, f NULLS LAST) AS i FROM w),
    y AS (SELECT o, f, name, brand, website, observed_at, src, gray, CASE WHEN n > 1 THEN 'cell_name_collision' END AS cell_flag, n - 1 AS dropped FROM v WHERE i = 1 AND NOT (n = 2 AND na = 1 AND nb = 1)
      UNION ALL SELECT a.o, b.f, CASE WHEN a.conf >= 0.5 THEN a.name ELSE b.name END, CASE WHEN a.conf >= 0.5 THEN coalesce(a.brand, b.brand) ELSE coalesce(b.brand, a.brand) END, CASE WHEN a.conf >= 0.5 THEN coalesce(a.website, b.website) ELSE coalesce(b.website, a.website) END,
        greatest(a.observed_at, b.observed_at), 'merged', a.gray OR b.gray, 'cell_name_merge', 0 FROM v a JOIN v b ON a.nm = b.nm AND a.gx = b.gx AND a.gy = b.gy AND a.src = 'a' AND b.src = 'b' AND a.n = 2 AND a.na = 1 AND a.nb = 1)"""


@query("conflate_pairs", PAIRS + """ SELECT o, f, round(sim, 6) AS name_sim, round(d, 1) AS dist_m, CASE WHEN score >= 0.85::DOUBLE THEN 'merge' WHEN score <= 0.55::DOUBLE THEN 'distinct' ELSE 'gray' END AS band FROM k""")
def conflate_pairs(spark, sf):
    return _shown(_pairs(spark, sf))


@query("conflate_match", MATCHED + " SELECT o, f, round(score, 6) AS score FROM m")
def conflate_match(spark, sf):
    return conflate.match_one_to_one(_pairs(spark, sf).where("band = 'merge'")).select("o", "f", F.round("score", 6).alias("score"))


@query("conflate_merge", MERGED + " SELECT o, f, name, round(lon, 6) AS lon, round(lat, 6) AS lat, brand, website, observed_at, src, gray FROM x")
def conflate_merge(spark, sf):
    return _merged(spark, sf).select("o", "f", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "brand", "website", "observed_at", "src", "gray")


@query("collisions", COLLIDED + " SELECT o, f, name, brand, website, observed_at, src, gray, cell_flag, dropped FROM y")
def collisions(spark, sf):
    return conflate.resolve_collisions(_merged(spark, sf)).select("o", "f", "name", "brand", "website", "observed_at", "src", "gray", "cell_flag", "dropped")


@query("conflate_gray", MATCHED + " SELECT src, rid FROM z")
def conflate_gray(spark, sf):
    p = checkpoint(_pairs(spark, sf))
    return conflate.gray_ids(p, conflate.match_one_to_one(p.where("band = 'merge'")))


@query("publish_businesses", COLLIDED + """
    SELECT o, f, round(100.0::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE * 0.65::DOUBLE + 0.25::DOUBLE * CASE WHEN observed_at IS NULL THEN 0.0::DOUBLE ELSE pow(0.5::DOUBLE, (31 - observed_at)::DOUBLE / 180.0::DOUBLE) END
        + 0.20::DOUBLE * (3 * (name IS NOT NULL)::INT + 2 * (brand IS NOT NULL)::INT + (website IS NOT NULL)::INT) / 6.0::DOUBLE + 0.20::DOUBLE * CASE WHEN src = 'merged' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)), 0)::INT AS confidence,
      concat_ws(',', CASE WHEN gray THEN 'dedup_gray_zone' END, cell_flag) AS flags FROM (SELECT * REPLACE (CASE WHEN observed_at > 31 THEN 31 ELSE observed_at END AS observed_at) FROM y)""")
def publish_businesses(spark, sf):
    rows = conflate.resolve_collisions(_merged(spark, sf))
    rows = rows.withColumn("observed_at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("observed_at").cast("int")).cast("timestamp_ntz"))
    out = conflate.publish(rows, now(), {"name": 3, "brand": 2, "website": 1})
    return out.select("o", "f", "confidence", F.array_join("flags", ",").alias("flags"))


def _pairs(spark, sf):
    return conflate.candidate_pairs(carrier(spark, sf, "v_src_a"), carrier(spark, sf, "v_src_b"))


def _shown(p):
    return p.select("o", "f", F.round("name_sim", 6).alias("name_sim"), F.round("dist_m", 1).alias("dist_m"), "band")


def _merged(spark, sf):
    p = checkpoint(_pairs(spark, sf))
    return conflate.merge(carrier(spark, sf, "v_src_a"), carrier(spark, sf, "v_src_b"), conflate.match_one_to_one(p.where("band = 'merge'")), p)


# ---- tracking ----------------------------------------------------------------------------------------------


@query("ping_validation", f"SELECT ping_id, CASE WHEN ping_id % 50 = 0 THEN 'out_of_bounds' WHEN speed_kph < 0 OR speed_kph > 200 THEN 'bad_speed' WHEN observed_at > TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 120 SECONDS THEN 'in_future' END AS reason FROM {{v_pings}}")
def ping_validation(spark, sf):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return carrier(spark, sf, "v_pings").select("ping_id", tracking.ping_reason(at, lon=F.when(F.col("ping_id") % 50 == 0, F.lit(200.0)).otherwise(F.col("lon"))).alias("reason"))


@query("ping_dedup", "SELECT device_id, observed_at, count(*) AS n FROM (SELECT DISTINCT device_id, observed_at FROM (SELECT device_id, observed_at FROM {v_pings} UNION ALL SELECT device_id, observed_at FROM {v_pings} WHERE ping_id % 3 = 0) x) y GROUP BY device_id, observed_at")
def ping_dedup(spark, sf):
    p = carrier(spark, sf, "v_pings")
    return tracking.dedup_fixes(p.unionByName(p.where("ping_id % 3 = 0"))).groupBy("device_id", "observed_at").agg(F.count(F.lit(1)).alias("n"))


@query("device_last", """
    SELECT device_id, observed_at, lon, lat, ping_count FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY observed_at DESC, ping_id DESC) AS n, count(*) OVER (PARTITION BY device_id) AS ping_count FROM {v_pings}) t WHERE n = 1""")
def device_last(spark, sf):
    return tracking.last_state(carrier(spark, sf, "v_pings")).select("device_id", "observed_at", "lon", "lat", "ping_count")


@query("stale_flag", "SELECT device_id, max(observed_at) >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 180 SECONDS AS live FROM {v_pings} GROUP BY device_id")
def stale_flag(spark, sf):
    return tracking.stale_flag(tracking.last_state(carrier(spark, sf, "v_pings")), F.lit("2024-01-30 20:00:00").cast("timestamp_ntz")).select("device_id", "live")


@query("trail", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY observed_at DESC, ping_id DESC) AS n, count(*) OVER (PARTITION BY device_id) AS available FROM {v_pings} WHERE observed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2880 MINUTES)
    SELECT device_id, ping_id, CAST(row_number() OVER (PARTITION BY device_id ORDER BY observed_at, ping_id) AS INTEGER) AS seq, available, available > 5 AS truncated FROM r WHERE n <= 5""")
def trail(spark, sf):
    t = tracking.trail(carrier(spark, sf, "v_pings"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 2880, 5)
    return t.select("device_id", "ping_id", "seq", "available", "truncated")


# ---- operations and prices ---------------------------------------------------------------------------------


@query("enqueue_due", f"""
    WITH ok AS (SELECT source_id, max(started_at) AS t FROM {{v_runs}} WHERE status IN ('success', 'skipped_unchanged', 'skipped_no_key') GROUP BY source_id),
    bad AS (SELECT r.source_id, max(started_at) AS t, count(*) AS k FROM {{v_runs}} r LEFT JOIN ok ON ok.source_id = r.source_id WHERE status IN ('failed', 'gated') AND (ok.t IS NULL OR started_at > ok.t) GROUP BY r.source_id)
    SELECT s.source_id, coalesce(k, 0) AS streak, (ok.t IS NULL OR ok.t < {NOW} - INTERVAL 1500 MINUTES) AND (bad.t IS NULL OR bad.t < {NOW} - to_minutes(CAST(least(360, 5 * (1 << CAST(least(greatest(coalesce(k, 0) - 1, 0), 7) AS INTEGER))) AS BIGINT))) AS due
    FROM (SELECT DISTINCT source_id FROM {{v_runs}}) s LEFT JOIN ok ON ok.source_id = s.source_id LEFT JOIN bad ON bad.source_id = s.source_id""")
def enqueue_due(spark, sf):
    from haulspark.operators.ops import due_sources

    r = carrier(spark, sf, "v_runs")
    sources = r.select("source_id").distinct().withColumn("schedule_minutes", F.lit(1500)).withColumn("enabled", F.lit(True))
    return due_sources(sources, r, now()).select("source_id", "streak", "due")


@query("freshness", f"SELECT source_id, CASE WHEN max(started_at) IS NULL THEN 'n-a' WHEN epoch_us({NOW}) - epoch_us(max(started_at)) > 24.5::DOUBLE * 3600e6 THEN 'STALE' WHEN epoch_us({NOW}) - epoch_us(max(started_at)) >= 0.75::DOUBLE * 24.5::DOUBLE * 3600e6 THEN 'warn' ELSE 'fresh' END AS state FROM {{v_runs}} WHERE status = 'success' GROUP BY source_id")
def freshness(spark, sf):
    from haulspark.operators.ops import freshness_state

    last = carrier(spark, sf, "v_runs").where("status = 'success'").groupBy("source_id").agg(F.max("started_at").alias("t"))
    return last.select("source_id", freshness_state(F.col("t"), now(), F.lit(24.5)).alias("state"))


@query("breaker_state", """
    WITH o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM {v_runs}), g AS (SELECT source_id, min(n) AS g FROM o WHERE status <> 'failed' GROUP BY source_id)
    SELECT g.source_id, g - 1 AS consecutive_failures, CASE WHEN g - 1 >= 2 THEN 'open' ELSE 'closed' END AS state FROM g""")
def breaker_state(spark, sf):
    from haulspark.operators.ops import breaker

    return breaker(carrier(spark, sf, "v_runs"), threshold=2)


@query("ops_watch", """
    SELECT 'repeated_failures' AS alert, source_id, count(*) AS n FROM {v_runs} WHERE status = 'failed' AND started_at >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY source_id HAVING count(*) >= 3
    UNION ALL SELECT 'never_ok', source_id, count(*) FROM {v_runs} GROUP BY source_id HAVING count(*) FILTER (WHERE status = 'success') = 0
    UNION ALL SELECT 'backlog', source_id, count(*) FROM {v_runs} WHERE status = 'gated' GROUP BY source_id HAVING count(*) > 100""")
def ops_watch(spark, sf):
    from haulspark.operators.ops import watch

    return watch(carrier(spark, sf, "v_runs"), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 3, 100)


both("weekly_activity", "SELECT CAST(date_trunc('week', started_at) AS DATE) AS week_of, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS ok, sum(rows_published) FILTER (WHERE status = 'success') AS published_ FROM {v_runs} GROUP BY CAST(date_trunc('week', started_at) AS DATE)" .replace("sum(rows_published)", "CAST(sum(rows_published)").replace("'success') AS published_", "'success') AS BIGINT) AS published_rows"))
both("coverage_meta", "SELECT source_id, min(started_at) AS first_run, max(started_at) AS last_run, count(*) AS runs, CAST(sum(rows_published) AS BIGINT) AS total_rows FROM {v_runs} GROUP BY source_id")
both("inventory", "SELECT 'places' AS layer, count(*) AS held, count(category) AS drawn FROM {v_places} UNION ALL SELECT 'bridges', count(*), count(clearance_in) FROM {v_bridges} UNION ALL SELECT 'edges', count(*), count(length_m) FROM {v_edges}")


@query("registry_sync", "SELECT coalesce(a.k, b.k) AS source_id, CASE WHEN a.k IS NULL THEN 'disable' WHEN b.k IS NULL THEN 'insert' WHEN a.v IS DISTINCT FROM b.v THEN 'update' ELSE 'keep' END AS action FROM (SELECT place_id AS k, category AS v FROM {v_places} WHERE place_id % 4 <> 0) a FULL OUTER JOIN (SELECT place_id AS k, CASE WHEN place_id % 5 = 0 THEN 'old' ELSE category END AS v FROM {v_places} WHERE place_id % 3 <> 0) b ON a.k = b.k")
def registry_sync(spark, sf):
    from haulspark.operators.ops import sync_registry

    p = carrier(spark, sf, "v_places").select(F.col("place_id").alias("source_id"), "category")
    return sync_registry(p.where("source_id % 4 <> 0"), p.where("source_id % 3 <> 0").withColumn("category", F.when(F.col("source_id") % 5 == 0, "old").otherwise(F.col("category"))), ["category"]).select("source_id", "action")


@query("covered_states", """
    SELECT s.state, count(*) AS feeds FROM (SELECT state, place_id FROM {v_places} WHERE has_diesel IS NOT FALSE) s WHERE s.place_id % 4 <> 3 GROUP BY s.state""")
def covered_states(spark, sf):
    return carrier(spark, sf, "v_places").where(~F.col("has_diesel").eqNullSafe(False) & (F.col("place_id") % 4 != 3)).groupBy("state").agg(F.count(F.lit(1)).alias("feeds"))


PADD = {"CT": "PADD1A", "NY": "PADD1B", "FL": "PADD1C", "OH": "PADD2", "TX": "PADD3", "CO": "PADD4", "WA": "PADD5_EX_CA", "CA": "CA"}


@query("price_region_chain", """
    SELECT id, CASE WHEN m = 0 THEN 'PADD3' WHEN m = 1 THEN 'PADD1' WHEN m = 2 THEN 'CA' WHEN m = 3 THEN 'PADD5' WHEN m = 4 THEN NULL END AS region FROM (SELECT p_partkey AS id, p_partkey % 5 AS m FROM {part}) t""")
def price_region_chain(spark, sf):
    from haulspark.operators.ops import price_region

    m = F.col("p_partkey") % 5
    state = F.when(m == 0, "TX").when(m == 1, "NY").when(m == 2, "CA").when(m == 3, "WA").otherwise("ZZ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), price_region(state, ["US", "PADD1", "PADD3", "PADD5", "CA"]).alias("region"))


#: The edges in straight pieces of a quarter of a degree, and how far a place is from each, in DuckDB.
PIECES = """l AS (SELECT edge_id, e.u, a.lon AS x0, a.lat AS y0, b.lon - a.lon AS dx, b.lat - a.lat AS dy, greatest(1, ceil(greatest(abs(b.lon - a.lon), abs(b.lat - a.lat)) / 0.25::DOUBLE)) AS n FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v),
    pieces AS (SELECT edge_id, x0 + dx * i / n AS ax, y0 + dy * i / n AS ay, x0 + dx * (i + 1) / n AS bx, y0 + dy * (i + 1) / n AS cy FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS i FROM l))"""
SHARE = "coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, -((ax - lon) * cos(radians(lat)) * (bx - ax) * cos(radians(lat)) + (ay - lat) * (cy - ay)) / nullif(pow((bx - ax) * cos(radians(lat)), 2) + pow(cy - ay, 2), 0.0::DOUBLE))), 0.0::DOUBLE)"
FROM_PIECE = "2*6371008.8::DOUBLE*asin(sqrt(pow(sin(radians(ay + t * (cy - ay) - lat)/2),2)+cos(radians(lat))*cos(radians(ay + t * (cy - ay)))*pow(sin(radians(ax + t * (bx - ax) - lon)/2),2)))"


@query("station_state", f"""
    WITH {PIECES}, s AS (SELECT nbi_id, lon, lat FROM {{v_bridges}} WHERE nbi_id % 3 = 2 OR (nbi_id % 3 = 1 AND posting IS NULL)),
    d AS (SELECT nbi_id, edge_id, {FROM_PIECE} AS d FROM (SELECT *, {SHARE} AS t FROM s, pieces)),
    m AS (SELECT nbi_id, min(d) AS d FROM d GROUP BY nbi_id), w AS (SELECT d.nbi_id, min(edge_id) AS edge_id FROM d JOIN m ON m.nbi_id = d.nbi_id AND d.d = m.d GROUP BY d.nbi_id)
    SELECT b.nbi_id, CASE WHEN b.nbi_id % 3 = 0 THEN 'TX' WHEN b.nbi_id % 3 = 1 AND posting IS NOT NULL THEN posting ELSE p.state END AS state,
      CASE WHEN b.nbi_id % 3 = 0 THEN 'osm' WHEN b.nbi_id % 3 = 1 AND posting IS NOT NULL THEN 'overture' WHEN p.state IS NOT NULL THEN 'nearest truck route' END AS state_source
    FROM {{v_bridges}} b LEFT JOIN w ON w.nbi_id = b.nbi_id LEFT JOIN l ON l.edge_id = w.edge_id LEFT JOIN {{v_places}} p ON p.place_id = l.u""")
def station_state(spark, sf):
    """The state that a source names, else that of the nearest edge (of its first node)."""
    b, k = carrier(spark, sf, "v_bridges"), F.col("nbi_id")
    own, place = F.when(k % 3 == 0, "TX"), F.when(k % 3 == 1, F.col("posting"))
    s = b.select("nbi_id", "lon", "lat", own.alias("own"), place.alias("place"))
    near = spatial.nearest_line(s.where("own is null and place is null"), _graph_lines(spark, sf), "nbi_id", "edge_id")
    states = carrier(spark, sf, "v_edges").join(carrier(spark, sf, "v_places").select(F.col("place_id").alias("u"), F.col("state").alias("near")), "u").select("edge_id", "near")
    s = s.join(near.join(states, "edge_id").select("nbi_id", "near"), "nbi_id", "left")
    src = F.when(F.col("own").isNotNull(), "osm").when(F.col("place").isNotNull(), "overture").when(F.col("near").isNotNull(), "nearest truck route")
    return s.select("nbi_id", F.coalesce("own", "place", "near").alias("state"), src.alias("state_source"))


@query("snap_candidates", f"""
    WITH RECURSIVE {PIECES}, g AS (SELECT u AS a, v AS b FROM {{v_edges}} UNION SELECT v, u FROM {{v_edges}}), r(a, b) AS (SELECT a, a FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
    c AS (SELECT a AS node, min(b) AS root FROM r GROUP BY a), k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) AS component FROM c GROUP BY root),
    d AS (SELECT nbi_id, lon, lat, edge_id, min(d) AS access_m FROM (SELECT nbi_id, lon, lat, edge_id, {FROM_PIECE} AS d FROM (SELECT *, {SHARE} AS t FROM (SELECT nbi_id, lon, lat FROM {{v_bridges}}) s JOIN pieces ON least(ax, bx) - 0.6 < lon AND greatest(ax, bx) + 0.6 > lon AND least(ay, cy) - 0.3 < lat AND greatest(ay, cy) + 0.3 > lat)) x WHERE d <= 25000 GROUP BY nbi_id, lon, lat, edge_id),
    n AS (SELECT d.*, k.component, x0, y0, dx, dy, row_number() OVER (PARTITION BY nbi_id ORDER BY access_m, d.edge_id) AS n FROM d JOIN l ON l.edge_id = d.edge_id JOIN c ON c.node = l.u JOIN k ON k.root = c.root),
    o AS (SELECT *, row_number() OVER (PARTITION BY nbi_id, component ORDER BY access_m, edge_id) AS q FROM n WHERE n <= 60 OR component = 1)
    SELECT nbi_id, component, edge_id, round(access_m, 1) AS access_m, round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((lon - x0) * dx + (lat - y0) * dy) / nullif(dx * dx + dy * dy, 0.0::DOUBLE))), 0.0::DOUBLE), 6) AS frac FROM o WHERE q = 1""")
def snap_candidates(spark, sf):
    parts = graph.ranked_components(carrier(spark, sf, "v_edges")).select(F.col("node_id").alias("u"), "component")
    lines = _graph_lines(spark, sf).join(carrier(spark, sf, "v_edges").select("edge_id", "u").join(parts, "u").select("edge_id", "component"), "edge_id")
    return graph.snap_candidates(carrier(spark, sf, "v_bridges").select("nbi_id", "lon", "lat"), lines, "nbi_id").select("nbi_id", "component", "edge_id", F.round("access_m", 1).alias("access_m"), F.round("frac", 6).alias("frac"))


@query("window_84d", "SELECT region, week_of, price FROM {v_prices} WHERE week_of >= (SELECT max(week_of) FROM {v_prices}) - 84")
def window_84d(spark, sf):
    p = carrier(spark, sf, "v_prices").select("region", "week_of", "price")
    return p.join(F.broadcast(p.agg(F.max("week_of").alias("newest"))), F.col("week_of") >= F.date_sub("newest", 84)).drop("newest")


both("fill_rate", "SELECT round(100.0 * count(clearance_in) / count(*), 6) AS clearance_pct, round(100.0 * count(facility) / count(*), 6) AS facility_pct FROM {v_bridges}".replace("100.0", "CAST(100 AS DOUBLE)"))
both("column_scan", "SELECT count(o_orderkey) AS k, count(o_custkey) AS c, count(o_totalprice) AS p, count(o_orderdate) AS d FROM {orders}")
