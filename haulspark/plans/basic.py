"""Queries over predicates, joins, aggregates, windows and sets, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.functions import text as T
from haulspark.operators.numbering import number
from haulspark.plans.carriers import carrier, oracle, spark_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and its DuckDB form over {tables and carriers}."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return put


def both(name: str, text: str) -> None:
    """A query that reads the same in both dialects."""
    QUERIES[name] = lambda spark, sf: spark_sql(spark, sf, text)
    SQL[name] = oracle(text)


# ---- predicates and paging ---------------------------------------------------------------------------------


@query("bridge_low_clearance", """
    SELECT b.nbi_id, b.name, b.clearance_in, b.lon, b.lat, r.r_name AS region_name FROM {v_bridges} b LEFT JOIN {region} r ON r.r_regionkey = b.nbi_id % 7
    WHERE b.lon BETWEEN -110 AND -90 AND b.lat BETWEEN 30 AND 45 AND b.clearance_in < 150 ORDER BY b.nbi_id LIMIT 200 OFFSET 5""")
def bridge_low_clearance(spark, sf):
    b = carrier(spark, sf, "v_bridges").where(F.col("lon").between(-110, -90) & F.col("lat").between(30, 45) & (F.col("clearance_in") < 150))
    r = table(spark, sf, "region").select((F.col("r_regionkey")).alias("k"), F.col("r_name").alias("region_name"))
    return b.join(r, F.col("nbi_id") % 7 == F.col("k"), "left").select("nbi_id", "name", "clearance_in", "lon", "lat", "region_name").orderBy("nbi_id").offset(5).limit(200)


@query("tristate_filter", "SELECT place_id, has_diesel FROM {v_places} WHERE has_diesel IS NOT FALSE AND category IS DISTINCT FROM 'truck_repair'")
def tristate_filter(spark, sf):
    return carrier(spark, sf, "v_places").where(~F.col("has_diesel").eqNullSafe(False) & ~F.col("category").eqNullSafe("truck_repair")).select("place_id", "has_diesel")


@query("closed_filter", "SELECT nbi_id, posting FROM {v_bridges} WHERE posting IS DISTINCT FROM 'K' AND (size >= 10 OR size IS NULL)")
def closed_filter(spark, sf):
    return carrier(spark, sf, "v_bridges").where(~F.col("posting").eqNullSafe("K") & ((F.col("size") >= 10) | F.col("size").isNull())).select("nbi_id", "posting")


@query("ilike_brand", "SELECT nbi_id, name, brand FROM {v_bridges} WHERE brand ILIKE '%rand#1%' OR upper(name) = 'RED WIDGET'")
def ilike_brand(spark, sf):
    return carrier(spark, sf, "v_bridges").where(F.col("brand").ilike("%rand#1%") | (F.upper("name") == "RED WIDGET")).select("nbi_id", "name", "brand")


both("like_escape", r"SELECT event_type, count(*) AS n FROM {events} WHERE event_type LIKE '%' AND NOT event_type LIKE '!_%' ESCAPE '!' GROUP BY event_type")


@query("json_predicate", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 50")


@query("null_reads_unknown", "SELECT nbi_id, coalesce(CAST(posting AS VARCHAR), 'unknown') AS posting, coalesce(facility, 'unknown') AS facility FROM {v_bridges}")
def null_reads_unknown(spark, sf):
    return carrier(spark, sf, "v_bridges").select("nbi_id", T.unknown(F.col("posting")).alias("posting"), T.unknown(F.col("facility")).alias("facility"))


both("nulls_last_page", "SELECT nbi_id, clearance_in FROM {v_bridges} ORDER BY clearance_in DESC NULLS LAST, nbi_id ASC NULLS LAST LIMIT 50 OFFSET 10")
both("topk_importance", "SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 25")


@query("fuzzy_search", """
    WITH g AS (SELECT nbi_id, name, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''),
        lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM {v_bridges}),
    q AS (SELECT ['  r', ' re', 'red', 'ed ', '  w', ' wi', 'wid', 'idg', 'dgi', 'git', 'it '] AS q)
    SELECT nbi_id, round(len(list_intersect(g, q))::DOUBLE / len(list_distinct(list_concat(g, q))), 6) AS similarity FROM g, q
    WHERE len(list_intersect(g, q))::DOUBLE / len(list_distinct(list_concat(g, q))) > 0.3""")
def fuzzy_search(spark, sf):
    sim = T.trigram_similarity(F.col("name"), F.lit("Red widgit"))
    return carrier(spark, sf, "v_bridges").select("nbi_id", sim.alias("s")).where("s > 0.3D").select("nbi_id", F.round("s", 6).alias("similarity"))


RULES = [("narrow", ["NATION_1", "NATION_2"], ["00001", "00002"]), ("steep", ["NATION_2", "NATION_3", "NATION_4"], ["0000"]), ("last", ["NATION_5"], ["supplier"])]


@query("rule_match", """
    WITH r AS (SELECT * FROM (VALUES (1, 'narrow', ['NATION_1', 'NATION_2'], ['00001', '00002']), (2, 'steep', ['NATION_2', 'NATION_3', 'NATION_4'], ['0000']), (3, 'last', ['NATION_5'], ['supplier'])) t(ord, rule, states, pats))
    SELECT place_id, min_by(rule, ord) AS rule FROM {v_places}, r WHERE list_contains(states, state) AND len(list_filter(pats, lambda p: contains(lower(name), p))) > 0 GROUP BY place_id""")
def rule_match(spark, sf):
    rules = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "ord int, rule string, states array<string>, pats array<string>"))  # a curated list
    p = carrier(spark, sf, "v_places")
    hit = F.array_contains("states", F.col("state")) & F.exists("pats", lambda x: F.lower("name").contains(x))
    return p.join(rules.withColumn("s", F.explode("states")), F.col("state") == F.col("s")).where(hit).groupBy("place_id").agg(F.min_by("rule", "ord").alias("rule"))


# ---- joins -------------------------------------------------------------------------------------------------

both("tag_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 150000")
both("endpoint_join", "SELECT e.edge_id, a.name AS from_name, b.name AS to_name FROM {v_edges} e JOIN {v_places} a ON a.place_id = e.u JOIN {v_places} b ON b.place_id = e.v")


@query("latest_per_key", """
    SELECT region, week_of, price FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY week_of DESC) AS n FROM {v_prices}) t WHERE n = 1""")
def latest_per_key(spark, sf):
    return carrier(spark, sf, "v_prices").groupBy("region").agg(F.max(F.struct("week_of", "price")).alias("m")).select("region", "m.week_of", "m.price")


@query("open_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O') AS n_open FROM {customer} c")
def open_count(spark, sf):
    n = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_open"))


@query("anti", "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")
def anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("explode_join", """
    SELECT t.source_id, p.place_id, p.state FROM (SELECT place_id, state, unnest(['overture', 'fsq', category]) AS source_id FROM {v_places}) p JOIN (SELECT unnest(['fsq', 'truck_stop']) AS source_id) t ON t.source_id = p.source_id""")
def explode_join(spark, sf):
    p = carrier(spark, sf, "v_places").select("place_id", "state", F.explode(F.array(F.lit("overture"), F.lit("fsq"), F.col("category"))).alias("source_id"))
    return p.join(F.broadcast(spark.createDataFrame([("fsq",), ("truck_stop",)], "source_id string")), "source_id").select("source_id", "place_id", "state")


@query("ordinal_join", """
    WITH ids AS (SELECT unnest([2, 4, 6, 8, 9, 10, 12, 3]) AS edge_id, generate_subscripts([2, 4, 6, 8, 9, 10, 12, 3], 1) AS seq)
    SELECT seq, e.edge_id, length_m, coalesce(sum(length_m) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_m FROM ids JOIN {v_edges} e ON e.edge_id = ids.edge_id""")
def ordinal_join(spark, sf):
    from haulspark.operators.graph import ordered_path

    path = spark.createDataFrame([(1, [2, 4, 6, 8, 9, 10, 12, 3])], "path_id int, edge_ids array<bigint>")
    return ordered_path(path, carrier(spark, sf, "v_edges")).select(F.col("seq").cast("bigint").alias("seq"), "edge_id", "length_m", "cum_m")


@query("rule_cascade", """
    WITH m AS (
        SELECT p.place_id, b.nbi_id, 1 AS pri, 'same_number' AS rule FROM {v_places} p JOIN {v_bridges} b ON b.nbi_id = p.place_id AND p.place_id % 3 = 0
        UNION ALL SELECT p.place_id, b.nbi_id, 2, 'double' FROM {v_places} p JOIN {v_bridges} b ON b.nbi_id = p.place_id * 2 AND b.clearance_in IS NOT NULL
        UNION ALL SELECT p.place_id, b.nbi_id, 3, 'size' FROM {v_places} p JOIN {v_bridges} b ON b.size = p.place_id % 50 + 1 AND b.nbi_id % 10 = 0),
    r AS (SELECT m.*, b.clearance_in, row_number() OVER (PARTITION BY place_id ORDER BY pri, b.clearance_in DESC NULLS LAST, b.nbi_id) AS n FROM m JOIN {v_bridges} b ON b.nbi_id = m.nbi_id)
    SELECT place_id, nbi_id, rule FROM r WHERE n = 1""")
def rule_cascade(spark, sf):
    p, b = carrier(spark, sf, "v_places").select("place_id"), carrier(spark, sf, "v_bridges").select("nbi_id", "size", "clearance_in")
    rules = [
        (1, "same_number", (F.col("nbi_id") == F.col("place_id")) & (F.col("place_id") % 3 == 0)),
        (2, "double", (F.col("nbi_id") == F.col("place_id") * 2) & F.col("clearance_in").isNotNull()),
        (3, "size", (F.col("size") == F.col("place_id") % 50 + 1) & (F.col("nbi_id") % 10 == 0)),
    ]
    # of the bridges of one size, the one that goes first is all that the last rule can take
    first = F.min(F.struct(F.col("clearance_in").isNull(), -F.col("clearance_in"), "nbi_id", "clearance_in")).alias("b")
    sized = b.where("nbi_id % 10 = 0").groupBy("size").agg(first).select("b.nbi_id", "size", "b.clearance_in")
    m = None
    for pri, name, on in rules:
        x = p.join(sized if name == "size" else b, on).select("place_id", "nbi_id", "clearance_in", F.lit(pri).alias("pri"), F.lit(name).alias("rule"))
        m = x if m is None else m.unionByName(x)
    w = Window.partitionBy("place_id").orderBy("pri", F.desc_nulls_last("clearance_in"), "nbi_id")
    return m.withColumn("n", F.row_number().over(w)).where("n = 1").select("place_id", "nbi_id", "rule")


both("full_outer", """
    SELECT coalesce(a.state, b.state) AS state, a.n AS n_places, b.n AS n_customers
    FROM (SELECT state, count(*) AS n FROM {v_places} GROUP BY state) a FULL OUTER JOIN (SELECT n_name AS state, count(*) AS n FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY n_name) b ON a.state = b.state""")


# ---- aggregates --------------------------------------------------------------------------------------------

both("group_stats", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
both("filter_agg", "SELECT source_id, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('success', 'skipped_unchanged')) AS healthy FROM {v_runs} GROUP BY source_id")
both("bool_or", "SELECT state, bool_or(has_diesel) AS any_diesel, bool_and(has_diesel) AS all_diesel FROM {v_places} GROUP BY state")
both("max_by", "SELECT device_id, max_by(ping_id, observed_at) AS last_ping, max(observed_at) AS observed_at FROM (SELECT device_id, observed_at, max(ping_id) AS ping_id FROM {v_pings} GROUP BY device_id, observed_at) p GROUP BY device_id")


@query("ordered_array", "SELECT state, array_to_string(list(place_id ORDER BY place_id DESC), ',') AS ids, coalesce(array_to_string(list_sort(list(DISTINCT category)), ','), '') AS categories FROM {v_places} GROUP BY state")
def ordered_array(spark, sf):
    return carrier(spark, sf, "v_places").groupBy("state").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("place_id"), asc=False), lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


both("having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 100000")
both("count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus")


@query("record_merge", """
    SELECT l_orderkey, first(l_partkey ORDER BY CASE WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber END, l_partkey) AS base_part, min(l_quantity) AS min_qty, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS kinds
    FROM {lineitem} GROUP BY l_orderkey""")
def record_merge(spark, sf):
    first = F.struct(F.when(F.col("l_linenumber") == 2, 0).otherwise(F.col("l_linenumber")).alias("o"), "l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(first).getField("l_partkey").alias("base_part"), F.min("l_quantity").alias("min_qty"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query("fill_delta", """
    WITH w AS (SELECT week_of, count(*) AS rows_, count(price) FILTER (WHERE price < 50000) AS cheap FROM {v_prices} GROUP BY week_of)
    SELECT week_of, rows_, cheap, cheap - lag(cheap) OVER (ORDER BY week_of) AS delta FROM w""")
def fill_delta(spark, sf):
    w = carrier(spark, sf, "v_prices").groupBy("week_of").agg(F.count(F.lit(1)).alias("rows_"), F.count(F.when(F.col("price") < 50000, 1)).alias("cheap"))
    return w.withColumn("delta", F.col("cheap") - F.lag("cheap").over(Window.orderBy("week_of")))  # a row per week


# ---- windows and sets --------------------------------------------------------------------------------------


@query("surrogate_ids", "SELECT nbi_id, row_number() OVER (ORDER BY lat, lon, nbi_id) AS row_id FROM {v_bridges}")
def surrogate_ids(spark, sf):
    return number(carrier(spark, sf, "v_bridges").select("nbi_id", "lat", "lon"), ["lat", "lon", "nbi_id"], "row_id").select("nbi_id", F.col("row_id").cast("bigint").alias("row_id"))


both("running_sum", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_qty FROM {lineitem}")
both("lead_pieces", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS start_qty, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS end_qty FROM {lineitem}")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM {orders} ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf):
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct((-F.col("o_totalprice")).alias("a"), "o_orderkey"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


both("union_all", "SELECT u AS node FROM {v_edges} UNION ALL SELECT v AS node FROM {v_edges}")


@query("pair_dedup", "SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_m) AS length_m FROM (SELECT u, v, length_m FROM {v_edges} UNION ALL SELECT v, u, length_m + 1 FROM {v_edges}) e GROUP BY least(u, v), greatest(u, v)")
def pair_dedup(spark, sf):
    e = carrier(spark, sf, "v_edges").select("u", "v", "length_m")
    both_ways = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length_m") + 1).alias("length_m")))
    return both_ways.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length_m").alias("length_m"))


@query("set_difference", "SELECT n_name AS state FROM {nation} EXCEPT SELECT state FROM {v_places} WHERE category = 'truck_stop'")
def set_difference(spark, sf):
    have = carrier(spark, sf, "v_places").where("category = 'truck_stop'").select("state")
    return table(spark, sf, "nation").select(F.col("n_name").alias("state")).join(have, "state", "left_anti").distinct()
