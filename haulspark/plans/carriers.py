"""The reference's entities, carried by the star schema of the test tables.

Each carrier is SQL that Spark and DuckDB both take.  Coordinates are made up, the same on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LON = "CAST(-125 AS DOUBLE)+CAST(({k}*{m})%5800 AS DOUBLE)/CAST(100 AS DOUBLE)"
LAT = "CAST(25 AS DOUBLE)+CAST(({k}*{m})%2400 AS DOUBLE)/CAST(100 AS DOUBLE)"

CARRIERS: dict[str, str] = {
    "v_places": f"""
        SELECT s_suppkey AS place_id, s_name AS name, {LON.format(k='s_suppkey', m=7919)} AS lon, {LAT.format(k='s_suppkey', m=104729)} AS lat, n_name AS state,
          CASE s_suppkey%4 WHEN 0 THEN 'truck_stop' WHEN 1 THEN 'fuel_station' WHEN 2 THEN 'truck_repair' ELSE NULL END AS category,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal >= 5000 END AS has_diesel, s_acctbal AS balance
        FROM {{supplier}} JOIN {{nation}} ON n_nationkey = s_nationkey""",
    "v_bridges": f"""
        SELECT p_partkey AS nbi_id, p_name AS name, {LON.format(k='p_partkey', m=7907)} AS lon, {LAT.format(k='p_partkey', m=104717)} AS lat,
          CASE WHEN p_partkey%4 <> 0 THEN NULL ELSE CAST(120+p_size AS DOUBLE) END AS clearance_in,
          CASE p_partkey%7 WHEN 0 THEN 'P' WHEN 1 THEN 'K' WHEN 2 THEN NULL ELSE 'A' END AS posting,
          CASE p_partkey%5 WHEN 0 THEN 'I-35 SB' WHEN 1 THEN 'CO. RD. E2130' WHEN 2 THEN 'I-355' WHEN 3 THEN NULL ELSE 'US 81' END AS facility,
          p_size AS size, p_brand AS brand, p_retailprice AS price
        FROM {{part}}""",
    "v_runs": """
        SELECT event_id AS run_id, event_type AS source_id, ts AS started_at,
          CASE WHEN event_id%10 < 6 THEN 'success' WHEN event_id%10 = 6 THEN 'skipped_unchanged' WHEN event_id%10 = 7 THEN 'gated' ELSE 'failed' END AS status,
          CAST(floor(value) AS BIGINT) AS rows_published
        FROM {events}""",
    "v_pings": f"""
        SELECT event_id AS ping_id, user_id AS device_id, ts AS observed_at, CASE WHEN event_id%9 = 0 THEN NULL ELSE value END AS speed_kph,
          {LON.format(k='event_id', m=7919)} AS lon, {LAT.format(k='event_id', m=104729)} AS lat
        FROM {{events}}""",
    "v_prices": """
        SELECT n_name AS region, 'diesel' AS product, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_of, CAST(min(o_totalprice) AS DOUBLE) AS price
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
        GROUP BY n_name, CAST(date_trunc('week', o_orderdate) AS DATE)""",
    "v_edges": """
        SELECT s_suppkey*2 AS edge_id, s_suppkey AS u, s_suppkey+1 AS v, CAST(1+(s_suppkey*53)%13 AS DOUBLE) AS length_m
        FROM {supplier} WHERE s_suppkey%10 < 9 AND s_suppkey+1 <= (SELECT max(s_suppkey) FROM {supplier})
        UNION ALL
        SELECT s_suppkey*2+1, s_suppkey, s_suppkey+10, CAST(1+(s_suppkey*37)%11 AS DOUBLE)
        FROM {supplier} WHERE s_suppkey%3 <> 0 AND s_suppkey+10 <= (SELECT max(s_suppkey) FROM {supplier})""",
    "v_src_a": f"""
        SELECT p_partkey AS rid, p_name AS name, {LON.format(k='p_partkey', m=7907)} AS lon, {LAT.format(k='p_partkey', m=104717)} AS lat, p_brand AS brand,
          CASE WHEN p_partkey%3 = 0 THEN NULL ELSE CAST(p_partkey AS VARCHAR(20)) END AS website, p_partkey%40 AS observed_at, CAST((p_partkey%10) AS DOUBLE)/CAST(10 AS DOUBLE) AS conf
        FROM {{part}}""",
    "v_src_b": f"""
        SELECT p_partkey AS rid, CASE p_partkey%3 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), ' #12') ELSE concat('Other ', p_name) END AS name,
          {LON.format(k='p_partkey', m=7907)} AS lon, {LAT.format(k='p_partkey', m=104717)}+CAST(p_partkey%5 AS DOUBLE)/CAST(4000 AS DOUBLE) AS lat,
          CASE WHEN p_partkey%4 = 0 THEN p_brand ELSE NULL END AS brand, CASE WHEN p_partkey%2 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR(20)) END AS website, CASE WHEN p_partkey%8 = 0 THEN NULL ELSE p_partkey%50 END AS observed_at
        FROM {{part}}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """Runs SQL in which {name} stands for a table, a carrier or a given frame."""
    names = set(re.findall(r"\{(\w+)\}", text))
    frames = dict(more)
    for n in names - set(more):
        frames[n] = spark_sql(spark, sf_dir, CARRIERS[n]) if n in CARRIERS else table(spark, sf_dir, n)
    return spark.sql(text, **frames)


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, CARRIERS[name])


def oracle(text: str) -> str:
    """DuckDB's form of a query over {names}: carriers become common table expressions."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    used = [n for n in CARRIERS if f"{{{n}}}" in text]
    ctes = ", ".join(f"{n} AS ({plain(CARRIERS[n])})" for n in used)
    body = plain(text).strip()
    if not ctes:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if re.match(r"WITH\b", body, re.I) else f"WITH {ctes} {body}"
