"""Repair shops: structural verification, licences, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions import score
from haulspark.functions.text import address_key, company_key, is_nanp, phone10
from haulspark.operators.spatial import dwithin, nearest_within


def verify(shops: DataFrame, area_codes: DataFrame) -> DataFrame:
    """shop_id with every test's outcome, orgs, n_independent, confidence, status and flags.

    ``shops`` has shop_id, name, state, lat, lon, phone, src_confidence, source_names, licence_verified,
    licence_expired, osm_match_id; ``area_codes`` (area_code, area_state) is the numbering plan's list.
    """
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    apart = F.when(~known, F.xxhash64("shop_id"))  # shops without a place are no group
    near = F.when(known, F.count(F.lit(1)).over(Window.partitionBy(F.round("lat", 5), F.round("lon", 5), apart))).otherwise(1)
    s = shops.withColumn("_d", phone10(F.col("phone"))).withColumn("_here", near)
    s = s.join(area_codes.select(F.col("area_code").alias("_ac"), "area_state"), F.substring("_d", 1, 3) == F.col("_ac"), "left")
    coord = F.coalesce((F.col("lon") > -180) & (F.col("lon") < 0) & (F.col("lat") > 15) & (F.col("lat") < 72) & ~((F.abs("lat") < 0.5) & (F.abs("lon") < 0.5)), F.lit(False))
    orgs = score.organisations(F.col("source_names"), F.coalesce("licence_verified", F.lit(False)), F.col("licence_expired"), F.col("osm_match_id"))
    s = s.withColumns({
        "phone_valid": is_nanp(F.col("_d")), "phone_state_ok": F.coalesce(F.col("area_state") == F.col("state"), F.lit(False)), "coord_ok": coord, "cluster_dup": ~coord | (F.col("_here") >= 3),
        "spam_flag": ~F.coalesce(F.col("name").rlike("[A-Za-z]"), F.lit(False)), "source_orgs": orgs, "n_independent": score.independent(orgs),
    })
    give = lambda c, n: F.when(c, n).otherwise(0)
    trust = F.coalesce(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("src_confidence"))) * 40).cast("int"), F.lit(0))
    n = F.col("n_independent")
    points = trust + give(F.col("phone_valid"), 10) + give(F.col("phone_state_ok"), 15) + give(F.col("coord_ok") & ~F.col("cluster_dup"), 15) + F.when(n <= 1, 0).when(n == 2, 12).otherwise(20) - give(F.col("spam_flag"), 40) - give(F.col("cluster_dup"), 15)
    s = s.withColumn("confidence", F.greatest(F.lit(0), F.least(F.lit(100), points)))
    status = (
        F.when(F.col("spam_flag") | ~F.col("coord_ok"), "unverified").when((F.col("confidence") >= 70) & F.col("phone_valid") & ~F.col("cluster_dup") & (n >= 2), "verified").when(F.col("confidence") >= 45, "probable").otherwise("unverified")
    )
    licensed, expired = F.coalesce("licence_verified", F.lit(False)), F.coalesce("licence_expired", F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("cluster_dup"), "shared_coordinate"), F.when((F.coalesce("phone", F.lit("")) != "") & ~F.col("phone_valid"), "phone_malformed"), F.when(F.col("area_state") != F.col("state"), "phone_state_mismatch"), F.when(F.col("spam_flag"), "name_nonlatin_or_blank"),
        F.when(n <= 1, "single_org_source"), F.when(licensed & ~expired, "state_licensed"), F.when(licensed & expired, "licence_expired"), F.when(F.col("osm_match_id").isNotNull(), "osm_corroborated"),
    ))
    return s.select("shop_id", "phone_valid", "phone_state_ok", "coord_ok", "cluster_dup", "spam_flag", "source_orgs", "n_independent", "confidence", status.alias("status"), flags.alias("flags"))


def join_licences(shops: DataFrame, licences: DataFrame, today: Column, radius_m: float = 150.0) -> DataFrame:
    """shop_id, licence_id, rule, expiry, expired: the first of four rules that fits, then the latest expiry.

    The rules are name and zip, name and city, place and the name's first six signs, address and zip.  Licences are
    reduced to the best of each key before they meet the shops, so a key of many of both makes one row a shop.
    """
    s = shops.select("shop_id", "state", "lat", "lon", F.substring("zip", 1, 5).alias("zip"), F.upper("city").alias("city"), company_key(F.col("name")).alias("nk"), address_key(F.col("address")).alias("ak"))
    li = licences.select("licence_id", "state", "lat", "lon", "zip", "city", "expiry", company_key(F.col("name")).alias("nk"), address_key(F.col("address")).alias("ak"))
    take = lambda df, pri, rule: df.select("shop_id", "licence_id", "expiry", F.lit(pri).alias("pri"), F.lit(rule).alias("rule"))
    rank = F.struct(F.col("expiry").isNull().alias("none"), (-F.unix_date("expiry")).alias("late"), "licence_id", "expiry")
    top = lambda keys: li.groupBy(*keys).agg(F.min(rank).alias("t")).select("t.licence_id", "t.expiry", *keys)
    on = lambda keys, pri, rule: take(s.select("shop_id", *keys).join(top(keys), keys), pri, rule)
    near = dwithin(s, li, radius_m).where((F.col("l.state") == F.col("r.state")) & (F.substring("l.nk", 1, 6) == F.substring("r.nk", 1, 6)))
    near = near.select(F.col("l.shop_id").alias("shop_id"), F.col("r.licence_id").alias("licence_id"), F.col("r.expiry").alias("expiry"))
    every = on(["state", "nk", "zip"], 1, "name_zip").unionByName(on(["state", "nk", "city"], 2, "name_city")).unionByName(take(near, 3, "geo_name")).unionByName(on(["state", "ak", "zip"], 4, "addr_zip"))
    best = F.min(F.struct("pri", F.col("expiry").isNull().alias("none"), (-F.unix_date("expiry")).alias("late"), "licence_id", "rule", "expiry")).alias("b")
    return every.groupBy("shop_id").agg(best).select("shop_id", "b.licence_id", "b.rule", "b.expiry", F.coalesce(F.col("b.expiry") < today, F.lit(False)).alias("expired"))


def match_map(shops: DataFrame, repair: DataFrame, radius_m: float) -> DataFrame:
    """shop_id, osm_id, dist_m: the nearest repair place of the map within the radius."""
    m = nearest_within(shops.select("shop_id", "lon", "lat"), repair.select("osm_id", "lon", "lat"), radius_m, "shop_id", "osm_id")
    return m.select("shop_id", F.col("r.osm_id").alias("osm_id"), "dist_m")


def coverage(shops: DataFrame, establishments: DataFrame, miles: DataFrame, scarce_miles: float = 40.0) -> DataFrame:
    """(state, shops, establishments, miles, verdict): thin_data where a state's share of its establishments is below
    half the nation's, real_scarcity from ``scarce_miles`` of route a shop on, else covered; null without shops.

    ``shops`` has a row a shop; ``establishments`` (state, n) and ``miles`` (state, miles) a row a state.
    """
    n = shops.groupBy("state").agg(F.count(F.lit(1)).alias("shops"))
    j = n.join(establishments.select("state", F.col("n").alias("establishments")), "state", "full").join(miles.select("state", "miles"), "state", "full")
    j = j.select("state", F.coalesce("shops", F.lit(0)).alias("shops"), F.coalesce("establishments", F.lit(0)).alias("establishments"), F.coalesce("miles", F.lit(0.0)).alias("miles"))
    nation = j.agg((F.sum("shops") / F.nullif(F.sum("establishments"), F.lit(0))).alias("national"))  # one row
    share, each = F.col("shops") / F.nullif("establishments", F.lit(0)), F.col("miles") / F.nullif("shops", F.lit(0))
    verdict = F.when(share < F.col("national") / 2, "thin_data").when(each >= scarce_miles, "real_scarcity").when(F.col("shops") > 0, "covered")
    return j.join(F.broadcast(nation)).select("state", "shops", "establishments", "miles", verdict.alias("verdict"))
