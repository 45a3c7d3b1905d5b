"""What lies along a route: features with their place on it, restrictions with reasons, fuel with prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import haversine_m, segments
from haulspark.functions.text import carries_route
from haulspark.functions.units import feet_inches
from haulspark.operators.graph import binding_clearance

# What a posting means.
POSTING = {"P": "posted for load", "R": "posted for other restrictions", "B": "open, posting recommended", "D": "open, temporary supports", "K": "closed to all traffic"}


def features_near(path: DataFrame, features: DataFrame, buffer_m: float, feature_id: str) -> DataFrame:
    """Features at most ``buffer_m`` from a path, once each, at the edge nearest to them: m_along and offset_m added.

    ``path`` has path_id, seq, line, length_m, cum_m, sign_type, sign_num.  Its two-point pieces are dealt to the cells
    that their grown boxes touch, and points meet them by cell.
    """
    grow = buffer_m / 70_000.0
    cell = max(0.05, 2 * grow)
    p = path.select("path_id", "seq", "length_m", "cum_m", "sign_type", "sign_num", F.explode(segments(F.col("line"))).alias("s"), F.aggregate(segments(F.col("line")), F.lit(0.0), lambda t, x: t + x["len"]).alias("total"))
    span = lambda f: F.sequence(F.floor((F.least(f"s.a.{f}", f"s.b.{f}") - grow) / cell).cast("bigint"), F.floor((F.greatest(f"s.a.{f}", f"s.b.{f}") + grow) / cell).cast("bigint"))
    p = p.withColumn("cx", F.explode(span("lon"))).withColumn("cy", F.explode(span("lat")))
    f = features.where("lon is not null and lat is not null").select("*", F.floor(F.col("lon") / cell).cast("bigint").alias("cx"), F.floor(F.col("lat") / cell).cast("bigint").alias("cy"))
    j = f.join(p, ["cx", "cy"])
    # metres around the feature: degrees of longitude shrink with the latitude
    k = F.cos(F.radians("lat"))
    ax, ay = (F.col("s.a.lon") - F.col("lon")) * k, F.col("s.a.lat") - F.col("lat")
    dx, dy = (F.col("s.b.lon") - F.col("s.a.lon")) * k, F.col("s.b.lat") - F.col("s.a.lat")
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    x, y = F.col("s.a.lon") + t * (F.col("s.b.lon") - F.col("s.a.lon")), F.col("s.a.lat") + t * (F.col("s.b.lat") - F.col("s.a.lat"))
    share = F.coalesce((F.col("s.before") + t * F.col("s.len")) / F.nullif("total", F.lit(0.0)), F.lit(0.0))
    j = j.withColumn("offset_m", haversine_m(F.col("lon"), F.col("lat"), x, y)).withColumn("m_along", F.col("cum_m") + share * F.col("length_m")).where(F.col("offset_m") <= buffer_m)
    keep = [c for c in features.columns if c != feature_id]
    best = F.min(F.struct("offset_m", "seq", "m_along", "sign_type", "sign_num", F.struct(*[F.col(c) for c in keep]).alias("f"))).alias("b")
    return j.groupBy("path_id", feature_id).agg(best).select("path_id", feature_id, "b.f.*", "b.offset_m", "b.m_along", F.col("b.sign_type").alias("on_sign_type"), F.col("b.sign_num").alias("on_sign_num"))


def bridge_restrictions(near: DataFrame, threshold_in: float) -> DataFrame:
    """Bridges with relation, clearance_in, clearance_text and reasons (possibly none); unknown clearances stay null.

    ``near`` has facility, over10, over53, under54 (text), posting, on_sign_type, on_sign_num.
    """
    on = carries_route(F.col("facility"), F.col("on_sign_type"), F.col("on_sign_num"))
    c = binding_clearance(on, F.col("over10"), F.col("over53"), F.col("under54"))
    means = F.try_element_at(F.create_map(*[F.lit(x) for kv in POSTING.items() for x in kv]), F.upper(F.trim("posting")))
    low = c < threshold_in
    text = F.when(on.eqNullSafe(F.lit(True)), F.concat(F.lit("low clearance "), feet_inches(c), F.lit(" over the deck you drive on"))).otherwise(F.concat(feet_inches(c), F.lit(" recorded beneath this structure")))
    post = F.when(on.eqNullSafe(F.lit(True)), means).when(on.isNull(), F.concat(means, F.lit(", not known whether it carries your road")))
    relation = F.when(on, "you drive over it").when(~on, F.concat(F.lit("carries "), F.col("facility"))).otherwise("unknown which road it carries")
    return near.withColumns({"relation": relation, "clearance_in": c, "clearance_text": feet_inches(c), "reasons": F.array_compact(F.array(F.when(low, text), post))})


def tunnel_restrictions(near: DataFrame, threshold_in: float) -> DataFrame:
    """Tunnels with reasons: hazmat with its codes, low clearance."""
    c = F.col("clearance_in")
    kinds = F.coalesce(F.nullif(F.array_join("hazmat_codes", ", "), F.lit("")), F.lit("unspecified"))
    reasons = F.array(F.when(F.col("hazmat_restricted"), F.concat(F.lit("hazmat restricted ("), kinds, F.lit(")"))), F.when(c < threshold_in, F.concat(F.lit("low clearance "), feet_inches(c))))
    return near.withColumns({"relation": F.lit("you drive through it"), "clearance_text": feet_inches(c), "reasons": F.array_compact(reasons)})


def fuel_details(near: DataFrame, states: DataFrame, weekly: DataFrame, daily: DataFrame, region_of_state: Column) -> DataFrame:
    """Fuel along a path with its state, the latest weekly price of the region and the latest daily one of the state."""
    w = weekly.groupBy("region").agg(F.max(F.struct("week_of", "price")).alias("w")).select("region", F.col("w.week_of").alias("week_of"), F.col("w.price").alias("weekly_price"))
    d = daily.groupBy(F.col("state").alias("_state")).agg(F.max(F.struct("observed_on", "price")).alias("d")).select("_state", F.col("d.observed_on").alias("observed_on"), F.col("d.price").alias("daily_price"))
    j = near.join(states, "osm_id", "left").withColumn("region", region_of_state)
    return j.join(w, "region", "left").join(d, F.col("state") == F.col("_state"), "left").drop("_state")


def path_rollup(path: DataFrame) -> DataFrame:
    """path_id with its length, connectors and roads: (sign_type, sign_num, state, metres) in order of length."""
    roads = path.where("kind = 'truck_route'").groupBy("path_id", "sign_type", "sign_num", "state").agg(F.sum("length_m").alias("m"))
    w = Window.partitionBy("path_id").orderBy(F.desc("m"), "sign_type", "sign_num", "state")
    roads = roads.withColumn("n", F.row_number().over(w)).groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("n", "sign_type", "sign_num", "state", "m"))).alias("roads"))
    conn = F.col("kind") == "connector"
    total = path.groupBy("path_id").agg(F.sum("length_m").alias("length_m"), F.count_if(conn).alias("connectors"), F.coalesce(F.sum(F.when(conn, F.col("length_m"))), F.lit(0.0)).alias("connector_m"), F.sum(F.coalesce("structures_unknown_clearance", F.lit(0))).alias("unknown_clearance"))
    return total.join(roads, "path_id", "left")


#: Categories of businesses that stand in for repair shops.
REPAIR = ("truck_repair", "towing", "tire_service", "truck_dealer")


def mechanics(path: DataFrame, shops: DataFrame | None, businesses: DataFrame, buffer_m: float) -> DataFrame:
    """Repair, towing and tyre shops near a path, with ``source`` saying which table answered.

    ``shops`` (shop_id, name, category, lon, lat, verification_status, confidence) answers if it has any row; else the
    repair categories of ``businesses`` (business_id, name, category, lon, lat) do, unverified.
    """
    if shops is not None and not shops.isEmpty():
        return features_near(path, shops, buffer_m, "shop_id").withColumnRenamed("shop_id", "id").withColumn("source", F.lit("mechanic_shops"))
    found = features_near(path, businesses.where(F.col("category").isin(*REPAIR)), buffer_m, "business_id").withColumnRenamed("business_id", "id")
    return found.withColumns({"verification_status": F.lit(None).cast("string"), "confidence": F.lit(None).cast("int"), "source": F.lit("businesses (fallback)")})
