"""Who last saw a place: the presence ledger, vanishing, chain witnesses, and rescoring of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions import score
from haulspark.operators.spatial import nearest_within

KEY = ["entity_type", "entity_id", "source_id"]


def fold(ledger: DataFrame, rows: DataFrame, always_count: bool = False) -> DataFrame:
    """The ledger after a table was read.  ``rows`` has entity_type, entity_id, sources (array) and observed_at.

    The greatest date stays, a source that is back is no longer missing, and ``observations`` rises only where the
    date advanced (``always_count``: at every reading).  Rows without a date say nothing.
    """
    new = rows.where("observed_at is not null").select("entity_type", "entity_id", F.explode("sources").alias("source_id"), "observed_at").where("source_id is not null")
    new = new.groupBy(*KEY).agg(F.max("observed_at").alias("seen"))
    j = ledger.join(new, KEY, "full")
    had, has = F.col("first_seen_at").isNotNull(), F.col("seen").isNotNull()
    more = F.lit(1) if always_count else F.when(F.col("seen") > F.col("last_seen_at"), 1).otherwise(0)
    return j.select(
        *KEY, F.coalesce("first_seen_at", "seen").alias("first_seen_at"), F.greatest("last_seen_at", "seen").alias("last_seen_at"),
        F.when(has, F.lit(None).cast("timestamp")).otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(had & has, F.col("observations") + more).when(had, F.col("observations")).otherwise(1).cast("bigint").alias("observations"),
    )


def mark_vanished(ledger: DataFrame, present: DataFrame, entity_type: str, now: Column, chain_source: str = "chain_sites") -> DataFrame:
    """Stamps entries of entities that a table no longer has; the chain source is left alone."""
    here = present.select(F.col("entity_id").cast("string").alias("entity_id")).distinct().withColumn("_here", F.lit(True))
    gone = (F.col("entity_type") == entity_type) & (F.col("source_id") != chain_source) & F.col("missing_since").isNull() & F.col("_here").isNull()
    return ledger.join(here, "entity_id", "left").withColumn("missing_since", F.when(gone, now.cast("timestamp")).otherwise(F.col("missing_since"))).select(*ledger.columns)


def chain_witness(places: DataFrame, chain: DataFrame, radius_m: float) -> DataFrame:
    """(place_id, brand, dist_m): the nearest chain site within the radius."""
    return nearest_within(places, chain, radius_m, "place_id", "site_id").select("place_id", F.col("r.brand").alias("brand"), "dist_m")


def rescore_liveness(places: DataFrame, ledger: DataFrame, chain: DataFrame | None, now: Column, half_life_days: float) -> DataFrame:
    """place_id with liveness, its components, state and reasons.  ``places`` may have licence_active,
    licence_expired and closed (three-valued), and half_life_days, which goes before the argument where it isn't null."""
    for c in ("licence_active", "licence_expired", "closed"):
        if c not in places.columns:
            places = places.withColumn(c, F.lit(None).cast("boolean"))
    seen = ledger.groupBy("entity_id").agg(
        F.max("last_seen_at").alias("last_seen_at"), F.count_if(F.col("missing_since").isNull()).alias("n_sources"), F.bool_or(F.col("missing_since").isNotNull()).alias("missing"),
        F.max(F.struct("last_seen_at", "source_id")).getField("source_id").alias("last_seen_src"),
    )
    j = places.withColumn("entity_id", F.col("place_id").cast("string")).join(seen, "entity_id", "left")
    j = j.join(chain.select("place_id", F.col("brand").alias("chain_brand")), "place_id", "left") if chain is not None else j.withColumn("chain_brand", F.lit(None).cast("string"))
    half = F.coalesce(F.col("half_life_days"), F.lit(float(half_life_days))) if "half_life_days" in places.columns else half_life_days
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    corr = F.when(F.col("chain_brand").isNotNull() | no("licence_active"), 1.0).otherwise(0.0)
    s = score.liveness(score.decay(F.col("last_seen_at"), now, half), score.breadth(F.coalesce("n_sources", F.lit(0))), corr, no("missing"), no("licence_expired"), no("closed"))
    reasons = F.array_compact(F.array(
        F.concat(F.lit("chain_confirmed:"), F.col("chain_brand")), F.when(no("licence_active"), "licence_active"), F.when(no("licence_expired"), "licence_expired"),
        F.when(no("missing"), "vanished_from_source"), F.when(no("closed"), "closure_asserted"), F.when(F.col("last_seen_at").isNull(), "never_confirmed"),
    ))
    return j.select("place_id", s.alias("s"), reasons.alias("reasons"), "last_seen_src").select("place_id", "s.*", "reasons", "last_seen_src")


def rescore(table: DataFrame, conflicts: DataFrame, trust: Column, now: Column, half_life_days: float | None, weights: dict[str, int], entity_id: Column, entity_type: str) -> DataFrame:
    """``table`` with confidence columns and flags renewed and ``changed``; flags of others stay in place, managed ones
    come after them."""
    n_open = conflicts.where((F.col("status") == "open") & (F.col("entity_type") == entity_type)).groupBy(F.col("entity_id").alias("_eid")).agg(F.count(F.lit(1)).alias("_open"))
    j = table.withColumn("_eid", entity_id.cast("string")).join(n_open, "_eid", "left").withColumn("_open", F.coalesce("_open", F.lit(0)))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    fresh = F.lit(1.0) if half_life_days is None else score.decay(F.col("observed_at"), now, half_life_days)
    geo = F.arrays_overlap(flags, F.array(*[F.lit(x) for x in score.GEO_FLAGS]))
    s = score.confidence(trust, fresh, score.completeness(weights), score.agreement(F.col("_open")), geo, F.col("_open"))
    new = F.concat(F.filter(flags, lambda f: ~f.isin(score.MANAGED_FLAGS)), F.array_compact(F.array(F.when(F.col("_open") > 0, "conflict_open"), F.when(F.col("observed_at").isNull(), "vintage_unknown"))))
    own = ["confidence", "conf_trust", "conf_fresh", "conf_complete", "conf_agree"]
    j = j.withColumn("_s", s).withColumn("_flags", new)
    same = F.col("flags").eqNullSafe(F.col("_flags"))
    for c in own:
        same = same & (F.col(c).eqNullSafe(F.col(f"_s.{c}")) if c in table.columns else F.lit(False))
    keep = [c for c in table.columns if c not in (*own, "flags")]
    return j.select(*keep, "_s.*", F.col("_flags").alias("flags"), (~same).alias("changed"))
