"""Confidence, liveness and verification scores as Column expressions.  ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulspark.functions.units import clamp01, percent

# Fixed values of the formulas.
TRUST = {
    "federal": 0.95, "federal_authoritative": 0.95, "state": 0.90, "state_authoritative": 0.90, "curated": 0.85, "curated_manual": 0.85,
    "open_aggregate": 0.65, "community": 0.55,
}
DEFAULT_TRUST = 0.55
FEDERAL_SOURCES = ["nbi_annual", "nti_tunnels", "ntad_parking", "nws_alerts", "eia_diesel"]
GEO_FLAGS = ["offroad", "coord_suspect"]
MANAGED_FLAGS = ["conflict_open", "vintage_unknown"]


def decay(observed_at: Column, now: Column, half_life_days: float | Column) -> Column:
    """0.5 to the power of age over half-life; 0 for an unknown date, 1 for a future one."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(observed_at.cast("timestamp"))) / F.lit(86400e6))
    half = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    return F.when(observed_at.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), days / half))  # greatest() would pass over a null


def completeness(weights: Mapping[str, int]) -> Column:
    """Weighted share of columns that are not null; 1 if none is asked for."""
    total = sum(weights.values())
    if not total:
        return F.lit(1.0)
    return sum((F.when(F.col(c).isNotNull(), float(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)) / float(total)


def agreement(open_conflicts: Column, corroborated: Column | None = None) -> Column:
    return F.when(open_conflicts > 0, 0.0).when(corroborated if corroborated is not None else F.lit(False), 1.0).otherwise(0.5)


def confidence(trust: Column, fresh: Column, complete: Column, agree: Column, geo_suspect: Column, open_conflicts: Column) -> Column:
    """(confidence, conf_trust, conf_fresh, conf_complete, conf_agree), each 0 to 100."""
    penalty = F.when(geo_suspect, 0.15).otherwise(0.0) + F.least(F.lit(0.20), F.lit(0.10) * open_conflicts)
    raw = 0.35 * trust + 0.25 * fresh + 0.20 * complete + 0.20 * agree - penalty
    parts = {"confidence": percent(clamp01(raw)), "conf_trust": percent(trust), "conf_fresh": percent(fresh), "conf_complete": percent(complete), "conf_agree": percent(agree)}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def trust_of(source_id: Column, trust: Column, base_trust: Column, authority: Column) -> Column:
    """Assigned trust, then base trust, then that of the class, then that of the id's prefix."""
    table = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    by_id = F.when(source_id.isin(FEDERAL_SOURCES), TRUST["federal"]).when(source_id.startswith("wzdx_"), TRUST["state"]).when(source_id.startswith("osm"), TRUST["community"]).otherwise(DEFAULT_TRUST)
    return F.coalesce(trust.cast("double"), base_trust.cast("double"), F.try_element_at(table, F.coalesce(authority, F.lit(""))), by_id)


def breadth(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, 0.5).when(n == 2, 0.8).otherwise(1.0)


def liveness(presence: Column, sources: Column, corroborated: Column, missing: Column, licence_expired: Column, closed: Column) -> Column:
    """(liveness, live_presence, live_sources, live_corrob, live_state); an asserted closure decides alone."""
    raw = 0.5 * presence + 0.3 * sources + 0.2 * corroborated - F.when(missing, 0.30).otherwise(0.0) - F.when(licence_expired, 0.25).otherwise(0.0)
    s = percent(clamp01(raw))
    state = F.when(closed, "closed").when(s >= 75, "open").when(s >= 50, "likely_open").when(s >= 25, "unknown").otherwise("likely_closed")
    parts = {"liveness": F.when(closed, 0).otherwise(s), "live_presence": percent(clamp01(presence)), "live_sources": percent(clamp01(sources)), "live_corrob": percent(clamp01(corroborated)), "live_state": state}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def fuel_points(independent: Column, brand: Column, fresh: Column, contact: Column, address: Column) -> Column:
    """45, 10, 15, 15, 10 and 5 points, 100 at most; unknown counts as no."""
    n = F.coalesce(independent, F.lit(0))
    give = lambda cond, points: F.when(cond, points).otherwise(0)
    return F.least(F.lit(100), give(n > 0, 45) + give(n > 1, 10) + give(brand, 15) + give(fresh, 15) + give(contact, 10) + give(address, 5))


def fuel_band(points: Column, independent: Column, coord_ok: Column) -> Column:
    return F.when(~F.coalesce(coord_ok, F.lit(False)), "unverified").when(F.coalesce(independent, F.lit(0)) > 0, "verified").when(points >= 30, "probable").otherwise("unverified")


def organisation(feed: Column) -> Column:
    """The organisation behind a feed's name; an unknown feed speaks for itself."""
    n = F.lower(F.trim(feed))
    starts = lambda *p: n.rlike(f"^(?:{'|'.join(p)})")
    return F.when(starts("overture"), "overture").when(starts("microsoft", "msft", "bing"), "microsoft").when(starts("meta", "facebook"), "meta").otherwise(n)


def organisations(feeds: Column, licence_ok: Column, licence_expired: Column, osm_id: Column) -> Column:
    """Sorted distinct organisations that name a shop; a valid licence and a map match are one each."""
    own = F.transform(F.filter(F.coalesce(feeds, F.array().cast("array<string>")), lambda f: f != ""), organisation)
    more = F.array_compact(F.array(F.when(licence_ok & ~F.coalesce(licence_expired, F.lit(False)), "state_licence"), F.when(osm_id.isNotNull() & (osm_id.cast("string") != ""), "osm")))
    return F.array_sort(F.array_distinct(F.concat(own, more)))


def independent(orgs: Column) -> Column:
    """How many organisations vouch; the aggregator has no vote."""
    return F.size(F.array_except(orgs, F.array(F.lit("overture"))))


def pair_score(name_sim: Column, dist_m: Column, bonus: Column, radius_m: float = 150.0) -> Column:
    return 0.60 * name_sim + 0.25 * (1.0 - F.least(dist_m, F.lit(radius_m)) / radius_m) + 0.15 * bonus


def pair_band(score: Column) -> Column:
    return F.when(score >= 0.85, "merge").when(score <= 0.55, "distinct").otherwise("gray")
