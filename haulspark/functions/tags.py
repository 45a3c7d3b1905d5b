"""Map tags (``map<string,string>``) to kinds and tri-state flags; absent or unread means null, never false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def tristate(value: Column, yes: list[str], no: list[str]) -> Column:
    return F.when(value.isin(yes), F.lit(True)).when(value.isin(no), F.lit(False))


def not_no(value: Column) -> Column:
    """Any value but 'no' is true; absent is unknown."""
    return F.lower(F.trim(value)) != "no"


def kinds(tags: Column) -> Column:
    """At most one of fuel, weigh and rest, in that order, and truck_repair besides."""
    amenity, highway = tag(tags, "amenity"), tag(tags, "highway")
    weigh = amenity.eqNullSafe("weighbridge") | tag(tags, "man_made").eqNullSafe("weighbridge") | highway.eqNullSafe("weigh_station")
    one = F.when(amenity == "fuel", "fuel").when(weigh, "weigh").when(highway.isin("rest_area", "services"), "rest")
    repair = tag(tags, "shop").eqNullSafe("truck_repair") | tag(tags, "service:vehicle:truck_repair").eqNullSafe("yes") | tag(tags, "service:vehicle:trailer_repair").eqNullSafe("yes")
    return F.array_compact(F.array(one, F.when(repair, "truck_repair")))


def has_diesel(tags: Column) -> Column:
    return F.when(tag(tags, "fuel:HGV_diesel") == "yes", F.lit(True)).otherwise(tristate(tag(tags, "fuel:diesel"), ["yes"], ["no"]))


def hgv_access(tags: Column) -> Column:
    return F.when(tag(tags, "fuel:HGV_diesel") == "yes", F.lit(True)).otherwise(tristate(tag(tags, "hgv"), ["yes", "designated"], ["no"]))


def has_def(tags: Column) -> Column:
    return tristate(tag(tags, "fuel:adblue"), ["yes"], ["no"])


def way_centre(nodes: Column) -> Column:
    """Mean of a way's nodes (``array<struct<ref,lon,lat>>``), a closing node left out; null without a located one."""
    closed = (F.size(nodes) > 1) & (F.element_at(nodes, 1)["ref"] == F.element_at(nodes, -1)["ref"])
    own = F.when(closed, F.slice(nodes, F.lit(1), F.size(nodes) - 1)).otherwise(nodes)
    found = F.filter(own, lambda n: n["lon"].isNotNull() & n["lat"].isNotNull())
    mean = lambda f: F.aggregate(found, F.lit(0.0), lambda s, n: s + n[f]) / F.size(found)
    return F.when(F.size(found) > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def coded_flag(value: Column) -> Column:
    """'1' is true, '0' is false, anything else unknown."""
    return tristate(F.trim(value.cast("string")), ["1"], ["0"])


def codes(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds; null if none does."""
    got = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))
    return F.when(F.size(got) > 0, got)
