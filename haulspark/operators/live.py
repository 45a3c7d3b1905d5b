"""Live events: zones of alerts and the search in a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.functions.shapes import line_meets_box, polygon_meets_box


def zones(props: Column) -> Column:
    """Zone codes of an alert from its JSON: the first that isn't empty of ``zones``, ``geocode.UGC`` and
    ``affectedZones``; an empty array where none is."""
    listed = lambda path: F.from_json(F.get_json_object(props, path), "array<string>")
    full = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(*[full(listed(p)) for p in ("$.zones", "$.geocode.UGC", "$.affectedZones")], F.array().cast("array<string>"))


def alerts_in_box(events: DataFrame, box: tuple[float, float, float, float], include_nongeo: bool = False) -> DataFrame:
    """Open alerts whose envelope (xmin, ymin, xmax, ymax) meets the box, in order of their ids.

    Alerts without geometry name zones only: no box finds them, so they are left out unless ``include_nongeo``.
    """
    x0, y0, x1, y1 = box
    near = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    wanted = F.coalesce(near, F.lit(include_nongeo))
    return events.where((F.col("kind") == "weather_alert") & F.col("soft_closed_at").isNull() & wanted)


def events_in_box(events: DataFrame, box: tuple[float, float, float, float], include_nongeo: bool = False) -> DataFrame:
    """Open events that touch the closed box themselves, not just by their extent.

    An event has xmin, ymin, xmax, ymax, which the scan can use, and one of ``line`` (an array of points, of which a
    single one is a point) and ``rings`` (a polygon's outside and holes), the other being null.  Events without any
    geometry are left out unless ``include_nongeo``; one with an extent only counts by its extent.
    """
    x0, y0, x1, y1 = box
    near = (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    touches = F.when(F.col("rings").isNotNull(), polygon_meets_box(F.col("rings"), box)).when(F.col("line").isNotNull(), line_meets_box(F.col("line"), box)).otherwise(F.lit(True))
    wanted = F.coalesce(near, F.lit(include_nongeo)) & (near.isNull() | touches)
    return events.where(F.col("soft_closed_at").isNull() & wanted)
