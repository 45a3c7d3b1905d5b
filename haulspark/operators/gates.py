"""Quality gates: rows in, a reject reason or null beside each; accepted rows and rejects are two filters of one frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.functions.geo import judge_points, wkt_points

NUMERIC = ("lat", "lon", "price_usd_gal")


def schema_reason(required: Sequence[str], numeric: Sequence[str] = NUMERIC) -> Column:
    """The first required field, in order, that is null or, for a numeric one, can't be read."""
    checks = []
    for f in required:
        checks.append(F.when(F.col(f).isNull(), f"missing_required:{f}"))
        if f in numeric:
            checks.append(F.when(F.col(f).cast("string").try_cast("double").isNull(), f"unparseable:{f}"))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def coords_reason(lon: Column | None = None, lat: Column | None = None, wkt: Column | None = None) -> Column:
    """A geometry decides where there is one, else the point; neither passes."""
    none = F.lit(None).cast("string")
    out = none
    if lon is not None and lat is not None:
        x, y = lon.cast("string").try_cast("double"), lat.cast("string").try_cast("double")
        point = F.array(F.struct(x.alias("lon"), y.alias("lat")))
        out = F.when(x.isNull() | y.isNull(), "coords_out_of_range").otherwise(judge_points(point))
    if wkt is not None:
        points = wkt_points(wkt)
        out = F.when(wkt.isNull(), out).when(points.isNull(), "geom_unparseable").otherwise(judge_points(points))
    return out


def duplicate_reason(df: DataFrame, key: str, ordinal: str, reason: str = "reject_reason") -> DataFrame:
    """Marks all but the last row of a key; null keys pass."""
    later = F.lead(F.lit(1)).over(Window.partitionBy(key).orderBy(ordinal))
    keyed = df.where(F.col(key).isNotNull()).withColumn(reason, F.when(later.isNotNull(), "duplicate_natural_key"))
    return keyed.unionByName(df.where(F.col(key).isNull()).withColumn(reason, F.lit(None).cast("string")))


def split(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reason, and rejects with their raw record as JSON."""
    raw = [c for c in df.columns if c != reason]
    rejects = df.where(F.col(reason).isNotNull()).select(F.col(reason).alias("reason"), F.to_json(F.struct(*raw)).alias("raw_record"))
    return df.where(F.col(reason).isNull()).drop(reason), rejects


def verdict(counts: DataFrame, min_rows: int = 0, geometry_valid_pct: float | None = None, max_row_delta_pct: float | None = None) -> DataFrame:
    """One row per source of (source_id, ok, rejected, geometry_rejects, previous): why a run is gated, or null."""
    n = F.col("ok") + F.col("rejected")
    checks = [F.when((F.col("ok") == 0) & (F.col("rejected") > 0), "all_rows_rejected"), F.when(F.col("ok") < min_rows, "below_min_rows")]
    if geometry_valid_pct is not None:
        checks.append(F.when((n > 0) & (100.0 * (n - F.col("geometry_rejects")) / n < geometry_valid_pct), "geometry_valid_pct"))
    if max_row_delta_pct is not None:
        checks.append(F.when((F.col("previous") > 0) & (100.0 * F.abs(F.col("ok") - F.col("previous")) / F.col("previous") > max_row_delta_pct), "max_row_delta_pct"))
    return counts.withColumn("gated_by", F.coalesce(*checks, F.lit(None).cast("string")))


def state_floors(now: DataFrame, before: DataFrame, floor: int = 3, drop_pct: float = 50.0, baseline: int = 10) -> DataFrame:
    """(state, n, previous, violation): too few rows, or a fall of more than ``drop_pct`` from a baseline of ten or more."""
    j = now.select("state", F.col("n")).join(before.select("state", F.col("n").alias("previous")), "state", "full")
    n = F.coalesce("n", F.lit(0))
    fell = (F.col("previous") >= baseline) & (n < F.col("previous") * (1 - drop_pct / 100.0))
    return j.select("state", n.alias("n"), "previous", F.when(fell, "dropped").when(n < floor, "below_floor").alias("violation"))


def reconcile_conflicts(open_now: DataFrame, found: DataFrame, keys: Sequence[str] = ("check_id", "entity_id")) -> DataFrame:
    """Keys of both with an action: open, keep or close.  Null keys never match and never stop others from closing."""
    keys = list(keys)
    a = open_now.select(*keys).distinct().withColumn("was", F.lit(True))
    b = found.select(*keys).distinct().withColumn("now", F.lit(True))
    return b.join(a, keys, "full").select(*keys, F.when(F.col("was").isNull(), "open").when(F.col("now").isNull(), "close").otherwise("keep").alias("action"))
