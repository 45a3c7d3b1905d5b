"""Live positions and events as structured streams; each has a batch form with the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.sinks.tables import current, event_lifecycle, last_batch, snapshot_swap


def ping_reason(now: Column, lon: Column | None = None, lat: Column | None = None, speed: Column | None = None, observed_at: Column | None = None) -> Column:
    """Why a fix is refused, or null: out of bounds, faster than 200 km/h, more than 120 s ahead."""
    lon, lat, speed, observed_at = (F.col(n) if c is None else c for c, n in ((lon, "lon"), (lat, "lat"), (speed, "speed_kph"), (observed_at, "observed_at")))
    return (
        F.when(lon.isNull() | lat.isNull() | ~lon.between(-180, 180) | ~lat.between(-90, 90), "out_of_bounds")
        .when((speed < 0) | (speed > 200), "bad_speed")
        .when(observed_at > now + F.expr("INTERVAL 120 SECONDS"), "in_future")
    )


def dedup_fixes(fixes: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row per device and time.  As a stream, within the watermark; as a batch, over everything."""
    if fixes.isStreaming:
        return fixes.withWatermark("observed_at", watermark or "1 hour").dropDuplicatesWithinWatermark(["device_id", "observed_at"])
    return fixes.dropDuplicates(["device_id", "observed_at"])


def last_state(fixes: DataFrame) -> DataFrame:
    """Each device's latest fix and its ping count; a late fix counts but never moves the marker."""
    last = F.max(F.struct("observed_at", F.col("ping_id"), "lon", "lat", "speed_kph")).alias("m")
    return fixes.groupBy("device_id").agg(last, F.count(F.lit(1)).alias("ping_count")).select("device_id", "m.observed_at", "m.lon", "m.lat", "m.speed_kph", "ping_count")


def stale_flag(state: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    return state.withColumn("live", F.col("observed_at") >= now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def trail(fixes: DataFrame, now: Column, minutes: int, cap: int) -> DataFrame:
    """Each device's newest ``cap`` fixes of the last minutes, in time order, with ``available`` and ``truncated``."""
    w = Window.partitionBy("device_id")
    recent = fixes.where(F.col("observed_at") >= now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    n = F.row_number().over(w.orderBy(F.desc("observed_at"), F.desc("ping_id")))
    out = recent.withColumn("_n", n).withColumn("available", F.count(F.lit(1)).over(w)).where(F.col("_n") <= cap)
    return out.withColumn("seq", F.row_number().over(w.orderBy("observed_at", "ping_id"))).withColumn("truncated", F.col("available") > cap).drop("_n")


def too_soon(fixes: DataFrame, seconds: int = 5) -> DataFrame:
    """Marks fixes that arrive sooner after the device's one before than allowed."""
    before = F.lag("received_at").over(Window.partitionBy("device_id").orderBy("received_at", "ping_id"))
    return fixes.withColumn("too_soon", F.coalesce(F.col("received_at") < before + F.expr(f"INTERVAL {int(seconds)} SECONDS"), F.lit(False)))


def authorise(pings: DataFrame, devices: DataFrame) -> DataFrame:
    """Pings with ``refused``: unauthorized for an unknown device or a wrong token, alike, forbidden for a device that
    is not active, else null.  ``pings`` has device_id and token, ``devices`` device_id, token_sha256 and active."""
    d = devices.select("device_id", F.col("token_sha256").alias("_sha"), F.col("active").alias("_active"), F.lit(True).alias("_known"))
    right = F.coalesce(F.sha2(F.col("token").cast("binary"), 256) == F.col("_sha"), F.lit(False))
    refused = F.when(~right, "unauthorized").when(~F.coalesce("_active", F.lit(False)), "forbidden")
    return pings.join(d, "device_id", "left").withColumn("refused", refused).withColumn("_counts", F.col("_known").isNotNull()).drop("token", "_sha", "_active", "_known")


def rejects(judged: DataFrame) -> DataFrame:
    """(device_id, rejects): refused pings of each known device; unknown devices are nobody's."""
    return judged.where("_counts and refused is not null").groupBy("device_id").agg(F.count(F.lit(1)).alias("rejects"))


def lifecycle_sink(table: str, now: Callable[[int], Column], stream: str = "polls") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: folds each micro-batch of polled events into a snapshot table, once: a batch that comes
    again after a failure publishes nothing.  A query that begins with a new checkpoint takes a new ``stream`` name.

    A batch has source_id, event_id and payload; a row with a null event_id stands for a poll that found nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if last_batch(spark, table, stream) >= batch_id:
            return
        polled, seen = batch.select("source_id").distinct(), batch.where("event_id is not null")
        snapshot_swap(event_lifecycle(current(spark, table), seen, now(batch_id), sources=polled), table, min_rows=0, batches={stream: batch_id})

    return write
