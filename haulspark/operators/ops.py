"""Operations as queries: what is due, what is stale, what fails, which region's price applies."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
OK = ["success", "skipped_unchanged", "skipped_no_key"]
BAD = ["failed", "gated"]
DISTRICTS = {
    "PADD1A": "CT ME MA NH RI VT", "PADD1B": "DE DC MD NJ NY PA", "PADD1C": "FL GA NC SC VA WV", "PADD2": "IL IN IA KS KY MI MN MO NE ND OH OK SD TN WI",
    "PADD3": "AL AR LA MS NM TX", "PADD4": "CO ID MT UT WY", "PADD5": "AK AZ CA HI NV OR WA",
}


def due_sources(sources: DataFrame, runs: DataFrame, now: Column, breakers: DataFrame | None = None) -> DataFrame:
    """(source_id, streak, due): whether a source's schedule and its back-off, or its open breaker's cooldown, have
    passed.  The back-off is 5 minutes doubled per failure after the first, 360 at most."""
    ok = runs.where(F.col("status").isin(OK)).groupBy("source_id").agg(F.max("started_at").alias("ok_at"))
    bad = runs.where(F.col("status").isin(BAD)).join(ok, "source_id", "left").where("ok_at is null or started_at > ok_at").groupBy("source_id").agg(F.max("started_at").alias("bad_at"), F.count(F.lit(1)).alias("streak"))
    j = sources.join(ok, "source_id", "left").join(bad, "source_id", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    j = j.join(breakers.select("source_id", "state", "opened_at", "cooldown_minutes"), "source_id", "left") if breakers is not None else j.withColumns({"state": F.lit("closed"), "opened_at": F.lit(None).cast("timestamp_ntz"), "cooldown_minutes": F.lit(0)})
    older = lambda at, minutes: at < F.timestamp_add("MINUTE", -minutes, now)
    wait = F.least(F.lit(360), 5 * F.pow(F.lit(2), F.least(F.greatest(F.col("streak") - 1, F.lit(0)), F.lit(7)))).cast("int")
    open_ = F.col("opened_at").isNotNull() & (F.coalesce("state", F.lit("closed")) != "closed")
    scheduled = F.col("enabled") & F.col("schedule_minutes").isNotNull() & (F.col("ok_at").isNull() | older(F.col("ok_at"), F.col("schedule_minutes")))
    rested = F.when(open_, older(F.col("opened_at"), F.col("cooldown_minutes"))).otherwise(F.col("bad_at").isNull() | older(F.col("bad_at"), wait))
    return j.select("source_id", "streak", (scheduled & rested).alias("due"))


def freshness_state(last_ok: Column, now: Column, slo_hours: Column) -> Column:
    """fresh, warn from three quarters of the objective on, STALE beyond it, n-a without either."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_ok.cast("timestamp"))) / F.lit(3600e6)
    return F.when(last_ok.isNull() | slo_hours.isNull(), "n-a").when(hours > slo_hours, "STALE").when(hours >= 0.75 * slo_hours, "warn").otherwise("fresh")


def breaker(runs: DataFrame, threshold: int = 5) -> DataFrame:
    """(source_id, consecutive_failures, state): failures since the last run of another kind."""
    at = F.struct("started_at", "run_id")
    good = runs.where("status <> 'failed'").groupBy("source_id").agg(F.max(at).alias("good"))
    n = runs.join(good, "source_id", "left").groupBy("source_id").agg(F.count_if(F.col("good").isNull() | (at > F.col("good"))).alias("consecutive_failures"))
    return n.withColumn("state", F.when(F.col("consecutive_failures") >= threshold, "open").otherwise("closed"))


def watch(runs: DataFrame, since: Column, threshold: int, backlog: int) -> DataFrame:
    """(alert, source_id, n) of sources that fail again and again, never worked, or pile up gated runs: one pass."""
    g = runs.groupBy("source_id").agg(
        F.count_if((F.col("status") == "failed") & (F.col("started_at") >= since)).alias("failed"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") == "gated").alias("gated"), F.count(F.lit(1)).alias("n"))
    alerts = F.array_compact(F.array(
        F.when(F.col("failed") >= threshold, F.struct(F.lit("repeated_failures").alias("alert"), F.col("failed").alias("n"))), F.when(F.col("ok") == 0, F.struct(F.lit("never_ok").alias("alert"), F.col("n").alias("n"))),
        F.when(F.col("gated") > backlog, F.struct(F.lit("backlog").alias("alert"), F.col("gated").alias("n"))),
    ))
    return g.select("source_id", F.explode(alerts).alias("a")).select("a.alert", "source_id", "a.n")


def alerts(runs: DataFrame, sources: DataFrame, queue: DataFrame, now: Column, nightly: Sequence[str] = (), window_h: int = 24, threshold: int = 3, nightly_h: int = 30, stuck_h: int = 6, backlog_h: int = 6, deferred_h: int = 24) -> DataFrame:
    """(key, severity, source_id, n, said): all seven alerts.

    ``runs`` has run_id, source_id, status, started_at, message; ``sources`` source_id, enabled; ``queue`` job_id,
    source_id, status, enqueued_at, message.  Sources whose id begins with _test_ are left out.
    """
    ago = lambda h: now - F.expr(f"INTERVAL {int(h)} HOURS")
    real = lambda df: df.where(~F.coalesce(F.col("source_id").startswith("_test_"), F.lit(False)))
    r, s, q = real(runs), real(sources), queue.where("status = 'queued'")
    said = lambda df, kind, key, n, text, severity="high": df.select(F.concat(F.lit(f"{kind}/"), key.cast("string")).alias("key"), F.lit(severity).alias("severity"), F.col("source_id"), n.cast("bigint").alias("n"), text.alias("said"))
    last = F.max_by("message", F.struct("started_at", "run_id")).alias("last")
    failed = r.where("status = 'failed'")
    hours = lambda at: F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(3600e6))
    key, one = F.col("source_id"), F.lit(1)
    repeated = failed.where(F.col("started_at") > ago(window_h)).groupBy("source_id").agg(F.count(one).alias("n"), last).where(F.col("n") >= threshold)
    selfcheck = failed.where(F.col("source_id").isin(list(nightly)) & (F.col("started_at") > ago(nightly_h))).groupBy("source_id").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("n"), last)
    never = r.groupBy("source_id").agg(F.count(one).alias("n"), F.count_if(F.col("status") == "success").alias("ok")).where("ok = 0 and n >= 3")
    stuck = r.where((F.col("status") == "running") & (F.col("started_at") < ago(stuck_h)))
    disarmed = s.where("not enabled").join(r.groupBy("source_id").agg(F.max("started_at").alias("at")).where(F.col("at") > ago(24 * 7)), "source_id")
    backlog = q.where(F.col("enqueued_at") < ago(backlog_h)).agg(F.count(one).alias("n"), F.min("enqueued_at").alias("at")).where("n > 0").withColumn("source_id", F.lit(None).cast("string"))
    deferred = real(q).where(F.col("message").startswith("deferred") & (F.col("enqueued_at") < ago(deferred_h)))
    none = F.lit(None).cast("string")
    parts = [
        said(repeated, "failing", key, F.col("n"), F.substring("last", 1, 160)), said(selfcheck, "selfcheck", key, F.col("n"), F.substring("last", 1, 200)), said(never, "never-ok", key, F.col("n"), none),
        said(stuck, "stuck", F.col("run_id"), hours("started_at"), none), said(disarmed, "disarmed", key, one, none), said(backlog, "backlog", F.lit("queue"), F.col("n"), F.col("at").cast("string"), "medium"),
        said(deferred, "deferred", key, hours("enqueued_at"), F.substring("message", 1, 200)),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def activity(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Runs of each source in the last days, by outcome."""
    r = runs.where((F.col("started_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")) & ~F.col("source_id").startswith("_test_"))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return r.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), n("success").alias("ok"), n("skipped_unchanged", "skipped_no_key", "gated").alias("skipped"), n("failed").alias("failed"), n("running").alias("running"),
        F.coalesce(F.sum("rows_published"), F.lit(0)).alias("rows_published"), F.max("started_at").alias("last_at"),
    )


def attention(runs: DataFrame, sources: DataFrame, now: Column, days: int = 7, threshold: int = 5) -> DataFrame:
    """(source_id, reason) of what needs a human, each source once: STALE before BREAKER OPEN before FAILING.

    A source is stale if it is enabled, has an objective (slo_hours), and its last good run is older than that or
    missing.
    """
    ok = runs.where(F.col("status").isin(OK)).groupBy("source_id").agg(F.max("started_at").alias("ok_at"))
    state = sources.where("enabled and slo_hours is not null").join(ok, "source_id", "left")
    stale = state.where(F.col("ok_at").isNull() | (freshness_state(F.col("ok_at"), now, F.col("slo_hours")) == "STALE")).select("source_id", F.lit(1).alias("rank"))
    open_ = breaker(runs, threshold).where("state = 'open'").select("source_id", F.lit(2).alias("rank"))
    failing = activity(runs, now, days).where("failed > 0").select("source_id", F.lit(3).alias("rank"))
    first = stale.unionByName(open_).unionByName(failing).groupBy("source_id").agg(F.min("rank").alias("rank"))
    return first.select("source_id", F.when(F.col("rank") == 1, "STALE").when(F.col("rank") == 2, "BREAKER OPEN").otherwise("FAILING").alias("reason"))


def sync_registry(wanted: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What to do with each source: insert, update, keep, or disable; none is deleted."""
    a = wanted.select("source_id", F.struct(*columns).alias("new"), F.lit(True).alias("w"))
    b = stored.select("source_id", F.struct(*columns).alias("old"), F.lit(True).alias("s"))
    action = F.when(F.col("w").isNull(), "disable").when(F.col("s").isNull(), "insert").when(~F.col("new").eqNullSafe(F.col("old")), "update").otherwise("keep")
    return a.join(b, "source_id", "full").select("source_id", action.alias("action"), "new")


def price_regions() -> dict[str, list[str]]:
    """Each state's price regions, the most specific first."""
    out = {}
    for d, states in DISTRICTS.items():
        for s in states.split():
            wide = ["PADD1"] if d.startswith("PADD1") else []
            first = ["CA", "PADD5"] if s == "CA" else ["PADD5_EX_CA", "PADD5"] if d == "PADD5" else [d]
            out[s] = [*first, *wide, "US"]
    return out


def price_region(state: Column, available: Sequence[str]) -> Column:
    """The most specific region with a price for a state; null for an unknown state."""
    known = {s: next((r for r in rs if r in available), None) for s, rs in price_regions().items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for s, r in known.items() if r for x in (s, r)]), state)
