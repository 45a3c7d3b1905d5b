"""Keyed state of streams equals the batch, also after a restart from the checkpoint."""

import datetime as dt
import random

from pyspark.sql import functions as F

from haulspark.streaming import devices, tracking

T0 = dt.datetime(2024, 1, 1)
PING = "device_id int, ping_id bigint, received_at timestamp, observed_at timestamp, lon double, lat double, speed_kph double"


def pings(seed, n):
    r, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += dt.timedelta(milliseconds=r.choice([0, 400, 1500, 6000]))
        out.append((r.randrange(4), i, at, at - dt.timedelta(seconds=r.choice([0, 0, 90])), -100.0 + i / 100, 40.0, 50.0))
    return out


def allowed(rows, seconds):
    last, out = {}, {}
    for d, i, at, *_ in sorted(rows, key=lambda x: (x[2], x[1])):
        limited = d in last and (at - last[d]).total_seconds() < seconds
        if not limited:
            last[d] = at
        out[i] = limited
    return out


def run(spark, stream, folder, mode):
    got = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: got.append([r.asDict() for r in b.collect()])).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [r for part in got for r in part]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, PING).coalesce(1).write.mode("append").json(f"{folder}/in")


def source(spark, folder):
    return spark.readStream.schema(PING).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def test_spacing_of_a_batch(spark):
    rows = pings(1, 300)
    df = spark.createDataFrame([*rows, (None, 900, T0, T0, 0.0, 0.0, 0.0), (9, 901, None, T0, 0.0, 0.0, 0.0)], PING)
    got = {r["ping_id"]: r["rate_limited"] for r in devices.spaced(df).collect()}
    assert got == allowed(rows, 5) | {900: False}
    assert 20 < sum(got.values()) < 280 and devices.spaced(df.limit(0)).count() == 0


def test_streams_equal_batches_after_a_restart(spark, tmp_path):
    rows = pings(2, 120)
    marked, states = {}, {}
    for part in (rows[:70], rows[70:]):  # the second run goes on from the checkpoint of the first
        for k in range(0, len(part), 35):
            feed(spark, tmp_path, part[k : k + 35])
        marked |= {r["ping_id"]: r["rate_limited"] for r in run(spark, devices.spaced(source(spark, tmp_path)), tmp_path / "spaced", "append")}
        for r in run(spark, devices.device_states(source(spark, tmp_path), watermark="10 minutes"), tmp_path / "state", "update"):
            states[r["device_id"]] = r
    assert marked == allowed(rows, 5)
    want = tracking.last_state(spark.createDataFrame(rows, PING)).collect()
    assert {(r["device_id"], r["observed_at"], r["lon"], r["ping_count"]) for r in want} == {(r["device_id"], r["observed_at"], r["lon"], r["ping_count"]) for r in states.values()}
    assert all(r["live"] for r in states.values())


def test_a_timer_says_that_a_fix_is_stale_and_silence_forgets(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    fix = lambda d, i, s: (d, i, at(s), at(s), -100.0, 40.0, 50.0)
    got = []
    for part in ([fix(1, 1, 0), fix(2, 2, 0)], [fix(2, 3, 150)], [fix(2, 4, 300)], [fix(2, 5, 310)], [fix(2, 6, 4000)], [fix(2, 7, 4001), fix(1, 8, 4002)]):
        feed(spark, tmp_path, part)
        stream = devices.device_states(source(spark, tmp_path), watermark="1 second", forget=dt.timedelta(minutes=10))
        got += run(spark, stream, tmp_path, "update")
    one = [(r["ping_count"], r["live"]) for r in got if r["device_id"] == 1]
    assert one == [(1, True), (1, False), (1, True)]  # live, stale by the timer; forgotten, so its count begins anew
    two = [(r["ping_count"], r["live"]) for r in got if r["device_id"] == 2]
    assert [c for c, live in two if live] == [1, 2, 3, 4, 5, 6]
    last = {r["device_id"]: r for r in got}
    now = F.lit(at(4010)).cast("timestamp")
    batch = tracking.stale_flag(spark.createDataFrame([(1, at(4002)), (2, at(4001))], "device_id int, observed_at timestamp"), now).collect()
    assert {(r["device_id"], r["live"]) for r in batch} == {(d, r["live"]) for d, r in last.items()}
