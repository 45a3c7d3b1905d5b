"""Publishing: versioned snapshots behind a pointer, event lifecycles, keyed upserts, per-group replacement, retention.

Paths go through the cluster's file system, so any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class RefusedLoad(Exception):
    """A load that must not replace good data."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


POINTER = re.compile(r"pointer-(\d{12})")


def _pointers(spark: SparkSession, table: str) -> list[str]:
    """The table's pointers, the newest last."""
    fs, p, _ = _fs(spark, table)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if POINTER.fullmatch(f.getPath().getName())) if fs.exists(p) else []


def _point(spark: SparkSession, table: str, text: str) -> None:
    """A new pointer under the next number: written aside, then renamed, which fails if another writer has the number.

    No pointer is overwritten or deleted, so a reader always finds a whole one.
    """
    fs, part, Path = _fs(spark, f"{table}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    last = _pointers(spark, table)
    name = f"pointer-{int(POINTER.fullmatch(last[-1])[1]) + 1 if last else 1:012d}"
    target = Path(f"{table}/{name}")
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise RefusedLoad(f"another writer published {name}")


def last_batch(spark: SparkSession, table: str, stream: str) -> int:
    """The last batch of a stream that the live version holds, or -1."""
    names = _pointers(spark, table)
    return json.loads(_read_text(spark, f"{table}/{names[-1]}")).get("batches", {}).get(stream, -1) if names else -1


def snapshot_swap(df: DataFrame, table: str, min_rows: int = 1, batches: dict[str, int] | None = None) -> str:
    """Writes a new version below ``table`` and points to it; refuses fewer than ``min_rows`` rows.  ``batches`` notes
    the last batch of streams, beside what the version before has noted.

    The version is written and counted before the pointer moves, so a failure leaves the live version as it was.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{version}")
    n = spark.read.schema(df.schema).parquet(f"{table}/{version}").count()
    if n < min_rows:
        fs, p, _ = _fs(spark, f"{table}/{version}")
        fs.delete(p, True)
        raise RefusedLoad(f"{n} rows, {min_rows} are the least")
    names = _pointers(spark, table)
    noted = json.loads(_read_text(spark, f"{table}/{names[-1]}")).get("batches", {}) if names else {}
    _point(spark, table, json.dumps({"version": version, "rows": n, "batches": noted | (batches or {})}))
    return version


def current(spark: SparkSession, table: str) -> DataFrame:
    """The live version of a snapshot table."""
    names = _pointers(spark, table)
    if not names:
        raise FileNotFoundError(f"{table} has no version")
    return spark.read.parquet(f"{table}/{json.loads(_read_text(spark, f'{table}/{names[-1]}'))['version']}")


def event_lifecycle(live: DataFrame, seen: DataFrame, now: Column, keys=("source_id", "event_id"), sources: DataFrame | None = None) -> DataFrame:
    """The next state of an event table: what was seen is open, what a polled source no longer has is soft-closed.

    ``live`` has the keys, first_seen, last_seen, soft_closed_at and payload columns; ``seen`` the keys and payload.
    ``sources`` names the polled sources (default: those in ``seen``), so that an empty poll closes all of a source's
    events.  A closed event that comes back opens again and keeps its first_seen.
    """
    keys = list(keys)
    payload = [c for c in seen.columns if c not in keys]
    polled = (sources if sources is not None else seen.select(keys[0])).select(keys[0]).distinct().withColumn("_polled", F.lit(True))
    a = live.select(*keys, "first_seen", "last_seen", "soft_closed_at", *[F.col(c).alias(f"_{c}") for c in payload]).withColumn("_old", F.lit(True))
    b = seen.dropDuplicates(keys).withColumn("_new", F.lit(True))
    j = a.join(b, keys, "full").join(polled, keys[0], "left")
    new, gone = F.col("_new").isNotNull(), F.col("_polled").isNotNull() & F.col("_new").isNull()
    return j.select(
        *keys, F.coalesce("first_seen", now).alias("first_seen"), F.when(new, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(new, F.lit(None)).when(gone, F.coalesce("soft_closed_at", now)).otherwise(F.col("soft_closed_at")).alias("soft_closed_at"),
        *[F.when(new, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in payload],
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows with those of the same key replaced; of several new rows of a key the last by ``order`` counts."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def replace_groups(old: DataFrame, new: DataFrame, group: str, succeeded: list[str]) -> DataFrame:
    """Old rows of the groups that did not succeed, and new rows of those that did."""
    return old.where(~F.col(group).isin(succeeded)).unionByName(new.where(F.col(group).isin(succeeded)))


def retention(rows: DataFrame, group: str, at: str, now: Column, days: int, keep_where: Column | None = None) -> DataFrame:
    """Rows younger than ``days``, the newest of each group, and the newest of each that ``keep_where`` holds for."""
    w = Window.partitionBy(group).orderBy(F.desc(at))
    keep = (F.col(at) >= now - F.expr(f"INTERVAL {int(days)} DAYS")) | (F.row_number().over(w) == 1)
    out = rows.withColumn("_keep", keep)
    if keep_where is not None:
        best = F.max(F.when(keep_where, F.col(at))).over(Window.partitionBy(group))
        out = out.withColumn("_keep", F.col("_keep") | F.coalesce(F.col(at) == best, F.lit(False)))
    return out.where("_keep").drop("_keep")


def export_csv(df: DataFrame, path: str, first: int | None = None, bom: bool = False) -> None:
    """CSV with a header, arrays joined by '; ', nulls empty; the first rows by the first column if asked for."""
    out = df.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
    if first is not None:
        out = out.orderBy(out.columns[0]).limit(first)
    if bom:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.mode("overwrite").option("header", True).csv(path)


def content_address(df: DataFrame, content: str = "content") -> DataFrame:
    """Raw documents with the hash that names them."""
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
