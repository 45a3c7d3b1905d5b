"""Tables of key buckets: a merge writes anew only the buckets whose keys it touches.

A pointer lists the folder of each bucket, so that a new version shares all other buckets with the one before.  It
also holds the last batch of each stream that was merged, which makes a batch that comes again do nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulspark.sinks.tables import RefusedLoad, _fs, _point, _pointers, _read_text

BUCKET = "_bucket"


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _manifest(spark: SparkSession, table: str) -> dict:
    names = _pointers(spark, table)
    if not names:
        raise FileNotFoundError(f"{table} has no version")
    return json.loads(_read_text(spark, f"{table}/{names[-1]}"))


def _write(df: DataFrame, table: str, keys: list[str], n: int) -> dict[str, str]:
    """Rows by bucket below a new folder: bucket -> its path below the table."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.withColumn(BUCKET, _bucket(keys, n)).repartition(BUCKET).sortWithinPartitions(BUCKET, *keys).write.partitionBy(BUCKET).parquet(f"{table}/{version}")
    fs, p, _ = _fs(spark, f"{table}/{version}")
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return {x.split("=")[1]: f"{version}/{x}" for x in names if x.startswith(f"{BUCKET}=")}


def _one_each(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last by ``order``; without an order several are refused."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise RefusedLoad(f"several rows of one key, and no order says which counts: {twice[0].asDict()}")
    return new


def create(df: DataFrame, table: str, keys: list[str], buckets: int = 64, order: str | None = None) -> None:
    """Publishes ``df`` as the first or a whole new version of a table of ``buckets`` buckets by ``keys``."""
    df = _one_each(df, keys, order)
    _point(df.sparkSession, table, json.dumps({"keys": keys, "n": buckets, "schema": df.schema.json(), "buckets": _write(df, table, keys, buckets), "batches": {}}))


def read(spark: SparkSession, table: str, only: set[str] | None = None) -> DataFrame:
    """The live version, or some of its buckets."""
    from pyspark.sql.types import StructType

    m = _manifest(spark, table)
    schema = StructType.fromJson(json.loads(m["schema"]))
    paths = [f"{table}/{p}" for b, p in sorted(m["buckets"].items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_keys(spark: SparkSession, table: str, keys: DataFrame) -> DataFrame:
    """The rows of some keys, from their buckets only; which those are is a set no larger than the table's buckets."""
    m = _manifest(spark, table)
    touched = {str(r["b"]) for r in keys.select(_bucket(m["keys"], m["n"]).alias("b")).distinct().collect()}
    return read(spark, table, touched).join(keys.select(*m["keys"]).distinct(), m["keys"], "left_semi")


def merge(new: DataFrame, table: str, order: str | None = None, gone: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> dict:
    """Puts ``new`` rows in the place of those of the same keys and removes the keys of ``gone``; says which buckets
    were written and how many are shared with the version before.

    With ``stream`` and ``batch``, a batch that the stream has merged before does nothing, so a sink that repeats one
    after a failure writes it once.  A stream that begins anew needs a new name.  Of several new rows of a key the
    last by ``order`` counts.  Two writers at once: one of them is refused, and the table is as the other left it.
    """
    spark = new.sparkSession
    m = _manifest(spark, table)
    if stream is not None and batch is not None and m["batches"].get(stream, -1) >= batch:
        return {"written": [], "shared": len(m["buckets"])}
    keys, columns = m["keys"], [f["name"] for f in json.loads(m["schema"])["fields"]]
    new = _one_each(new.select(*columns), keys, order)
    changed = new.select(*keys) if gone is None else new.select(*keys).unionByName(gone.select(*keys))
    touched = {str(r["b"]) for r in changed.select(_bucket(keys, m["n"]).alias("b")).distinct().collect()}
    kept = read(spark, table, touched).join(changed, keys, "left_anti")
    merged = kept.unionByName(new) if gone is None else kept.unionByName(new.join(gone.select(*keys), keys, "left_anti"))
    written = _write(merged, table, keys, m["n"]) if touched else {}
    shared = {b: p for b, p in m["buckets"].items() if b not in touched}
    batches = m["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
    _point(spark, table, json.dumps(m | {"buckets": shared | written, "batches": batches}))
    return {"written": sorted(written, key=int), "shared": len(shared)}


def merge_sink(table: str, stream: str, order: str | None = None):
    """For ``foreachBatch``: merges each micro-batch exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge(batch, table, order, stream=stream, batch=batch_id)

    return write


def collect_versions(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Removes all but the last ``keep`` pointers and the folders that none of these names; returns what went.

    A reader that began before the last ``keep`` versions may lose its files, so ``keep`` is how long readers live."""
    if keep < 1:
        raise ValueError("the live version stays")
    names = _pointers(spark, table)
    live = [json.loads(_read_text(spark, f"{table}/{n}")) for n in names[-keep:]]
    used = {p for m in live for p in m.get("buckets", {}).values()} | {m["version"] for m in live if "version" in m}
    folders = {p.split("/")[0] for p in used}
    fs, p, Path = _fs(spark, table)
    gone = []
    for n in names[:-keep]:
        fs.delete(Path(f"{table}/{n}"), False)
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if not name.startswith("v-"):
            continue
        if name not in folders:
            fs.delete(f.getPath(), True)
            gone.append(name)
        elif name not in used:  # a folder of which some buckets are still in use
            for b in fs.listStatus(f.getPath()):
                path = f"{name}/{b.getPath().getName()}"
                if path not in used and f"/{BUCKET}=" in path:
                    fs.delete(b.getPath(), True)
                    gone.append(path)
    return sorted(gone)
