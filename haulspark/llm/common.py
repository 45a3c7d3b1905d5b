"""Helpers shared by the operators of this package: checkpoints, vector blocks, Arrow mapping."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.session import checkpoint, checkpoint_dir

__all__ = ["BATCH_ROWS", "by_length", "checkpoint", "checkpoint_dir", "each_with_each", "finite_vectors", "map_batches", "narrow", "numbered", "packed", "place", "prepare", "read", "scratch", "unpack"]

#: Rows in an Arrow batch; Spark bounds its bytes as well (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default).
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on: small Arrow batches, a checkpoint folder, importable code."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_dir(spark)
    _ship(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ship(spark: SparkSession) -> None:
    """Python workers import this package; send it along unless PYTHONPATH has it already."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, sc = os.path.dirname(package), spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_haulspark_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="haulspark-code-"), "haulspark_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(out)
    sc._haulspark_shipped = True


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow with state per task: ``make()`` is called once a task; what it returns turns a batch into column dicts.

    The function may have an attribute ``end``, called after the last batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            if b.num_rows:
                for columns in step(b):
                    yield pa.RecordBatch.from_pydict(columns, schema=kind)
        for columns in getattr(step, "end", lambda: ())():
            yield pa.RecordBatch.from_pydict(columns, schema=kind)

    return df.mapInArrow(run, schema)


def place(df: DataFrame, name: str) -> int:
    """The position of a column: the one of exactly that name, else the one that differs in case only."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    alike = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"{len(alike)} columns are named {name}")
    return alike[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, …, so that no name can clash, be it by case only."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def narrow(df: DataFrame, **names: str) -> DataFrame:
    """Only the columns in use, under our own names, so that extra columns of any name cannot clash."""
    at = {k: place(df, v) for k, v in names.items()}
    return numbered(df).select(*[F.col(f"c{i}").alias(k) for k, i in at.items()])


# ---- vectors in blocks -----------------------------------------------------------------------------------

VECTOR = "id bigint, vec array<double>"


def finite_vectors(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id, vec) as doubles; without vectors that are null, empty, or hold null or non-finite components, and,
    if ``nonzero``, without zero ones."""
    v = narrow(df, id=id_col, vec=vec_col).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    ok = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    if nonzero:
        ok = ok & F.exists("vec", lambda x: x != 0.0)
    return v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & ok)


def by_length(v: DataFrame, search: Callable[[DataFrame], DataFrame], empty: str) -> DataFrame:
    """``search`` over the vectors of each length: products are defined among equal lengths only.  There are few."""
    sizes = [r["d"] for r in v.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]
    found = [search(v.where(F.size("vec") == d)) for d in sizes]
    return functools.reduce(DataFrame.unionByName, found) if found else v.sparkSession.createDataFrame([], empty)


def packed(df: DataFrame, extra: str = "") -> DataFrame:
    """Each partition of (id, vec[, extra]) as one row of binary: (part, ids, mat, more); empty ones give none."""
    from pyspark import TaskContext

    def make():
        held: list[tuple] = []

        def step(b: pa.RecordBatch):
            d = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids = d["id"].to_numpy(zero_copy_only=False).astype("<i8")
            mat = d["vec"].flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
            held.append((ids, mat, d[extra].to_numpy(zero_copy_only=False).astype("<f8") if extra else np.zeros(0)))
            return ()

        def end():
            if held:
                ids, mat, more = (np.concatenate([h[i] for h in held]) for i in range(3))
                yield {"part": [TaskContext.get().partitionId()], "ids": [ids.tobytes()], "mat": [mat.tobytes()], "more": [more.tobytes()]}

        step.end = end
        return step

    return map_batches(df, make, "part int, ids binary, mat binary, more binary")


def each_with_each(base: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Each packed base block with each packed query block: the query blocks are dealt to the numbers of the base
    blocks and joined by number, so a base block moves once and is a task of its own.  The planner takes the copies for
    as small as the queries before they are copied, and a broadcast would pass the driver, so none is made."""
    q = queries.select(F.col("part").alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "part"])
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = lambda df: df.repartitionById(parts, F.col("part"))
    return own(base).join(own(q).hint("merge"), "part")


def unpack(ids: bytes, mat: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(mat, "<f8").reshape(len(i), -1)
