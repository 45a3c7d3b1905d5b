"""What a viewer asks of the holdings: drawn against held, by state, newest prices, last runs, text search."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.functions.text import trigram_similarity


def inventory(layers: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(layer, drawn, held, newest) of each layer, a table and the filter that says which rows are on the map; a pass
    over each.  A filtered layer is a number of its own, and ``newest`` is when the newest fact was true."""
    one = lambda name, df, rows: df.agg(F.lit(name).alias("layer"), F.count_if(F.expr(rows or "true")).alias("drawn"), F.count(F.lit(1)).alias("held"), (F.max("observed_at") if "observed_at" in df.columns else F.lit(None)).cast("timestamp_ntz").alias("newest"))
    return functools.reduce(DataFrame.unionByName, [one(n, *x) for n, x in layers.items()])


def breakdown(df: DataFrame, by: str = "state", row_filter: str | None = None) -> DataFrame:
    """Rows on the map by a column; nulls are 'unknown'."""
    rows = df.where(row_filter) if row_filter else df
    return rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"))


def latest_prices(prices: DataFrame) -> DataFrame:
    """The newest week of each region and product."""
    return prices.groupBy("region", "product").agg(F.max(F.struct("week_of", "price")).alias("m")).select("region", "product", "m.week_of", "m.price")


def last_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    """The last runs, whatever became of them."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def search(df: DataFrame, query: str, columns: tuple[str, ...] = ("name",), least: float = 0.3) -> DataFrame:
    """Rows that have every word of the query in the columns, or whose name is similar enough; ``similarity`` is the
    name's, and orders them.  Words are compared as they stand, without a stemmer."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    have = words(F.concat_ws(" ", *columns))
    asked = words(F.lit(query))
    every = (F.size(asked) > 0) & (F.size(F.array_except(asked, have)) == 0)
    return df.withColumn("similarity", trigram_similarity(F.col(columns[0]), F.lit(query))).where(every | (F.col("similarity") > least))
