"""An inverted index of stems with positions, and searches that read only the stems they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.functions.shapes import let
from haulspark.functions.stem import stems
from haulspark.functions.text import trigram_similarity


def index(df: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """(stem, id_col, positions): where the columns, as one text, have each stem.  Each stem of a row is a row of its
    own, made beside the text and grouped within it, so that a frequent stem is no group."""
    places = lambda s, w: F.transform(F.filter(s, lambda x: x["stem"] == w), lambda x: x["pos"]).alias("positions")
    one = let(stems(F.concat_ws(" ", *columns)), lambda s: F.transform(F.array_distinct(F.transform(s, lambda x: x["stem"])), lambda w: F.struct(w.alias("stem"), places(s, w))))
    return df.select(id_col, F.explode(one).alias("s")).select("s.stem", id_col, "s.positions")


def asked(spark, query: str) -> list[str]:
    """The stems of a query; one row of a literal."""
    return sorted({r["stem"] for r in spark.range(1).select(F.inline(stems(F.lit(query)))).collect()})


def having_all(indexed: DataFrame, query: str, id_col: str) -> DataFrame:
    """The ids of the rows that have every stem of a query.  A query of stop words only finds nothing.

    The stems are a filter on the index, which its scan can use where the index is written in the order of stems."""
    wanted = asked(indexed.sparkSession, query)
    hits = indexed.where(F.col("stem").isin(wanted) if wanted else F.lit(False))
    return hits.groupBy(id_col).agg(F.count_distinct("stem").alias("n")).where(F.col("n") == len(wanted)).select(id_col)


def having_phrase(indexed: DataFrame, query: str, id_col: str) -> DataFrame:
    """The ids of the rows that have the stems of a query in a row, as far apart as in the query."""
    spark = indexed.sparkSession
    wanted = [(r["stem"], r["pos"]) for r in spark.range(1).select(F.inline(stems(F.lit(query)))).collect()]
    each = [F.struct(F.lit(w).alias("w"), F.lit(p).alias("p")) for w, p in wanted]
    if not each:
        return indexed.limit(0).select(id_col)
    terms = indexed.where(F.col("stem").isin([w for w, _ in wanted])).withColumn("t", F.explode(F.filter(F.array(*each), lambda x: x["w"] == F.col("stem"))))
    starts = terms.select(id_col, F.col("t.p").alias("term"), F.explode("positions").alias("at")).withColumn("start", F.col("at") - F.col("term"))
    return starts.groupBy(id_col, "start").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select(id_col).distinct()


def search(df: DataFrame, indexed: DataFrame, query: str, id_col: str, name: str = "name", least: float = 0.3) -> DataFrame:
    """Rows that have every stem of the query, by the index, or whose name is similar enough; ``similarity`` is the
    name's, and orders them."""
    found = having_all(indexed, query, id_col).withColumn("_found", F.lit(True))
    s = df.withColumn("similarity", trigram_similarity(F.col(name), F.lit(query))).join(found, id_col, "left")
    return s.where(F.col("_found").isNotNull() | (F.col("similarity") > least)).drop("_found")
