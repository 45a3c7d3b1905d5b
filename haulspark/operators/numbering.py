"""Consecutive numbers over distributed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulspark.session import checkpoint


def number(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Consecutive numbers in a total order, without bringing all rows to one task: ranks within range partitions plus
    the sizes of the partitions before."""
    parts = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_rank") + F.col("_before") + (first - 1)).drop("_part", "_rank", "_before")
