"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.session import checkpoint

#: Shares that the leaves of a large star are dealt to when they learn its component.
SALTS = 32


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every end of an edge; a component is named by its smallest node.

    A node whose only neighbour is smaller hangs on that neighbour and takes no part in the rounds, so that a large
    star is one node.  In each round a node takes the smallest label among its neighbours' and then the label of that
    label, so a chain of n nodes takes about log n rounds; ``max_rounds`` without an end raise.  Edges with a null end
    are left out; loops name lone nodes.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    e = checkpoint(e.distinct())
    ends = e.where("a <> b").select(F.explode(F.array("a", "b")).alias("a"))
    single = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a")
    hung = checkpoint(e.where("a <> b").join(single, "a", "left_semi"))  # the greater end has no other edge
    core = _rounds(e.join(hung.select("a"), "a", "left_anti"), max_rounds)
    # what leaves hang on: a node of the core, or a node of its own
    stems = hung.select(F.col("b").alias("node")).distinct().join(core, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("own"))
    stems = checkpoint(stems)
    salted = stems.select(F.col("node").alias("b"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    leaves = hung.withColumn("s", F.pmod(F.hash("a"), F.lit(SALTS))).join(salted, ["b", "s"]).select(F.col("a").alias("node"), "component")
    return core.unionByName(leaves).unionByName(stems.where("own").select("node", "component"))


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    both = checkpoint(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), "l"))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        # what a node hears goes to its label too, so that whole trees hang on, then labels follow their own labels
        heard = near.join(labels.withColumnRenamed("node", "a"), "a").select("a", "l", F.least("l", "m").alias("m"))
        told = heard.select(F.col("l").alias("node"), "m").unionByName(heard.select(F.col("a").alias("node"), "m"))
        told = told.groupBy("node").agg(F.min("m").alias("m"))
        parents = told.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        new = told.join(parents, "m", "left").select("node", F.least("m", F.coalesce("mm", "m")).alias("n"))
        step = checkpoint(labels.join(new, "node").select("node", F.col("n").alias("l"), (F.col("n") != F.col("l")).alias("changed")))
        labels = step.select("node", "l")
        if step.where("changed").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return labels.select("node", F.col("l").alias("component"))
