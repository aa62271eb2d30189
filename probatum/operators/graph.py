"""Reference checks and bounded reachability over edge tables (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dangling(refs: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    return refs.join(ids.select(F.col(id_column).alias(column)).distinct(), column, "left_anti")


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges without their reverse."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return edges.distinct().join(back, ["a", "b"], "left_anti")


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """(a, b, pasos): least steps of each path up to a depth. Pairs are made distinct each step, so cycles end."""
    step = edges.select("a", "b").distinct()
    front, seen = step, step.withColumn("pasos", F.lit(1))
    for d in range(2, depth + 1):
        front = front.select("a", F.col("b").alias("m")).join(step.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
        seen = seen.unionByName(front.withColumn("pasos", F.lit(d)))
    return seen.groupBy("a", "b").agg(F.min("pasos").alias("pasos"))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(a, b) of every path of one step or more, at least all of up to depth steps; for catalogues.

    Every node also leads to itself, so that one table, joined with itself, holds all shorter paths: the plan
    has as many joins as depth has binary digits.
    """
    step = edges.select("a", "b").distinct()
    reach, k = step.unionByName(step.select("a", F.col("a").alias("b"))).unionByName(step.select(F.col("b").alias("a"), "b")).distinct(), 1

    def then(left, right):
        return left.select("a", F.col("b").alias("m")).join(right.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()

    while k < depth - 1:
        reach, k = then(reach, reach), 2 * k
    return then(step, reach)
