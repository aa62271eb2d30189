"""Shared pieces: the word definition, lineage cuts, text buffers and connected components.

Words are maximal runs of characters other than space and U+0009..U+000D; they are the only
definition of a word in this subpackage. A null text counts as the empty text everywhere.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text"):
    """The text column without nulls; a table without that column has empty texts."""
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def words(text):
    """The words of a text as an array, within the JVM."""
    return F.array_remove(F.split(text, SPACES), "")


def n_words(text):
    return F.size(words(text)).cast("long")


def lower_ascii(text):
    """Only A-Z change, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Only a local session that has none gets a temporary folder; on a cluster that would be a folder
    of one machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = given.get() if given.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="probatum-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/probatum-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame to the shared folder and read it again, so that a lost executor costs no recomputation."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b), both long; label is the least node it reaches.

    Alternates large-star and small-star. Each side of a star is a minimum per node with map-side
    combining, joined back, so a node with very many neighbours is never gathered into a list. Every
    round is written to the shared folder and the round before it deleted. A graph that hasn't settled after
    the last round is an error.
    """
    spark = edges.sparkSession

    def pairs(df):
        return df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, path = cut_at(pairs(edges), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new_path = cut_at(pairs(small.unionByName(least.select("a", F.col("m").alias("b")))), "edges")
        delete(spark, path)
        now, path = after, new_path
    else:
        raise RuntimeError(f"connected components have not settled after {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
