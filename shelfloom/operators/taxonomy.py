"""Trees kept as (id, name, parent_id): paths, leaves, descendants, of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_dir


def tree(nodes: DataFrame) -> DataFrame:
    """id, depth (roots 1), path (ids), names, is_leaf of all nodes below a root. A cycle is an error; nodes below a missing parent are left out.

    Pointer doubling: each step joins a node's path to the path that ends at its top, so a chain of n nodes takes log2(n)
    joins. Each step's paths are written to the shared folder.
    """
    spark, n, step = nodes.sparkSession, nodes.count(), 0
    own = nodes.select("id", F.col("parent_id").alias("top"), F.array("id").alias("path"), F.array("name").alias("names"))
    done = own.where("top is null")
    rest = own.where("top is not null")
    while not rest.isEmpty():
        if 1 << step > max(1, n):
            raise ValueError("the nodes hold a cycle")
        above = own.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("head"), F.col("names").alias("head_names"))
        joined = rest.join(above, "top").select("id", F.col("next").alias("top"), F.concat("head", "path").alias("path"), F.concat("head_names", "names").alias("names"))
        folder = fresh_dir(spark, "paths")
        done.unionByName(joined).write.parquet(folder)
        own = spark.read.parquet(folder)
        done, rest, step = own.where("top is null"), own.where("top is not null"), step + 1
    inner = nodes.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(True))
    out = done.select("id", F.size("path").alias("depth"), "path", "names")
    return out.join(inner, "id", "left").withColumn("is_leaf", F.col("inner").isNull()).drop("inner")


def descendants(nodes: DataFrame, root: int) -> DataFrame:
    """ids of root and everything below it."""
    return tree(nodes).where(F.array_contains("path", root)).select("id")
