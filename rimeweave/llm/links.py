"""Buckets, and the classes that links form, without all pairs of a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, written


def stars(buckets: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) that connect all nodes of a bucket: from each row (key, node) to the smallest node of its key.

    Only minima are gathered per key and joined back, so a key with most of the `total` rows is spread over tasks.
    """
    least = buckets.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("rows"))
    least = least.filter("least != most").drop("most")
    met = attach(buckets, least, "key", "rows", total, "node").filter("node != least")
    return met.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def classes(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each end of a link (a, b) is connected with.

    Stars are moved to smaller centres until nothing changes: first every neighbour that is larger than a node, then
    every smaller one, is linked to the smallest neighbour. Only minima are gathered per node, so a node with very many
    links is no more than a hot key. Each of the two steps is a table: a plan that holds both repeats the first three times.
    """
    edges = written(_larger_first(links, "a", "b"), "links")
    before = None
    while True:
        count, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, mark) == before or not count:
            break
        before = count, mark
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        wide = attach(both, low, "a", "n", 2 * count, "b").filter(F.col("b") > F.col("a"))
        wide = written(_larger_first(wide, "b", "low"), "wide")
        low = wide.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        near = attach(wide, low, "a", "n", 2 * count, "b").select("a", "low", F.col("b").alias("near"))
        moved = near.select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("near").alias("x")))), "low")
        edges = written(_larger_first(moved.select("col.x", "low"), "x", "low"), "links")
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("class"))
    return stars.unionAll(stars.select(F.col("class").alias("id"), "class").distinct())


def _larger_first(df: DataFrame, a: str, b: str) -> DataFrame:
    a, b = F.col(a), F.col(b)
    return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()


def is_first(id_column: Column, class_column: Column) -> Column:
    return class_column.isNull() | (id_column == class_column)
