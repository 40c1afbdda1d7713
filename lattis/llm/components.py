"""Connected components of a table of links, by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattis.session import cleaned_up, keep

__all__ = ["components", "join_by_size", "keep"]
#: A key with more than one in so many rows is joined by broadcast; there are at most so many such keys.
HOT = 1000


def join_by_size(rows: DataFrame, keys: DataFrame, on: list[str], held: str, how: str = "inner") -> DataFrame:
    """rows joined with keys, which are unique in `on` (neither holds nulls there); keys.held: how many rows have the key.

    Keys that more than one in HOT rows have, HOT keys at most, are broadcast, so their rows stay where they are; the
    others meet in a shuffle. Both tables are read twice: checkpoint them before.
    """
    least = rows.count() / HOT
    hot, cold = keys.where(F.col(held) > least), keys.where(F.col(held) <= least)
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), on, "left")
    return marked.where("is_hot").drop("is_hot").unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def next_links(edges: DataFrame) -> DataFrame:
    """The links after a large and a small star; edges: a, b, a greater than b."""
    ways = lambda *pairs: F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("e")
    both = edges.select(ways(("a", "b"), ("b", "a"))).select("e.a", "e.b")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    # what a node links to, and the node itself, hand over to the smallest
    return large.join(low, "a").select(ways(("b", "m"), ("a", "m"))).select("e.a", "e.b").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id, component): the smallest id that each id with a link reaches.

    Alternating large and small stars (Kiveris et al. 2014): every node hands its neighbours its smallest neighbour, as a
    minimum per key and a join, so that no task collects a node's links. Rounds end when the links no longer change.
    A round reads the links once for each use of them and leaves no shuffle files, as with small tables these, and what is
    told of each task, are most of its disk.
    """
    edges = keep(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        some = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)  # two numbers a row: a task for each core will do
        with cleaned_up(df.sparkSession):
            return some.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = mark(edges)
    while now[0]:
        edges, before = keep(next_links(edges)), now
        now = mark(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
