"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and one join; each round is checkpointed to
the shared folder. The links end as stars around the smallest node of each component. What is shuffled is read again by
a task for each LINKS_PER_TASK links, not by one for each shuffle partition: the driver keeps a record of every task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

MAX_ROUNDS = 60
#: Links of a task, on average at most; there are as many tasks as cores at least.
LINKS_PER_TASK = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest node that can be reached. Null ends and self-links are left out."""
    spark = links.sparkSession
    shared_folder(spark)
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    was = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        tasks = max(spark.sparkContext.defaultParallelism, math.ceil(was[0] / LINKS_PER_TASK))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        edges = down.unionByName(least.select("a", F.col("m").alias("b")).coalesce(tasks)).distinct().coalesce(tasks).checkpoint()
        now = _state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").distinct().toDF("node", "root"))
