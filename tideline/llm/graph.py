"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node that can be reached. Nodes without a link have no row.

    Large-star and small-star rounds (Kiveris and others, 2014): each round lets
    every node's larger neighbours point to its least neighbour, then its
    smaller ones. Each round's links are a written table, so a lost executor
    costs only running tasks. A node's neighbours are never gathered in one
    place: only their minimum is, summed up before the shuffle. Null ends and
    links of a node to itself count as no links.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now, before = scratch.table(now, "links"), None
    while True:
        # large star: the neighbours above u go to the least of u and its neighbours
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        starred = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of these
        starred = scratch.table(starred, "links")
        least = starred.groupBy("u").agg(F.min("v").alias("m"))
        small = starred.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        done, now = (starred, now), scratch.table(small.where("u <> v").distinct(), "links")
        scratch.drop(*done)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
