"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..shared import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every greater id has one link, and no lesser id is a greater one elsewhere."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b", max_size: int | None = None) -> DataFrame:
    """(id, component): the least id that each linked id reaches.

    Rounds of two stars, each a table of the shared folder: the number of links never grows, a hub's links are never gathered,
    and a chain of n ids takes about log n rounds.  ``max_size`` guards against a rule that merges everything.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables of their own, so that the joins shuffle both sides and a hub's links can be split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large star: a node's greater neighbours go to the least it knows
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: a node and its lesser neighbours go to the least of them
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, edges = edges, materialize(small.filter("u <> v").distinct(), "small-star")
        discard(before, least, large, lower)
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    labels = labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
    if max_size is not None:
        worst = labels.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        if worst > max_size:
            raise ValidationError(f"a cluster of {worst} exceeds {max_size}; a threshold merges too much", details={"cluster_size": worst, "max_cluster_size": max_size})
    return labels.select("id", F.col("label").alias("component"))
