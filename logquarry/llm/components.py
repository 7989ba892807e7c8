"""Connected components of a graph of links, by minimum labels with pointer jumping, in stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """links: (u, v). Returns (node, component): the smallest node reachable, for every node of a link.

    Every round takes the least label among a node and its neighbours, then the label of that label;
    rounds grow with the logarithm of a component's diameter, and a hub's links are combined before
    the shuffle. Only the number of changed rows reaches the driver.
    """
    both = stage(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        low = stage(labels.join(near, labels.node == near.u).select("node", "component", F.least("component", "near").alias("low")), "low")
        jump = low.select(F.col("node").alias("at"), F.col("low").alias("to"))
        new = stage(low.join(jump, low.low == jump["at"], "left").select("node", "component", F.least("low", F.coalesce("to", "low")).alias("next")), "jumped")
        changed = new.where("next <> component").limit(1).count()
        labels = new.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between components: (u, v) with the nodes replaced by their labels."""
    a = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    named = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    return named.where("u <> v")


def extend(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels as components() gives them, after more links: only the graph of old components and new links is solved."""
    between = stage(relabelled(links, labels), "between")
    if between.isEmpty():
        return labels
    fresh = components(between)
    moved = fresh.select(F.col("node").alias("was"), F.col("component").alias("now"))
    old = labels.join(moved, labels.component == moved.was, "left").select("node", F.coalesce("now", "component").alias("component"))
    return stage(old.unionByName(fresh.join(labels.select("node"), "node", "left_anti")), "labels")
