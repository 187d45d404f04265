"""Connected components of an edge table, by DataFrame joins and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b long): the smallest id reachable.

    Each round hooks the larger label of every edge whose ends differ onto the smaller label, then
    halves the paths, and keeps only edges whose ends still differ, between labels instead of ids.
    Labels of a hooked tree have one row each, so no key is hot on the label side; edges into one
    label are pre-aggregated (min) before they are shuffled. Empty edges give no rows.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    edges = stored(edges)
    labels = None  # (id, component): the label of each id so far
    current = edges
    while not current.isEmpty():
        # Each label that is the larger end of an edge points to its smallest partner.
        parent = stored(current.groupBy("a").agg(F.min("b").alias("p")))
        while True:  # pointer jumping; pointers fall, so they end at roots
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = stored(parent.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        root = parent.select(F.col("a").alias("id"), F.col("p").alias("component"))
        if labels is None:
            labels = root
        else:
            step = root.select(F.col("id").alias("component"), F.col("component").alias("next"))
            labels = labels.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
            known = labels.select("id")
            labels = stored(labels.unionByName(root.join(known, "id", "left_anti")))
        ra = parent.select("a", F.col("p").alias("na"))
        rb = parent.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        moved = current.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("na", "a").alias("x"), F.coalesce("nb", "b").alias("y"))
        current = stored(moved.where("x <> y").select(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("a")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    tops = labels.select(F.col("component").alias("id")).distinct()
    tops = tops.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.unionByName(tops)
