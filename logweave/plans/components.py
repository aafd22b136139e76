"""Connected components of tokens, by hooking and shortcutting on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` (the least id reachable) for links ``a, b``; the rounds grow with the logarithm of the diameter.
    Where all that is left are stars around their least id, one aggregation is the last round."""
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        less = F.count_if(F.col("b") < F.col("a"))
        inner = (less > 1) | ((less > 0) & (less < F.count(F.lit(1))))
        parents = stage(both.groupBy(F.col("a").alias("root")).agg(F.least(F.col("a"), F.min("b")).alias("parent"), inner.alias("inner")), "parents")
        stars = parents.filter("inner").isEmpty()
        parents = parents.drop("inner")
        if labels is None:
            labels = parents.select(F.col("root").alias("id"), F.col("parent" if stars else "root").alias("component"))
            if stars:
                return labels
        elif stars:
            joined = labels.join(parents, labels["component"] == parents["root"], "left")
            return stage(joined.select("id", F.coalesce("parent", "component").alias("component")), "labels")
        for _ in range(2):
            up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
            parents = stage(parents.join(up, "parent").select("root", F.col("grand").alias("parent")), "parents")
        joined = labels.join(parents, labels["component"] == parents["root"], "left")
        labels = stage(joined.select("id", F.coalesce("parent", "component").alias("component")), "labels")
        a = parents.select(F.col("root").alias("a"), F.col("parent").alias("pa"))
        b = parents.select(F.col("root").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(a, "a").join(b, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = stage(edges, "links")
    return labels
