"""Connected components of a link table, by hooking and contraction in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (node, parent), parent <= node, until each names its root."""
    while True:
        up = parents.select(F.col("node").alias("up"), F.col("parent").alias("top"))
        jumped = checkpointed(parents.join(up, F.col("parent") == F.col("up"), "left").select("node", F.coalesce("top", "parent").alias("parent"), (F.coalesce("top", "parent") != F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def contract(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component): each linked node's smallest reachable node.

    ``links`` has columns a and b.  ``labels`` is an earlier result whose components the links may
    join further.  Every round hooks each node to its smallest neighbour, follows the hooks to
    their roots and contracts the links; components at least halve in number.
    """
    if labels is not None:
        one, other = (labels.select(F.col("node").alias(f"n{i}"), F.col("component").alias(f"c{i}")) for i in "12")
        links = links.join(one, F.col("a") == F.col("n1"), "left").join(other, F.col("b") == F.col("n2"), "left").select(F.coalesce("c1", "a").alias("a"), F.coalesce("c2", "b").alias("b"))
    links = checkpointed(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
        parents = _roots(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent")))
        found = parents.withColumnRenamed("parent", "component") if found is None else _then(found, parents)
        one, other = (parents.select(F.col("node").alias(f"n{i}"), F.col("parent").alias(f"p{i}")) for i in "12")
        links = checkpointed(links.join(one, F.col("a") == F.col("n1")).join(other, F.col("b") == F.col("n2")).select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).filter("a <> b").distinct())
    if labels is None:
        return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels if found is None else checkpointed(_then(labels, found.withColumnRenamed("component", "parent")))


def _then(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels after their components, or nodes still without one, have moved to ``parents``."""
    up = parents.select(F.col("node").alias("up"), F.col("parent").alias("top"))
    moved = labels.join(up, F.col("component") == F.col("up"), "left").select("node", F.coalesce("top", "component").alias("component"))
    new = parents.join(labels.select(F.col("node").alias("had")), F.col("node") == F.col("had"), "left_anti").select("node", F.col("parent").alias("component"))
    return moved.unionByName(new)
