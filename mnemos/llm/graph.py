"""Cutting lineage, and connected components."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.functions.shared import settled as cut


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): the smallest node that can be reached.

    First every node gives way to its least neighbour, if that is smaller, as long as this halves the edges: those that become loops are dropped and
    of equal ones one is left, so what a group's many edges say isn't met again in every round. Over the rest, each round takes the least label
    among a node's neighbours and then that label's own label, so distances halve; hubs are pre-aggregated before their rows meet. No edges: no rows.
    """
    left = cut(edges.where("a <> b").select(*_ordered("a", "b")).distinct())
    many, gone = left.count(), []
    while many:
        least = _both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
        gone.append(least)
        to = lambda of, its: least.select(F.col("node").alias(of), F.col("label").alias(its))  # noqa: E731, B023
        left = cut(left.join(to("a", "of_a"), "a").join(to("b", "of_b"), "b").where("of_a <> of_b").select(*_ordered("of_a", "of_b")).distinct())
        before, many = many, left.count()
        if 2 * many > before:
            break
    labels = _settled_labels(left, rounds) if many else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for least in reversed(gone):
        end = labels.select(F.col("node").alias("of"), F.col("label").alias("end"))
        labels = least.join(end, F.col("label") == F.col("of"), "left").select("node", F.coalesce("end", "label").alias("label"))
    return cut(labels) if gone else labels


def _ordered(a: str, b: str) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _settled_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """`components` of distinct edges, which meet the labels in every round."""
    both = _both(edges)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        nearer = labels.join(near, labels["node"] == near["n"], "left").select("node", F.col("label").alias("was"), F.least("label", "m").alias("to"))
        own = labels.select(F.col("node").alias("of"), F.col("label").alias("its"))
        jumped = cut(nearer.join(own, F.col("to") == F.col("of"), "left").select("node", "was", F.least("to", "its").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
