"""Distributed union-find: connected components by repeated contraction. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SALTS = 8


def relabel(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """rows with column replaced by its parent in parents(_node, _parent), where it has one.

    A component may hold a third of all rows, so rows are salted and the parents, one row a node, repeated a salt each.
    """
    names = rows.columns
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    spread = parents.select(F.col("_node").alias("_from"), F.col("_parent").alias("_to"), salts)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")).withColumn("_from", F.col(column))
    # parents grow with the data, so they are shuffled and never pass through the driver as a broadcast
    joined = salted.join(spread.hint("merge"), ["_from", "_salt"], "left")
    return joined.select(*[F.coalesce("_to", column).alias(column) if c == column else F.col(c) for c in names])


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftright(x, 32).cast("int"), F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def _whole(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def scrambled(x: Column) -> Column:
    """A pseudo-random one-to-one image of a long: three rounds of a Feistel network."""
    high, low = _halves(x)
    high = high.bitwiseXOR(F.hash(low, F.lit(1)))
    low = low.bitwiseXOR(F.hash(high, F.lit(2)))
    return _whole(high.bitwiseXOR(F.hash(low, F.lit(3))), low)


def unscrambled(y: Column) -> Column:
    high, low = _halves(y)
    high = high.bitwiseXOR(F.hash(low, F.lit(3)))
    low = low.bitwiseXOR(F.hash(high, F.lit(2)))
    return _whole(high.bitwiseXOR(F.hash(low, F.lit(1))), low)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b), both long: the smallest node that it is joined with.

    Nodes are put in a pseudo-random order, so that a long chain of rising ids breaks into short ones. In each round
    every node takes its smallest neighbour for a parent, each parent gives way to its own, and the edges are contracted
    to the parents; loops and repeats go. Nodes only take smaller parents, so one is left of each component. Plans stay
    small: edges and parents are written to the shared checkpoint folder in each round, labels in every third, as tables,
    so that the sizes known of them are true ones.
    """
    edges = written(_ordered(edges.select(scrambled(F.col("a")).alias("a"), scrambled(F.col("b")).alias("b"))))
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).limit(0)
    rounds = 0
    while not edges.isEmpty():
        smallest = edges.groupBy(F.col("b").alias("_node")).agg(F.min("a").alias("_parent"))
        parents = written(relabel(smallest, "_parent", smallest))
        labels = relabel(labels, "component", parents).unionByName(parents.select(F.col("_node").alias("node"), F.col("_parent").alias("component")))
        rounds += 1
        if rounds % 3 == 0:
            labels = written(labels)
        edges = written(_ordered(relabel(relabel(edges, "a", parents), "b", parents)))
    # a node whose parent was not a root yet may come back in a later round; both its rows end at the same root
    labels = written(labels.groupBy("node").agg(F.min("component").alias("component")))
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    plain = labels.select(unscrambled(F.col("node")).alias("node"), "component")
    smallest = plain.groupBy(F.col("component").alias("_node")).agg(F.min("node").alias("_parent"))
    return written(relabel(plain, "component", smallest))


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components when edges(a, b) are added to those of labels(node, component): only components are united."""
    between = written(relabel(relabel(edges.select("a", "b"), "a", _parents(labels)), "b", _parents(labels)))
    if between.isEmpty():
        return labels
    merged = connected_components(between)
    new = merged.select("node").join(labels.select("node").hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return written(relabel(labels.unionByName(new), "component", _parents(merged)))


def _parents(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("_node"), F.col("component").alias("_parent"))
