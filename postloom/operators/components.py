"""Connected components of a graph given as pairs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def connected_components(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """One row (id, component) for each vertex of a pair; component is the smallest id that can be reached.

    Every round each vertex points to the first of itself and its neighbours in an order, the pairs are rewritten
    to the vertices pointed to, and those that became one vertex go; rounds end when no pair is left. The first
    two orders are those of the ids, which settle stars; the later ones are by a hash that differs by round, so
    about a quarter of the vertices or more go in each, whatever the shape, and rounds grow with the logarithm
    of the vertices (ids alone would take a round for each vertex of an ascending chain). Any neighbour is a
    right choice, so equal hashes do no harm. Hubs are aggregated map-side before the shuffle. Pairs with a null
    end are ignored, self pairs give a component of one.
    """
    edges = stored(
        pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .distinct(),
        "cc-edges",
    )
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"))
    edges = edges.where("a <> b")
    for k in count():
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        if k < 2:
            hop = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("v"), F.least("a", "to").alias("to"))
        else:
            order = lambda c: F.xxhash64(F.lit(k), c)  # noqa: B023, E731
            hop = both.groupBy("a").agg(F.min_by("b", order("b")).alias("to")).select(F.col("a").alias("v"), F.when(order("to") < order("a"), F.col("to")).otherwise(F.col("a")).alias("to"))
        hop = stored(hop, "cc-hop")
        labels = stored(_moved(labels, hop), "cc-labels")
        moved = _small(hop)
        at_a = moved.select(F.col("v").alias("a"), F.col("to").alias("a2"))
        at_b = moved.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        edges = stored(
            edges.join(at_a, "a").join(at_b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            "cc-edges",
        )
    least = labels.groupBy("component").agg(F.min("id").alias("to")).where("component <> to").select(F.col("component").alias("v"), "to")
    return _moved(labels, stored(least, "cc-least"))


def _small(hop: DataFrame) -> DataFrame:
    return F.broadcast(hop) if hop.count() < 10_000 else hop


def _moved(labels: DataFrame, hop: DataFrame) -> DataFrame:
    return labels.join(_small(hop), labels["component"] == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component"))
