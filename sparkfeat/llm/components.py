"""Connected components of an edge table, without collecting links or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.sources.store import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Stored, so that both sides of the join that follows are dealt out by it alone and the
    rows of a node with very many edges can be split."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its least neighbour."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to its least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_neighbour(down), "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Every node that has an edge (``u``), with the least node of its component (``v``).

    Large stars and small stars alternate until the edges, all then from a node to its least
    one, no longer change. Every round is stored, so a lost executor repeats one round at most.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == state:
            return edges
        state = now
