"""Connected components of an edge table by alternating star contraction.

The large-star / small-star scheme of Kiveris et al. (SoCC 2014): every round points
nodes at smaller neighbours, and a logarithmic number of rounds is usual. Each step is
a combinable minimum and a lookup; no neighbour list is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import freeze


def component_roots(edges: DataFrame, within: Sequence[str]) -> DataFrame:
    """``(within, node, root)`` for every node of ``edges(within, u, v)``.

    ``root`` is the smallest node of the component; edges never leave a ``within`` group.
    """
    within = list(within)
    current = freeze(
        edges.where(F.col("u") != F.col("v"))
        .select(*within, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _signature(current)
    while state[0]:
        current = freeze(_small_star(_large_star(current, within), within))
        following = _signature(current)
        if following == state:
            break
        state = following
    roots = current.select(*within, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(*within, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))
    row = edges.agg(F.count(F.lit(1)).alias("n"), hashed.alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame, within: list[str]) -> DataFrame:
    """Larger neighbours of every node move to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(*within, F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy(*within, "u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("uses")
    )
    moved = spread_lookup(both.where(F.col("v") > F.col("u")), smallest, [*within, "u"], "uses", ["v"])
    return moved.select(*within, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, within: list[str]) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, move to the smallest."""
    smallest = edges.groupBy(*within, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("uses"))
    moved = spread_lookup(edges, smallest, [*within, "u"], "uses", ["v"])
    neighbours = moved.where(F.col("v") != F.col("m")).select(*within, F.col("v").alias("u"), F.col("m").alias("v"))
    selves = smallest.select(*within, "u", F.col("m").alias("v"))
    return neighbours.unionByName(selves).distinct()
