"""Positions within a group, computed without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.session import broadcast_if_small, freeze, shuffle_partitions


def with_positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    neighbours_of: str | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``position`` (1-based) and ``group_size``; with ``neighbours_of`` also ``prev``/``next``.

    Rows are range partitioned on group and order, so a group of any size spreads over
    as many slices as it needs. Numbers inside a slice come from its sorted position and
    are shifted by the row counts of the slices before it. ``order`` has to be total
    within a group; give a unique column last.
    """
    n = slices or shuffle_partitions(df.sparkSession)
    group, order = list(group), list(order)
    sorted_rows = (
        df.repartitionByRange(n, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_seq", 33))
    )
    # Frozen, because slice borders come from a sample and must not move between uses.
    sorted_rows = freeze(sorted_rows)

    measures = [F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows")]
    if neighbours_of:
        measures += [
            F.min_by(neighbours_of, "_seq").alias("_head"),
            F.max_by(neighbours_of, "_seq").alias("_tail"),
        ]
    sizes = sorted_rows.groupBy(*group, "_slice").agg(*measures)
    # At most one row per slice and group: a group has no more rows here than slices.
    everywhere = Window.partitionBy(*group)
    ordered = everywhere.orderBy("_slice")
    shifts = [
        *group,
        "_slice",
        "_first",
        F.coalesce(
            F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_rows").over(everywhere).alias("group_size"),
    ]
    if neighbours_of:
        shifts += [
            F.lag("_tail").over(ordered).alias("_prev_tail"),
            F.lead("_head").over(ordered).alias("_next_head"),
        ]
    offsets = broadcast_if_small(freeze(sizes.select(*shifts)))

    matched = {c: f"_same{i}" for i, c in enumerate([*group, "_slice"])}
    offsets = offsets.withColumnsRenamed(matched)
    same = [F.col(c).eqNullSafe(F.col(m)) for c, m in matched.items()]
    joined = sorted_rows.join(offsets, on=reduce(Column.__and__, same), how="inner")
    result = joined.withColumn("position", F.col("_seq") - F.col("_first") + F.col("_before") + 1)
    helper = ["_seq", "_slice", "_first", "_before", *matched.values()]
    if neighbours_of:
        inside = Window.partitionBy(*group, "_slice").orderBy("_seq")
        result = result.withColumn(
            "prev", F.coalesce(F.lag(neighbours_of).over(inside), F.col("_prev_tail"))
        ).withColumn("next", F.coalesce(F.lead(neighbours_of).over(inside), F.col("_next_head")))
        helper += ["_prev_tail", "_next_head"]
    return result.drop(*helper)

