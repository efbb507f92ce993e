"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    uses: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_uses: int = 1_000_000,
    rows_per_salt: int = 250_000,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``facts`` joined to ``lookup`` (unique on ``keys``) with hot keys spread over salts.

    ``lookup[uses]`` is how many fact rows carry the keys, as counted when the lookup was
    built. A key used more than ``hot_uses`` times is copied to several salts and its
    fact rows are dealt out over them by ``spread_by``. There can be no more than
    rows / ``hot_uses`` such keys. No row is dropped or repeated. With ``counts`` the column
    ``uses`` is that table's, and a ``lookup`` that is costly to compute is computed once.
    """
    n_salts = F.ceil(F.col(uses) / F.lit(rows_per_salt)).cast("int")
    hot = (lookup if counts is None else counts).where(F.col(uses) > hot_uses).select(*keys, n_salts.alias("_salts"))
    if hot.isEmpty():
        return facts.join(lookup.drop(uses), list(keys), how)
    if counts is not None:
        lookup = lookup.join(counts.select(*keys, uses), list(keys), "left").withColumn(uses, F.coalesce(uses, F.lit(0)))
    # facts / hot_uses rows at most, each a key and an int.
    salted_facts = (
        facts.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
            ),
        )
        .drop("_salts")
    )
    copies = F.when(F.col(uses) > hot_uses, F.sequence(F.lit(0), n_salts - 1)).otherwise(F.array(F.lit(0)))
    salted_lookup = lookup.withColumn("_salt", F.explode(copies)).drop(uses)
    return salted_facts.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")
