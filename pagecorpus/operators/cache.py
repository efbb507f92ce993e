"""Reuse of earlier translations: hits, misses, upserts, deletes, content groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import freeze


def cache_hits(pages: DataFrame, cache: DataFrame, artefacts: DataFrame | None = None, key: str = "cache_key") -> DataFrame:
    """Pages with a cached record, each once; with ``artefacts`` the rendered file must exist too."""
    hits = pages.join(cache.select(key), key, "left_semi")
    if artefacts is not None:
        hits = hits.join(artefacts.select(key), key, "left_semi")
    return hits


def cache_misses(
    pages: DataFrame,
    cache: DataFrame,
    artefacts: DataFrame | None = None,
    force: bool | DataFrame = False,
    key: str = "cache_key",
) -> DataFrame:
    """Pages still to do. ``force`` sends every page to this side, or those of a key table."""
    if force is True:
        return pages
    done = cache.select(key)
    if isinstance(force, DataFrame):
        done = done.join(force.select(key), key, "left_anti")
    if artefacts is not None:
        done = done.join(artefacts.select(key), key, "left_semi")
    return pages.join(done, key, "left_anti")


def latest_per_key(records: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per key: the greatest by ``order`` (combines before the shuffle)."""
    rest = [c for c in records.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return records.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*records.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """New records replace old ones with the same key; ``order`` settles duplicates in ``new``."""
    fresh = latest_per_key(new, keys, order) if order else new
    kept = old.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh)


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove records by key; keys that are not there do nothing."""
    return old.join(gone.select(*keys), list(keys), "left_anti")


def content_groups(pages: DataFrame, sha: str = "sha", page: str = "page_id") -> DataFrame:
    """One unit of work per distinct content: its first page and the number of copies."""
    return pages.groupBy(sha).agg(F.min(page).alias("first_page"), F.count(F.lit(1)).alias("n_copies"))


def content_members(pages: DataFrame, groups: DataFrame, sha: str = "sha", page: str = "page_id") -> DataFrame:
    """Every page with the page that stands for its content (the path list, one row each)."""
    keepers = freeze(groups.select(sha, "first_page", "n_copies"))
    return spread_lookup(pages.select(page, sha), keepers, [sha], "n_copies", [page])
