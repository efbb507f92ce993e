"""From page manifest and text blocks to cached page translations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.functions.keys import block_id, cache_key
from pagecorpus.operators.blocks import assemble_pages, explode_pages
from pagecorpus.operators.cache import cache_hits, cache_misses, content_groups
from pagecorpus.operators.glossary import is_inline, refine
from pagecorpus.operators.skew import spread_lookup
from pagecorpus.operators.translate import apply_memo, distinct_texts
from pagecorpus.session import freeze, is_frozen


@dataclass(frozen=True)
class TranslationJob:
    """Options of one run. ``languages_in_key`` keeps language pairs apart in the cache.

    ``force`` translates every page again; :func:`translate_pages` also takes a key table.
    ``exact_text`` asks for texts as they stand, see ``exact`` of :func:`memo_translate`.
    """

    engine_version: str
    provider: str = "google_web"
    source_language: str = "ja"
    target_language: str = "ko"
    force: bool = False
    cache_empty: bool = False
    languages_in_key: bool = False
    exact_text: bool = False

    def __post_init__(self) -> None:
        for code in (self.source_language, self.target_language):
            if code not in schema.LANGUAGES:
                raise ValueError(f"unknown language {code!r}; known are {', '.join(schema.LANGUAGES)}")

    def key(self, sha: Column | str) -> Column:
        languages = (self.source_language, self.target_language) if self.languages_in_key else None
        return cache_key(sha, self.engine_version, self.provider, languages)


@dataclass(frozen=True)
class TranslatedPages:
    """``pages``: every page with its cache key, null if its content has no hash. ``groups``:
    each cache key once, with its first page and its number of copies. ``hits``: groups the
    cache answers. ``units``: groups to translate, with the first page that has blocks (or
    the first) and their number. ``outcomes``: blocks and failed blocks of units with text.
    ``processed``: all their blocks with a status. ``blocks``: corrected blocks of units
    without failure. ``quarantine``: blocks of the other units. ``empty``: units of which no
    copy has text."""

    pages: DataFrame
    groups: DataFrame
    hits: DataFrame
    units: DataFrame
    outcomes: DataFrame
    processed: DataFrame
    blocks: DataFrame
    quarantine: DataFrame
    empty: DataFrame


def corrected_memo(
    blocks: DataFrame, rules: DataFrame, translate: Callable[[DataFrame], DataFrame], exact: bool = False
) -> DataFrame:
    """Translated and corrected once per distinct text; frozen, since calls may be costly."""
    memo = translate(distinct_texts(blocks, exact=exact))
    if not is_inline(rules):
        # Joined correction reads its input more than once.
        memo = freeze(memo)
    refined = refine(memo, rules, ["text"], source="text", out="_refined")
    # Blocks find their text by its key, so the text itself is not kept once more.
    return freeze(refined.select("text_key", "uses", F.col("_refined").alias("translated_text"), "status", "error"))


def translate_pages(
    pages: DataFrame,
    blocks: DataFrame,
    cache: DataFrame,
    rules: DataFrame,
    translate: Callable[[DataFrame], DataFrame],
    job: TranslationJob,
    artefacts: DataFrame | None = None,
    force: DataFrame | None = None,
) -> TranslatedPages:
    """Fingerprint, look up, translate what is missing, correct, keep whole pages only.

    ``pages(page_key, sha)``, ``blocks(page_key, pos, original_text, ...)``,
    ``cache(cache_key)``; pages of equal content are one unit of work, done with the blocks
    of the first copy that has any. ``force(cache_key)`` lists pages to do again. A page
    without hash is no copy of another and never reaches the cache. ``blocks`` is read twice:
    its page keys to choose the copies, then the blocks of the chosen ones.
    """
    # Contents are hashed in one pass; from here on pages are a key table.
    keyed = pages.select("page_key", job.key("sha").alias("cache_key"))
    keyed = keyed if is_frozen(pages) else freeze(keyed)
    # Equal contents first: what follows sees each cache key once, however many copies it has.
    readable = keyed.where(F.col("cache_key").isNotNull())
    groups = content_groups(readable, "cache_key", "page_key").withColumnRenamed("first_page", "page_key")
    missed = cache_misses(groups, cache, artefacts, job.force or (False if force is None else force))
    # Which copy has blocks shows only in the blocks. Their number also tells whether the rows
    # of a page have to be spread.
    sizes = blocks.groupBy("page_key").agg(F.count(F.lit(1)).alias("page_blocks")).join(readable, "page_key")
    chosen = sizes.groupBy("cache_key").agg(F.min_by(F.struct("page_key", "page_blocks"), "page_key").alias("_first"))
    units = freeze(
        missed.join(chosen, "cache_key", "left")
        .withColumn("page_key", F.coalesce("_first.page_key", "page_key"))
        .withColumn("page_blocks", F.col("_first.page_blocks"))
        .drop("_first")
    )
    hits = cache_hits(groups, cache, artefacts).join(units.select("cache_key"), "cache_key", "left_anti")
    with_text = units.where(F.col("page_blocks").isNotNull()).select("page_key", "cache_key", "page_blocks")
    work = freeze(spread_lookup(blocks, with_text, ["page_key"], "page_blocks", ["pos"]))
    memo = corrected_memo(work, rules, translate, job.exact_text)
    # The memo cost the calls and is kept; joining it again is cheaper than keeping the blocks twice.
    done = apply_memo(work, memo, exact=job.exact_text).drop("uses")
    failed = F.count_if(F.col("status") != schema.OK).alias("n_failed")
    outcomes = freeze(done.groupBy("cache_key", "page_key").agg(F.count(F.lit(1)).alias("n_blocks"), failed))
    # By cache key, as records are assembled, stored and joined to their pages.
    marked = spread_lookup(done, outcomes.drop("page_key"), ["cache_key"], "n_blocks", ["pos"])
    complete = marked.where("n_failed = 0").drop("n_failed")
    quarantine = marked.where("n_failed > 0").withColumn("page_status", F.lit(schema.PAGE_FAILED))
    empty = units.where(F.col("page_blocks").isNull()).withColumn("status", F.lit(schema.NO_TEXT_BLOCKS))
    return TranslatedPages(keyed, groups, hits, units, outcomes, done, complete, quarantine, empty)


def page_records(result: TranslatedPages, job: TranslationJob, created_at: Column | None = None) -> DataFrame:
    """Cache records of the translated pages (and of empty ones, if the job says so)."""
    blocks = result.blocks
    if "id" not in blocks.columns:
        blocks = blocks.withColumn("id", block_id("cache_key", "pos"))
    names = blocks.columns
    fields = [
        (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.BLOCK.fields
        if f.name != "pos"
    ]
    documents = assemble_pages(blocks, fields, ["cache_key"], more=[F.min("page_key").alias("page_key")])
    if job.cache_empty:
        nothing = result.empty.select(
            "cache_key", F.lit(0).alias("segment"), F.array().cast("array<" + schema.BLOCK.simpleString() + ">").alias("blocks"), "page_key"
        )
        documents = documents.unionByName(nothing)
    stamp = created_at if created_at is not None else F.current_timestamp()
    return documents.select(
        "cache_key",
        "segment",
        F.col("page_key").cast("string").alias("image_url"),
        F.lit(job.source_language).alias("source_language"),
        F.lit(job.target_language).alias("target_language"),
        stamp.alias("created_at"),
        "blocks",
    )


def page_report(result: TranslatedPages) -> DataFrame:
    """One row per page: cached, translated, page_failed, no_text_blocks or unreadable_page.

    Pages of equal content share the outcome of the page that stands for them.
    """
    units = result.units.select("cache_key", "n_copies").join(result.outcomes.drop("page_key"), "cache_key", "left")
    state = F.when(F.col("n_failed").isNull(), schema.NO_TEXT_BLOCKS).when(F.col("n_failed") > 0, schema.PAGE_FAILED)
    units = units.withColumn("outcome", state.otherwise("translated")).drop("n_failed")
    pages = result.pages.select("page_key", "cache_key")
    readable = pages.where(F.col("cache_key").isNotNull())
    joined = spread_lookup(readable, units, ["cache_key"], "n_copies", ["page_key"], how="left")
    report = joined.select(
        "page_key",
        "cache_key",
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
        F.coalesce("outcome", F.lit("cached")).alias("outcome"),
    )
    unreadable = pages.where(F.col("cache_key").isNull())
    return report.unionByName(
        unreadable.select(
            "page_key", "cache_key", F.lit(0).cast("bigint").alias("n_blocks"), F.lit(schema.UNREADABLE_PAGE).alias("outcome")
        )
    )


def page_results(result: TranslatedPages, cached: DataFrame, records: DataFrame) -> DataFrame:
    """The blocks of every page after the job, copies included: ``(page_key, cache_key, origin, pos, ...)``.

    ``cached`` and ``records`` are stored records before the job and those it made; a new
    record goes before a cached one. Pages without a record have no rows.
    """
    kept = cached.join(records.select("cache_key"), "cache_key", "left_anti")
    pages = result.pages.select("page_key", "cache_key").where(F.col("cache_key").isNotNull())
    groups = freeze(result.groups.select("cache_key", "n_copies"))
    sides = []
    # One after the other: records that lie by cache key already are joined where they lie.
    for known, origin in ((kept, "cached"), (records, "translated")):
        found = known.select("cache_key", "blocks").withColumn("origin", F.lit(origin))
        joined = spread_lookup(pages, found, ["cache_key"], "n_copies", ["page_key"], counts=groups)
        sides.append(explode_pages(joined, ["page_key", "cache_key", "origin"]))
    return sides[0].unionByName(sides[1])
