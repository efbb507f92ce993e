"""Auto mode: every newly arrived page is translated once, and every page has a verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagecorpus import schema
from pagecorpus.plans.page_translation import TranslationJob, page_records, page_report, translate_pages
from pagecorpus.session import freeze, scratch, spread
from pagecorpus.sources import store, versions
from pagecorpus.streaming import progress

# Outcomes after which a page is worth another try.
FAILED = (schema.PAGE_FAILED, schema.UNREADABLE_PAGE)
#: Versions between two looks for what can be merged.
MERGE_EVERY = 8


def _verdict(kind: str) -> T.StructType:
    """The columns of a verdict; ``kind`` is the type of a page key as DDL."""
    return T.StructType.fromDDL(f"page_key {kind}, cache_key string, n_blocks bigint, outcome string")


def _verdict_root(root: str) -> str:
    return f"{root.rstrip('/')}-verdicts"


def auto_translate(
    arrivals: DataFrame,
    root: str,
    checkpoint: str,
    to_pages: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    rules: DataFrame,
    translate: Callable[[DataFrame], DataFrame],
    job: TranslationJob,
    revisit: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> StreamingQuery:
    """Process all arrivals seen so far, then stop.

    ``to_pages`` turns a micro-batch into ``(pages, blocks)``. Batch n writes version
    n + 1 of the table below ``root`` and looks only at earlier versions, so a replayed
    batch writes the same records again. Pages translated earlier, or twice in a batch,
    are found by cache key; no stream state grows with the corpus. Each batch also writes
    the outcome of all its pages, see :func:`verdicts`. ``revisit`` turns the page keys that
    failed in earlier batches into ``(pages, blocks)``, which are tried again. The progress of
    every batch is kept (:func:`progress.batch_progress`); a listener
    (:class:`progress.StreamProgress`) sees the rows of each as it ends.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Contents and blocks come from the same rows: the source is read once.
        batch = spread(batch).persist()
        try:
            with scratch(spark):
                pages, blocks = to_pages(batch)
                if revisit is not None and batch_id:
                    failed = freeze(failed_pages(spark, root, pages.schema["page_key"].dataType.simpleString(), batch_id + 1))
                    more_pages, more_blocks = revisit(failed.join(pages.select("page_key"), "page_key", "left_anti"))
                    pages, blocks = pages.unionByName(more_pages), blocks.unionByName(more_blocks)
                translate_batch(pages, blocks, root, batch_id + 1, rules, translate, job)
        finally:
            batch.unpersist()

    store.initialise(arrivals.sparkSession, root)
    return (
        arrivals.observe(progress.ARRIVALS, F.count(F.lit(1)).alias("rows"))
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def translate_batch(
    pages: DataFrame,
    blocks: DataFrame,
    root: str,
    version: int,
    rules: DataFrame,
    translate: Callable[[DataFrame], DataFrame],
    job: TranslationJob,
) -> None:
    """Write records and verdicts of some pages as one version; only their keys are looked up.

    Every ``MERGE_EVERY`` versions earlier ones of about equal size are merged, so that a
    batch opens few files however many came before it.
    """
    spark = pages.sparkSession
    if version % MERGE_EVERY == 0:
        store.merge_versions(spark, root, before=version)
        form = _verdict(pages.schema["page_key"].dataType.simpleString())
        versions.merge(spark, _verdict_root(root), form, "page_key", before=version)
    pages = freeze(pages)
    keys = pages.select(job.key("sha").alias("cache_key")).where(F.col("cache_key").isNotNull())
    known = store.current_keys(spark, root, before=version, keys=keys)
    result = translate_pages(pages, blocks, known, rules, translate, job)
    store.write_version(page_records(result, job), root, version, prefix_length=0)
    written = versions.write(page_report(result), _verdict_root(root), version, "page_key")
    total = F.coalesce(F.sum("n_blocks"), F.lit(0))
    blocks_done = result.outcomes.agg((total - F.coalesce(F.sum("n_failed"), F.lit(0))).alias("completed"), total.alias("total"))
    progress.write_batch_progress(spark, root, version, {**progress.outcome_counts(written), **blocks_done.first().asDict()})


def verdicts(spark: SparkSession, root: str, kind: str = "bigint", before: int | None = None) -> DataFrame:
    """The last outcome of every page seen so far; ``kind`` is the type of its key."""
    stored = versions.read(spark, _verdict_root(root), _verdict(kind), before)
    last = F.max_by(F.struct("cache_key", "n_blocks", "outcome"), "version").alias("_v")
    return stored.groupBy("page_key").agg(last).select("page_key", "_v.*")


def failed_pages(spark: SparkSession, root: str, kind: str = "bigint", before: int | None = None) -> DataFrame:
    """Keys of the pages whose last outcome is a failure."""
    return verdicts(spark, root, kind, before).where(F.col("outcome").isin(*FAILED)).select("page_key")


def parquet_arrivals(spark: SparkSession, folder: str, glob: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files of one folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def once_within(arrivals: DataFrame, time: str, delay: str, sha: str = "sha") -> DataFrame:
    """Drop repeated contents that arrive within ``delay``; the state is bounded by it.

    Optional: the table look-up in :func:`auto_translate` finds repeats of any age.
    """
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark([sha])
