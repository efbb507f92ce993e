"""Exact deduplication as a stateful stream.

Rows arrive as a file stream. State is keyed by content digest, held by RocksDB on disk and
never expires; it retains the stable identifier of the row that stays, the place of that
row's content, and a count. Before the shuffle every task folds its rows of a digest into
one, so a group of copies of any size costs one row per task. Where a digest is hit more
than once the full bytes are compared, again as a combinable aggregate; a digest that
stands for several texts is resolved by the texts themselves.

:func:`follow` keeps state, updates and progress in a folder of the user, so a later call
reads only the files that have arrived since and meets the groups of all earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.llm.common import FILE, ROW, bare, located, without
from pagecorpus.session import broadcast_if_small, freeze, work_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, keep_id, group_size, kept, digest)`` and the row's
    place in the columns ``PLACE``.

    Texts are equal when all their bytes are; null counts as the empty text. Of equal texts
    the row with the largest identifier stays. Repeated identifiers: of rows that share the
    largest one the last by file and row stays, so exactly one row of a group is kept. A
    null identifier is smaller than any other; a group of nulls only has a null ``keep_id``.
    Other columns are not looked at. An empty table gives no rows.
    """
    rows = located(bare(docs), [F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text")])
    rows = rows.withColumn("digest", digest(F.col("_text")))
    arrivals = freeze(rows.drop("_text"))
    return _decided(rows, arrivals, _final_state(arrivals, files_per_batch))


def follow(
    spark: SparkSession,
    folder: str,
    state: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 64,
) -> DataFrame:
    """:func:`exact_groups` of all rows of the Parquet files in ``folder``, continued from call to call.

    ``state`` is a folder on shared storage. The first call makes it; a later call puts only
    files that are new since into the stream, and the row that stays may change when one with a
    larger identifier arrives. A call that is stopped can be repeated: finished batches aren't
    read again, an unfinished one is replayed. One call at a time may use a ``state``, always
    with the same ``digest``. Files must arrive whole and stay; one that arrives during a call
    belongs to the next. A folder with empty tables only gives no rows.
    """
    source = spark.read.parquet(folder)

    def arrived(files: DataFrame) -> DataFrame:
        found = located(files, [F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text")])
        return found.withColumn("digest", digest(F.col("_text")))

    rows = arrived(source)
    arrivals = freeze(rows.drop("_text"))
    groups = _final_state(
        arrivals,
        files_per_batch,
        lambda session: arrived(
            session.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        ).drop("_text"),
        state.rstrip("/"),
    )
    return _decided(rows, arrivals, groups)


def _decided(rows: DataFrame, arrivals: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with its group, after the bytes of repeated digests have been compared."""
    repeated = broadcast_if_small(groups.where("group_size > 1").select("digest"))
    hits = rows.join(repeated, "digest", "left_semi")
    spread = hits.groupBy("digest").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
    mixed = freeze(spread.where("_low != _high").select("digest"))

    place = F.struct("doc_id", FILE, ROW)
    several = groups.where("group_size > 1")
    joined = arrivals.join(several, "digest", "left")
    if not mixed.isEmpty():
        members = rows.join(broadcast_if_small(mixed), "digest", "left_semi")
        classes = members.groupBy("digest", "_text").agg(
            F.max(place).alias("keeper"), F.count(F.lit(1)).alias("group_size")
        )
        alone = joined.join(broadcast_if_small(mixed), "digest", "left_anti")
        joined = alone.unionByName(members.join(classes, ["digest", "_text"]).drop("_text"))
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(place.eqNullSafe(F.col("keeper"))).alias("kept"),
        "digest",
        FILE,
        ROW,
    )


def _final_state(
    arrivals: DataFrame,
    files_per_batch: int,
    stream_of: Callable[[SparkSession], DataFrame] | None = None,
    state: str | None = None,
) -> DataFrame:
    """``(digest, keeper, group_size)`` after all micro-batches.

    The stream reads the files of ``arrivals`` unless ``stream_of`` makes another. Every batch
    writes the groups it changed below its own number, so a replayed batch writes the same
    rows again. Counts only grow: the largest is the last.
    """
    spark = arrivals.sparkSession
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Many small stores: without this each of them reserves several megabytes of disk.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    if state is None:
        updates, checkpoint = work_path(spark, "updates"), work_path(spark, "stream")
    else:
        updates, checkpoint = f"{state}/updates", f"{state}/stream"
    if stream_of is None and arrivals.inputFiles():
        folder = arrivals.inputFiles()[0].rpartition("/")[0]

        def stream_of(session: SparkSession) -> DataFrame:
            return session.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    keeper = F.max(F.struct("doc_id", FILE, ROW)).alias("keeper")
    counted = F.count(F.lit(1)).alias("group_size")
    none = arrivals.limit(0).groupBy("digest").agg(keeper, counted)
    none.write.mode("ignore").parquet(f"{updates}/batch=-1")
    if stream_of is not None:

        def on_batch(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        run = (
            stream_of(session)
            .groupBy("digest")
            .agg(keeper, counted)
            .writeStream.outputMode("update")
            .foreachBatch(on_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    last = spark.read.schema(none.schema).parquet(updates).groupBy("digest")
    return freeze(
        last.agg(F.max(F.struct("group_size", "keeper")).alias("s")).select("digest", "s.keeper", "s.group_size")
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    source = bare(docs)
    gone = exact_groups(source, doc_id, text).where(~F.col("kept"))
    return without(located(source, source.columns), gone)
