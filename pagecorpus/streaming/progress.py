"""Progress of a translation run: per page, of a running action, and per batch of a stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from pagecorpus import schema
from pagecorpus.sources import versions

#: What a batch of auto mode has done; ``batch`` is its version of the table.
BATCH = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("batch", "pages", "cached", "translated", "failed", "empty", "unreadable", "completed", "total")
    ]
)
#: Name of the observation by which a stream counts its rows.
ARRIVALS = "arrivals"


def page_progress(blocks: DataFrame, key: str = "page_key") -> DataFrame:
    """Completed and total blocks per page."""
    done = F.col("status") == schema.OK
    return blocks.groupBy(key).agg(
        F.count_if(done).alias("completed"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if(done) == F.count(F.lit(1))).alias("finished"),
    )


def observed(blocks: DataFrame, name: str = "translation_progress") -> tuple[DataFrame, Observation]:
    """Count completed and total blocks while another action runs."""
    observation = Observation(name)
    counts = [
        F.count_if(F.col("status") == schema.OK).alias("completed"),
        F.count(F.lit(1)).alias("total"),
    ]
    return blocks.observe(observation, *counts), observation


def outcome_counts(report: DataFrame) -> dict[str, int]:
    """Pages of a report, in all and by outcome."""
    is_ = lambda outcome: F.count_if(F.col("outcome") == outcome)
    counts = report.agg(
        F.count(F.lit(1)).alias("pages"),
        is_("cached").alias("cached"),
        is_("translated").alias("translated"),
        is_(schema.PAGE_FAILED).alias("failed"),
        is_(schema.NO_TEXT_BLOCKS).alias("empty"),
        is_(schema.UNREADABLE_PAGE).alias("unreadable"),
    )
    return counts.first().asDict()


def progress_root(root: str) -> str:
    return f"{root.rstrip('/')}-progress"


def write_batch_progress(spark: SparkSession, root: str, batch: int, counts: dict[str, int]) -> None:
    """Commit one row as the progress of a batch; a replayed batch replaces its row."""
    row = spark.createDataFrame([tuple({"batch": batch, **counts}.get(f.name) for f in BATCH.fields)], BATCH)
    versions.write(row, progress_root(root), batch, "batch")


def batch_progress(spark: SparkSession, root: str) -> DataFrame:
    """One row per batch of an auto mode's table: pages by outcome, completed and total blocks."""
    return versions.read(spark, progress_root(root), BATCH).drop("version")


class StreamProgress(StreamingQueryListener):
    """Follows running streams: batch number, rows that arrived and seconds taken, as each batch ends.

    Register it with ``spark.streams.addListener``. ``told`` is called with every row, and
    ``rows`` keeps those of the last ``keep`` batches. Rows are what the stream's observation
    ``ARRIVALS`` counted, else what Spark reports as input.
    """

    def __init__(self, told: Callable[[dict], None] | None = None, keep: int = 1000):
        self.told, self.keep = told, keep
        self.rows: list[dict] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(ARRIVALS)
        row = {
            "query": str(progress.id),
            "batch": progress.batchId,
            "rows": progress.numInputRows if seen is None else seen["rows"],
            "seconds": progress.durationMs.get("triggerExecution", 0) / 1000,
        }
        self.rows = [*self.rows, row][-self.keep :]
        if self.told is not None:
            self.told(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
