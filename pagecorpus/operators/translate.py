"""Translation: memoised per distinct text, from a table or a user's callable."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus import schema
from pagecorpus.functions.text import WHITE_SPACE, is_blank, utrim
from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import freeze, is_small
from pagecorpus.sources.remote import filesystem

Translator = Callable[[str, str, str], str]

# Calls in flight when nothing is configured, and the accepted range.
DEFAULT_CONCURRENCY = 4
MIN_CONCURRENCY, MAX_CONCURRENCY = 1, 8

# Lists of failed pages up to this length are broadcast.
BROADCAST_PAGES = 200_000


def resolve_concurrency(environment: str | None = None, configured: int | None = None) -> int:
    """Calls in flight: a numeric environment value, else the configured one, else four."""
    try:
        wanted = int(environment)
    except (TypeError, ValueError):
        wanted = DEFAULT_CONCURRENCY if configured is None else configured
    return min(max(wanted, MIN_CONCURRENCY), MAX_CONCURRENCY)


def passthrough(blocks: DataFrame, source: str = "original_text", target: str = "translated_text") -> DataFrame:
    """Trimmed source as translation; blank text gets status ``empty_text``."""
    blank = is_blank(source)
    return blocks.withColumn(target, F.when(~blank, utrim(source))).withColumn(
        "status", F.when(blank, schema.EMPTY_TEXT).otherwise(schema.OK)
    )


def text_key(text: Column | str) -> Column:
    """What texts are looked up by: 32 bytes, whatever their length."""
    return F.unhex(F.sha2(text, 256))


def _asked(source: str, exact: bool) -> tuple[Column, Column]:
    """The text that is looked up, and whether there is none; see :func:`memo_translate`."""
    return (F.col(source), F.col(source).isNull()) if exact else (utrim(source), is_blank(source))


def distinct_texts(blocks: DataFrame, source: str = "original_text", exact: bool = False) -> DataFrame:
    """``(text_key, text, uses)``: each distinct text once, trimmed unless ``exact``, with the blocks that use it."""
    text, blank = _asked(source, exact)
    texts = blocks.where(~blank).select(text.alias("text"))
    counted = texts.groupBy("text").agg(F.count(F.lit(1)).alias("uses"))
    return counted.select(text_key("text").alias("text_key"), "text", "uses")


def _caller(translator: Translator, source_language: str, target_language: str) -> Callable:
    """``text -> (translated_text, status, error)`` that never raises."""

    def call(text: str) -> tuple[str | None, str, str | None]:
        trimmed = "" if text is None else text.strip(WHITE_SPACE)
        if not trimmed:
            return None, schema.EMPTY_TEXT, None
        try:
            answer = translator(text, source_language, target_language)
            return answer, schema.MISSING_TRANSLATION if answer is None else schema.OK, None
        except Exception as failure:  # the user's callable may raise anything
            return None, schema.TRANSLATOR_ERROR, f"{type(failure).__name__}: {failure}"

    return call


def enrich(
    texts: DataFrame,
    translator: Translator,
    source_language: str = "ja",
    target_language: str = "ko",
    concurrency: int = DEFAULT_CONCURRENCY,
    tasks: int | None = None,
    whole_run: bool = False,
    journal: str | None = None,
) -> DataFrame:
    """Call ``translator`` for every ``text``; failures become rows with a status.

    At most ``concurrency`` calls are in flight per task, so ``tasks`` times that many in the
    cluster; without ``tasks`` the partitions of ``texts`` decide. With ``whole_run`` they are
    the limit of the whole run: a barrier stage of at most that many tasks, which start
    together and share the calls by their number, so more tasks never mean more calls.

    With ``journal``, a folder on shared storage, ``texts`` needs ``text_key``, unique per text.
    Every chunk of answers is put there as it is complete. Texts answered before, by an
    earlier run or an earlier attempt of a task, are not asked again; failures are. Without
    it a repeated task repeats its calls. Other columns are kept. Freeze the result before
    using it twice: an unfrozen plan calls again.
    """
    limit = resolve_concurrency(configured=concurrency)
    columns = [c for c in texts.columns if c not in ("translated_text", "status", "error")]
    source = texts.select(*columns)
    known = None
    if journal is not None:
        answers = answered(source.sparkSession, journal, source_language, target_language)
        # Frozen: what is asked must not change while answers are put into the journal.
        source = freeze(source.join(answers, "text_key", "left"))
        known = source.where(F.col("translated_text").isNotNull())
        source = source.where(F.col("translated_text").isNull()).select(*columns)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    call = _caller(translator, source_language, target_language)
    run_id, shared = uuid.uuid4().hex, whole_run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get() if shared else TaskContext.get()
        share = limit
        if shared:
            workers = len(context.getTaskInfos())
            share = limit // workers + (context.partitionId() < limit % workers)
        notes = None if journal is None else TaskJournal(journal, run_id, context.partitionId(), source_language, target_language)
        with ThreadPoolExecutor(max_workers=share) as pool:
            for batch in batches:
                for at in range(0, len(batch), JOURNAL_ROWS):
                    part = batch.iloc[at : at + JOURNAL_ROWS]
                    # Answers of an earlier attempt of this task.
                    old = {} if notes is None else {k: notes.known[bytes(k)] for k in part["text_key"] if bytes(k) in notes.known}
                    asked = list(pool.map(lambda r: (r, call(r[1])), [r for r in zip(part.get("text_key", part.index), part["text"]) if r[0] not in old]))
                    if notes is not None:
                        notes.put([(k, a[0]) for (k, _), a in asked if a[1] == schema.OK])
                    found = {k: (a, schema.OK, None) for k, a in old.items()} | {k: a for (k, _), a in asked}
                    rows = [found[k] for k in part.get("text_key", part.index)]
                    columns = zip(*rows) if rows else [[], [], []]
                    yield part.assign(**{n: list(c) for n, c in zip(("translated_text", "status", "error"), columns)})

    if shared:
        source = source.repartition(min(tasks or limit, limit))
    elif tasks:
        source = source.repartition(tasks)
    made = source.mapInPandas(run, schema=f"{out}, translated_text string, status string, error string", barrier=shared)
    if known is None:
        return made
    # A barrier stage can't hold other rows than its own.
    made = freeze(made) if shared else made
    kept = known.withColumns({"status": F.lit(schema.OK), "error": F.lit(None).cast("string")})
    return made.unionByName(kept.select(*made.columns))


ANSWER = T.StructType(
    [T.StructField("text_key", T.BinaryType())]
    + [T.StructField(n, T.StringType()) for n in ("source_language", "target_language", "translated_text")]
)
#: Answers that are put into the journal together: at most as many are asked twice.
JOURNAL_ROWS = 64


class TaskJournal:
    """Answers of one task in the journal: what earlier attempts of it left, and new chunks.

    A chunk is one Parquet file, written under a hidden name and renamed when it is complete.
    """

    def __init__(self, journal: str, run: str, task: int, source_language: str, target_language: str):
        self.files, base = filesystem(journal.rstrip("/"))
        self.folder, self.languages = f"{base}/run={run}/task={task}", (source_language, target_language)
        self.files.create_dir(self.folder)
        self.known: dict[bytes, str] = {}
        found = self.files.get_file_info(FileSelector(self.folder))
        for f in found:
            if f.base_name.startswith("answers"):
                rows = pq.read_table(f.path, filesystem=self.files, partitioning=None)
                self.known.update(zip(rows["text_key"].to_pylist(), rows["translated_text"].to_pylist()))

    def put(self, answers: list[tuple[bytes, str]]) -> None:
        if not answers:
            return
        keys, texts = zip(*answers)
        form = pa.schema([("text_key", pa.binary()), *((n, pa.string()) for n in ("source_language", "target_language", "translated_text"))])
        rows = pa.table([list(map(bytes, keys)), *([x] * len(keys) for x in self.languages), list(texts)], schema=form)
        name = uuid.uuid4().hex
        pq.write_table(rows, f"{self.folder}/_{name}", filesystem=self.files)
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/answers-{name}.parquet")


def answered(spark: SparkSession, journal: str, source_language: str, target_language: str) -> DataFrame:
    """``(text_key, translated_text)``: the answers in the journal for a pair of languages, each text once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(journal)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = spark.createDataFrame([], ANSWER)
    else:
        rows = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(journal)
    rows = rows.where((F.col("source_language") == source_language) & (F.col("target_language") == target_language))
    return rows.groupBy("text_key").agg(F.min("translated_text").alias("translated_text"))


def from_memory(texts: DataFrame, memory: DataFrame) -> DataFrame:
    """Translations from a translation-memory table ``(text, translated_text)``, unique on text."""
    found = texts.join(memory.select("text", "translated_text"), "text", "left")
    return found.withColumn(
        "status", F.when(F.col("translated_text").isNull(), schema.MISSING_TRANSLATION).otherwise(schema.OK)
    ).withColumn("error", F.lit(None).cast("string"))


def apply_memo(
    blocks: DataFrame,
    memo: DataFrame,
    keys: Sequence[str] = ("page_key", "pos"),
    source: str = "original_text",
    exact: bool = False,
) -> DataFrame:
    """Memo rows ``(text_key, uses, translated_text, status, error)`` back onto the blocks.

    Blank blocks are looked up by a short key of their own, which spreads them and matches
    no text.
    """
    text, blank = _asked(source, exact)
    alone = F.unhex(F.hex(F.xxhash64(*keys)))
    keyed = blocks.withColumns({"text_key": F.when(blank, alone).otherwise(text_key(text)), "_blank": blank})
    joined = spread_lookup(keyed, memo.drop("text"), ["text_key"], "uses", keys, how="left")
    missing = F.coalesce("status", F.lit(schema.MISSING_TRANSLATION))
    # Asked of the text before it is looked up: statuses alone move no text.
    return joined.withColumn("status", F.when(F.col("_blank"), schema.EMPTY_TEXT).otherwise(missing)).drop("text_key", "_blank")


def memo_translate(
    blocks: DataFrame,
    translate: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("page_key", "pos"),
    source: str = "original_text",
    exact: bool = False,
) -> DataFrame:
    """Translate each distinct text once and join back.

    ``translate`` maps ``(text_key, text, uses)`` to the memo, e.g. ``lambda t: enrich(t, fn)``.
    The memo is frozen: it is read more than once and may have cost service calls. Texts are
    trimmed, and blank ones not asked. With ``exact`` they are asked as they stand, the empty
    one too, and only null is blank: for a memory whose texts were kept untrimmed.
    """
    memo = freeze(translate(distinct_texts(blocks, source, exact)))
    return apply_memo(blocks, memo, keys, source, exact)


def split_pages(blocks: DataFrame, key: str = "page_key", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """All-or-nothing pages: ``(complete, quarantined)`` block tables.

    One failing block sends its whole page to quarantine. Failing pages are reduced to
    a list of keys first; no page is gathered in one task.
    """
    failing = F.count_if(F.col("status") != schema.OK)
    per_page = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"), failing.alias("n_failed"))
    failed = freeze(per_page.where(F.col("n_failed") > 0))
    if is_small(failed, BROADCAST_PAGES):
        marked = blocks.join(F.broadcast(failed.drop("_uses")), key, "left")
    else:
        marked = spread_lookup(blocks, failed, [key], "_uses", [pos], how="left")
    complete = marked.where(F.col("n_failed").isNull()).drop("n_failed")
    quarantined = marked.where(F.col("n_failed").isNotNull()).withColumn("page_status", F.lit(schema.PAGE_FAILED))
    return complete, quarantined


def page_status(blocks: DataFrame, key: str = "page_key") -> DataFrame:
    """Verdict per page: ok only when every block is."""
    return blocks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("status") != schema.OK).alias("n_failed"),
        F.when(F.bool_and(F.col("status") == schema.OK), schema.OK).otherwise(schema.PAGE_FAILED).alias("page_status"),
    )
