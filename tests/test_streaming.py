from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.operators import translate as tr
from pagecorpus.operators.cache import cache_hits
from pagecorpus.plans.page_translation import TranslationJob, page_records, page_report, page_results, translate_pages
from pagecorpus.sources import store, versions
from pagecorpus.streaming.auto_mode import auto_translate, failed_pages, parquet_arrivals, verdicts
from pagecorpus.streaming.progress import StreamProgress, batch_progress, observed, page_progress

JOB = TranslationJob(engine_version="engine-v1")
DOCUMENT = "page_key int, content string"


def to_pages(batch):
    pages = batch.select("page_key", F.sha2("content", 256).alias("sha"))
    lines = F.posexplode(F.split("content", "\n")).alias("pos", "original_text")
    return pages, batch.where("content <> ''").select("page_key", lines)


def shout(texts):
    return texts.withColumns(
        {"translated_text": F.upper("text"), "status": F.lit("ok"), "error": F.lit(None).cast("string")}
    )


def test_new_pages_are_translated_once(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    rules = spark.createDataFrame([(0, ["b"], [("B", "bee")])], schema.RULES)

    def arrive(rows):
        spark.createDataFrame(rows, DOCUMENT).coalesce(1).write.mode("append").parquet(folder)
        arrivals = parquet_arrivals(spark, folder, "*.parquet", DOCUMENT)
        auto_translate(arrivals, root, checkpoint, to_pages, rules, shout, JOB).awaitTermination()
        current = store.read_current(spark, root)
        return {tuple(b.translated_text for b in r.blocks): r.created_at for r in current.collect()}

    first = arrive([(1, "a\nb"), (2, "a\nb"), (3, "c"), (4, ""), (5, "x\n \ny")])
    assert set(first) == {("A", "bee"), ("C",)}
    second = arrive([(6, "c"), (7, "d\nc")])
    assert set(second) == {("A", "bee"), ("C",), ("D", "C")}
    assert second[("C",)] == first[("C",)]
    outcome = {r.page_key: r.outcome for r in verdicts(spark, root, "int").collect()}
    failed = {4: schema.NO_TEXT_BLOCKS, 5: schema.PAGE_FAILED}
    assert outcome == {1: "translated", 2: "translated", 3: "translated", 6: "cached", 7: "translated"} | failed
    assert [r.page_key for r in failed_pages(spark, root, "int").collect()] == [5]


def test_failed_pages_come_back(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    rules = spark.createDataFrame([], schema.RULES)
    mended = spark.createDataFrame([(1, "a\nb"), (2, "z")], DOCUMENT)

    def again(failed):
        return to_pages(mended.join(failed, "page_key", "left_semi"))

    for rows in ([(1, "a\n \nb"), (2, "c")], [(3, "d")]):
        spark.createDataFrame(rows, DOCUMENT).coalesce(1).write.mode("append").parquet(folder)
        arrivals = parquet_arrivals(spark, folder, "*.parquet", DOCUMENT, files_per_batch=1)
        auto_translate(arrivals, root, checkpoint, to_pages, rules, shout, JOB, revisit=again).awaitTermination()
    texts = {tuple(b.translated_text for b in r.blocks) for r in store.read_current(spark, root).collect()}
    assert texts == {("A", "B"), ("C",), ("D",)}
    assert failed_pages(spark, root, "int").count() == 0


def test_untidy_pages(spark):
    """Blocks on the second copy only, gaps in positions, two pages without hash."""
    pages = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, None)], "page_key int, sha string")
    blocks = spark.createDataFrame([(2, 0, "a"), (2, 5, "b"), (3, 0, "c")], "page_key int, pos int, original_text string")
    rules = spark.createDataFrame([], schema.RULES)
    nothing = spark.createDataFrame([], "cache_key string")
    result = translate_pages(pages, blocks, nothing, rules, shout, JOB)
    outcome = {r.page_key: r.outcome for r in page_report(result).collect()}
    assert outcome == {1: "translated", 2: "translated", 3: schema.UNREADABLE_PAGE, 4: schema.UNREADABLE_PAGE}
    records = page_records(result, JOB)
    assert [(r.image_url, [b.pos for b in r.blocks]) for r in records.collect()] == [("2", [0, 5])]
    rows = page_results(result, records.limit(0), records)
    assert {(r.page_key, r.pos, r.translated_text) for r in rows.collect()} == {(k, p, t) for k in (1, 2) for p, t in ((0, "A"), (5, "B"))}


def test_forced_pages(spark):
    pages = spark.createDataFrame([(1, "aa"), (2, "bb")], "page_key int, sha string")
    blocks = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "page_key int, pos int, original_text string")
    cache = pages.select(JOB.key("sha").alias("cache_key"))
    forced = cache.where("cache_key LIKE 'bb%'")
    result = translate_pages(pages, blocks, cache, spark.createDataFrame([], schema.RULES), shout, JOB, force=forced)
    assert {r.page_key: r.outcome for r in page_report(result).collect()} == {1: "cached", 2: "translated"}
    assert result.hits.count() == 1


def test_repeated_cache_records_are_one_hit(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    stored = spark.createDataFrame([("a", 0), ("a", 1)], "cache_key string, segment int")
    assert cache_hits(pages, stored).count() == 1


def test_batch_report_and_replay(spark, tmp_path):
    rows = [(1, "a\nb"), (2, "a\nb"), (3, "c"), (4, ""), (5, "x\n \ny"), (6, "old")]
    pages, blocks = to_pages(spark.createDataFrame(rows, DOCUMENT))
    rules = spark.createDataFrame([], schema.RULES)
    cache = pages.where("page_key = 6").select(JOB.key("sha").alias("cache_key"))
    result = translate_pages(pages, blocks, cache, rules, shout, JOB)
    report = {r.page_key: (r.n_blocks, r.outcome) for r in page_report(result).collect()}
    assert report == {
        1: (2, "translated"),
        2: (2, "translated"),
        3: (1, "translated"),
        4: (0, schema.NO_TEXT_BLOCKS),
        5: (3, schema.PAGE_FAILED),
        6: (0, "cached"),
    }
    records = page_records(result, JOB)
    assert records.count() == 2
    ids = [b.id for r in records.collect() for b in r.blocks]
    assert len(set(ids)) == 3 and all(len(i) == 36 and i[8] == i[13] == i[18] == i[23] == "-" for i in ids)
    assert ids == [b.id for r in records.collect() for b in r.blocks]
    assert page_records(result, TranslationJob("engine-v1", cache_empty=True)).count() == 3
    forced = translate_pages(pages, blocks, cache, rules, shout, TranslationJob("engine-v1", force=True))
    assert {r.page_key: r.outcome for r in page_report(forced).collect()}[6] == "translated"


def test_progress(spark):
    blocks = spark.createDataFrame([(1, 0, "ok"), (1, 1, "empty_text"), (2, 0, "ok")], "page_key int, pos int, status string")
    got = {r.page_key: (r.completed, r.total, r.finished) for r in page_progress(blocks).collect()}
    assert got == {1: (1, 2, False), 2: (1, 1, True)}
    watched, observation = observed(blocks)
    watched.collect()
    assert observation.get == {"completed": 2, "total": 3}
    done = tr.page_status(blocks).where("page_status = 'ok'")
    assert [r.page_key for r in done.collect()] == [2]


def test_progress_of_a_stream(spark, tmp_path):
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    rules, told = spark.createDataFrame([], schema.RULES), []
    listener = StreamProgress(told.append)
    spark.streams.addListener(listener)
    try:
        for lot in ([(1, "a\nb"), (2, "a\nb"), (3, "")], [(4, "c"), (5, "a\nb"), (6, "x\n \ny")]):
            spark.createDataFrame(lot, DOCUMENT).coalesce(1).write.mode("append").parquet(folder)
            arrivals = parquet_arrivals(spark, folder, "*.parquet", DOCUMENT)
            auto_translate(arrivals, root, checkpoint, to_pages, rules, shout, JOB).awaitTermination()
            assert listener.ended.wait(20)
    finally:
        spark.streams.removeListener(listener)
    rows = {r.batch: r.asDict() for r in batch_progress(spark, root).collect()}
    names = ("pages", "cached", "translated", "failed", "empty", "unreadable", "completed", "total")
    assert [tuple(rows[b][n] for n in names) for b in (1, 2)] == [(3, 0, 2, 0, 1, 0, 2, 2), (3, 1, 1, 1, 0, 0, 3, 4)]
    assert [(r["batch"], r["rows"]) for r in told if r["rows"]] == [(0, 3), (1, 3)] and all(r["seconds"] > 0 for r in told)


def test_versions_are_merged_on_the_way(spark, tmp_path):
    """Ten batches: the first seven versions and the empty one are one folder when the last looks."""
    folder, root, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for i in range(10):
        lot = [(10 * i + k, f"line {i} {k}") for k in range(5)]
        spark.createDataFrame(lot, DOCUMENT).coalesce(1).write.mode("append").parquet(folder)
    arrivals = parquet_arrivals(spark, folder, "*.parquet", DOCUMENT, files_per_batch=1)
    auto_translate(arrivals, root, checkpoint, to_pages, spark.createDataFrame([], schema.RULES), shout, JOB).awaitTermination()
    assert store.read_current(spark, root).count() == 50
    assert [(r.low, r.high) for r in versions.runs(spark, root)] == [(0, 7), (8, 8), (9, 9), (10, 10)]
