import threading
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagecorpus.operators import translate as tr
from pagecorpus.operators.skew import spread_lookup

BLOCKS = "page_key int, pos int, original_text string"


def test_concurrency_resolution():
    assert tr.resolve_concurrency("6", 3) == 6
    assert tr.resolve_concurrency(None, 3) == 3
    assert tr.resolve_concurrency("x", None) == 4
    assert [tr.resolve_concurrency(None, n) for n in (0, 99)] == [1, 8]


def test_bounded_calls_keep_order(spark, tmp_path):
    log = str(tmp_path / "log")
    state = {"active": 0}

    def slow(text, source, target):
        lock = state.setdefault("lock", None) or threading.Lock()
        state["lock"] = lock
        state["active"] += 1
        with open(log, "a") as out:
            out.write(f"{state['active']} {text}\n")
        time.sleep(0.15)
        state["active"] -= 1
        return f"{target}: {text}"

    state.pop("lock", None)
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate("春夏冬")], BLOCKS)
    done = tr.memo_translate(blocks, lambda texts: tr.enrich(texts, slow, concurrency=2, tasks=1))
    assert [r.translated_text for r in done.orderBy("pos").collect()] == ["ko: 春", "ko: 夏", "ko: 冬"]
    seen = [line.split() for line in open(log)]
    assert max(int(n) for n, _ in seen) == 2
    assert sorted(t for _, t in seen) == sorted("春夏冬")


def test_each_distinct_text_is_translated_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def logged(text, source, target):
        with open(log, "a") as out:
            out.write(text + "\n")
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    rows = [(1, 0, "same"), (1, 1, " same　"), (2, 0, "same"), (2, 1, "bad"), (3, 0, "   "), (3, 1, "x"), (4, 0, "x")]
    done = tr.memo_translate(spark.createDataFrame(rows, BLOCKS), lambda t: tr.enrich(t, logged, tasks=2))
    got = {(r.page_key, r.pos): (r.translated_text, r.status) for r in done.collect()}
    assert got[(1, 1)] == ("SAME", "ok") and got[(2, 1)] == (None, "translator_error")
    assert got[(3, 0)] == (None, "empty_text")
    assert Counter(open(log).read().split()) == Counter(["same", "bad", "x"])
    complete, quarantined = tr.split_pages(done)
    assert {r.page_key for r in complete.collect()} == {1, 4}
    assert {(r.page_key, r.pos, r.n_failed) for r in quarantined.collect()} == {(2, 0, 1), (2, 1, 1), (3, 0, 1), (3, 1, 1)}
    verdicts = {r.page_key: r.page_status for r in tr.page_status(done).collect()}
    assert verdicts == {1: "ok", 2: "page_failed", 3: "page_failed", 4: "ok"}


def test_split_pages_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(tr, "BROADCAST_PAGES", 0)
    rows = [(p, i, "   " if p % 3 == 0 and i == 0 else "x") for p in range(9) for i in range(4)]
    complete, quarantined = tr.split_pages(tr.passthrough(spark.createDataFrame(rows, BLOCKS)))
    assert {r.page_key for r in complete.collect()} == {1, 2, 4, 5, 7, 8}
    assert complete.count() + quarantined.count() == len(rows)


def test_passthrough_rejects_blank(spark):
    rows = tr.passthrough(spark.createDataFrame([(1, 0, "   "), (1, 1, " a ")], BLOCKS)).orderBy("pos").collect()
    assert [(r.translated_text, r.status) for r in rows] == [(None, "empty_text"), ("a", "ok")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_lookup_equals_plain_join(spark, how):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("i")
    )
    counts = facts.where("k < 45").groupBy("k").agg(F.count(F.lit(1)).alias("uses"))
    lookup = counts.withColumn("v", F.col("k") * 10)
    plain = facts.join(lookup.drop("uses"), "k", how)
    salted = spread_lookup(facts, lookup, ["k"], "uses", ["i"], how, hot_uses=100, rows_per_salt=50)
    assert sorted(map(tuple, salted.select("k", "i", "v").collect()), key=str) == sorted(
        map(tuple, plain.select("k", "i", "v").collect()), key=str
    )


def _keyed(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(tr.text_key("text").alias("text_key"), "text")


def _calls(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def _noting(folder, fail=()):
    """A translator that leaves a file per call."""

    def translate(text, source, target):
        (folder / uuid.uuid4().hex).write_text(text)
        if text in fail:
            raise RuntimeError("down")
        return f"{target}:{text}"

    return translate


def test_journal_asks_each_text_once(spark, tmp_path):
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    calls.mkdir()
    texts = [f"t{i}" for i in range(300)]
    first = tr.enrich(_keyed(spark, texts[:200]), _noting(calls, fail={"t3", "t77"}), tasks=4, journal=journal)
    status = {r.text: r.status for r in first.collect()}
    assert {t for t, s in status.items() if s != "ok"} == {"t3", "t77"} and len(status) == 200
    assert _calls(calls) == sorted(texts[:200])
    # A second run over more texts: only what is new or failed is asked.
    second = tr.enrich(_keyed(spark, texts), _noting(calls), tasks=3, journal=journal)
    assert {r.text: r.translated_text for r in second.collect()} == {t: f"ko:{t}" for t in texts}
    assert _calls(calls) == sorted([*texts, "t3", "t77"])
    # Another language is another question.
    other = tr.enrich(_keyed(spark, texts[:2]), _noting(calls), target_language="en", journal=journal)
    assert {r.translated_text for r in other.collect()} == {"en:t0", "en:t1"}


def test_a_repeated_task_finds_its_answers(spark, tmp_path):
    """What an attempt put into the journal before it died is there for the next one."""
    first = tr.TaskJournal(str(tmp_path), "r", 3, "ja", "ko")
    first.put([(b"k1", "one"), (b"k2", "two")])
    (tmp_path / "run=r" / "task=3" / "_half").write_bytes(b"PAR1")
    again = tr.TaskJournal(str(tmp_path), "r", 3, "ja", "ko")
    assert again.known == {b"k1": "one", b"k2": "two"}
    assert tr.TaskJournal(str(tmp_path), "r", 4, "ja", "ko").known == {}
    assert tr.answered(spark, str(tmp_path), "ja", "ko").count() == 2
    assert tr.answered(spark, str(tmp_path / "none"), "ja", "ko").count() == 0


@pytest.mark.parametrize("tasks,limit", [(4, 2), (2, 5), (8, 1)])
def test_one_limit_for_the_whole_run(spark, tmp_path, tasks, limit):
    """Calls mark their time; never are more of them open than the limit."""

    def slow(text, source, target):
        start = time.time()
        time.sleep(0.05)
        (tmp_path / uuid.uuid4().hex).write_text(f"{start} {time.time()}")
        return text

    texts = spark.createDataFrame([(f"t{i}",) for i in range(24)], "text string").repartition(tasks)
    rows = tr.enrich(texts, slow, concurrency=limit, tasks=tasks, whole_run=True).collect()
    assert sorted(r.translated_text for r in rows) == sorted(f"t{i}" for i in range(24))
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    assert len(spans) == 24
    assert max(sum(a <= s < b for a, b in spans) for s, _ in spans) <= limit
