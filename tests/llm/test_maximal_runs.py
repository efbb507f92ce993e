"""Runs of repeated windows are joined before they are laid to the texts."""

import random

from pyspark.sql import functions as F

from pagecorpus.llm import repeats


def slowly(runs):
    held = sorted({w for low, high in runs for w in range(2 * low, 2 * high + 1)})
    out = []
    for w in held:
        if out and out[-1][1] == w - 1:
            out[-1][1] = w
        else:
            out.append([w, w])
    return [(a // 2, b // 2) for a, b in out]


def test_runs_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        starts = [rng.randrange(400) for _ in range(rng.randrange(0, 30))]
        rows.append((i, [(s, s + rng.choice([1, 10, 50])) for s in starts]))
    df = spark.createDataFrame(rows, "i int, runs array<struct<low:int,high:int>>")
    for r in df.select("runs", repeats.maximal(F.col("runs")).alias("m")).collect():
        assert [tuple(x) for x in r.m] == slowly([tuple(x) for x in r.runs])


def test_a_run_of_windows_is_one(spark, monkeypatch):
    """Two long documents that share a passage of which no surroundings are equal."""
    passage = [f"p{i}" for i in range(400)]
    texts = [(k, " ".join([f"a{k}.{i}" for i in range(30)] + passage + [f"z{k}.{i}" for i in range(30)])) for k in range(3)]
    kept, frozen = repeats.freeze, []
    monkeypatch.setattr(repeats, "freeze", lambda df: frozen.append(kept(df)) or frozen[-1])
    rows = repeats.cut_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, [tuple(x) for x in r.removed]) for r in rows) == [(0, []), (1, [(30, 430)]), (2, [(30, 430)])]
    assert [r.n for r in frozen[-1].select(F.size("runs").alias("n")).collect()] == [1, 1]
