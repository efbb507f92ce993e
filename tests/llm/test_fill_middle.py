"""Fill-in-the-middle against slow cuts, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from data import FOLDER, awkward, documents, empty
from pyspark.sql import functions as F

from pagecorpus.llm import fill_middle
from pagecorpus.llm.queries import op11_fill_middle


def slow(text, doc_id):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark):
    expected = {}
    for r in documents():
        *first, output = slow(r["text"], r["doc_id"])
        expected[r["doc_id"]] = (*first, digest(output), digest(r["text"] or ""))
    got = {r.doc_id: tuple(r)[1:] for r in op11_fill_middle(spark, FOLDER).collect()}
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 33, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 50, n)
    lines, before = fill_middle.SkipList(widths), np.concatenate(([0], np.cumsum(widths)))
    ranks = range(n + 1) if n < 2000 else random.Random(1).sample(range(n + 1), 500)
    assert all(lines.place(r) == before[r] for r in ranks)
    # Express lanes shorten the way.
    assert n < 1000 or len(lines.lanes) >= 4
    assert all(sum(u) <= n and sum(p) <= before[-1] for u, p, _ in lines.lanes)


@pytest.mark.parametrize("text", ["", "\n", "\n\n\n", "a", "a\nb", "é\n😀\n\nü", "no end\r\n  still\x0b"])
def test_line_widths(text):
    assert fill_middle.line_widths(text).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", text)]


def test_awkward_rows_and_round_trip(spark):
    long = "\n".join(str(i) * (i % 7) for i in range(200_000))
    rows = [(11, long), (12, "<P> held"), (13, "<<P\n<\n<S\n<M\n<"), (14, "\n"), (15, "a <M\n> b"), (16, "<S>")]
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    made = fill_middle.fill_in_middle(docs)
    again = made.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.again) for r in again), key=str) == source
    for r in again:
        text = r.again
        assert tuple(r)[1:6] == slow(text, "" if r.doc_id is None else r.doc_id)
    assert {r.doc_id for r in again if r.form == "plain"} == {2, 3, None, 12, 16}
    assert fill_middle.fill_in_middle(awkward(spark)).count() == 10
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0


def test_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, f"x\ny {i}\nz") for i in range(400)], "doc_id bigint, text string")
    forms = lambda **k: {r.form: r.n for r in fill_middle.fill_in_middle(docs, **k).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert forms(fim_percent=0) == {"plain": 400}
    assert forms(spm_percent=100) == {"spm": 400}
    assert 150 < forms(fim_percent=50)["plain"] < 250
    marks = ("[pre]", "[suf]", "[mid]")
    made = fill_middle.fill_in_middle(docs, marks=marks)
    again = made.select(fill_middle.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert sorted(r.t for r in again) == sorted(f"x\ny {i}\nz" for i in range(400))
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, marks=("aa", "b", "c"))
