"""Repeated passages against all windows by brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from data import FOLDER, awkward, documents, empty

from pagecorpus.llm import repeats
from pagecorpus.llm.queries import op13_substrings


def slow(rows, length=50):
    """``(doc_id, n_words, covered places, kept)`` per row of ``(doc_id, text)``; null is larger than any other."""
    large = lambda i: (i is None, 0 if i is None else i)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    holders = defaultdict(set)
    for (i, _), w in zip(rows, split):
        for s in range(len(w) - length + 1):
            holders[tuple(w[s : s + length])].add(large(i))
    least = {k: min(v) for k, v in holders.items()}
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - length + 1):
            if least[tuple(w[s : s + length])] < large(i):
                gone.update(range(s, s + length))
        out.append((i, len(w), gone, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def found(docs, **options):
    rows = repeats.cut_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_words, {p for run in r.removed for p in range(run.low, run.high)}, r.kept) for r in rows), key=str)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()]
    expected = {i: (n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in slow(rows)}
    assert any(n for _, n, _ in expected.values())
    assert {r.doc_id: tuple(r)[1:] for r in op13_substrings(spark, FOLDER).collect()} == expected


@pytest.mark.parametrize("length,gram", [(50, 16), (12, 4), (5, 5), (6, 1)])
def test_planted_passages(spark, length, gram):
    """Passages cut short, shifted, repeated inside a document, and chains of partial overlaps."""
    rng = random.Random(length)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(length - 1, 3 * length))] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3)
            w += [word() for _ in range(rng.randrange(length))] + p[cut : len(p) - rng.randrange(len(p) // 3)]
        rows.append((rng.randrange(130), " ".join(w + [word() for _ in range(rng.randrange(30))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = sorted(slow(rows, length), key=str)
    assert any(gone for _, _, gone, _ in expected)
    assert found(docs, length=length, gram=gram) == expected


def test_few_words(spark):
    """Texts of few different words hold the same anchor over and over."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, "a " * 500), (61, "a " * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(docs, length=8, gram=3) == sorted(slow(rows, 8), key=str)


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "PER_SALT", 5)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage, whole = [word() for _ in range(60)], " ".join(word() for _ in range(90))
    rows = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(200)]
    rows += [(i, whole) for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(docs) == sorted(slow(rows), key=str)


def test_awkward_rows(spark):
    long = "the cat sat on the mat and then it ran off. " * 30_000
    more = [(6, long[: len(long) // 2]), (None, long), (7, long), (3, " ".join(map(str, range(60)))), (3, " ".join(map(str, range(60))))]
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    assert found(docs) == sorted(slow([tuple(r) for r in docs.collect()]), key=str)
    assert repeats.cut_repeats(awkward(spark)).count() == 10
    assert repeats.cut_repeats(empty(spark)).count() == 0
    named = docs.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert repeats.cut_repeats(named).count() == docs.count()


def test_anchors_in_blocks(monkeypatch):
    words = [str(i * i % 997).encode() for i in range(3000)]
    whole = repeats.anchors_of(words, 50, 16)
    at = whole[0]
    assert max(np.diff(at)) <= 35 and at[0] <= 34 and at[-1] >= 3000 - 50
    monkeypatch.setattr(repeats, "BLOCK", 61)
    assert all(np.array_equal(a, b) for a, b in zip(whole, repeats.anchors_of(words, 50, 16)))
