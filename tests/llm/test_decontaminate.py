"""Greedy string tiling and the removal of leaked items."""

import random
import tracemalloc

import numpy as np
import pytest
from data import FOLDER, awkward, documents, empty

from pagecorpus.llm import decontaminate as d


def test_rolling_hash():
    ids = np.random.default_rng(0).integers(0, 1000, 50)
    for n in (1, 2, 3, 5, 7, 12, 50, 51):
        expected = []
        for i in range(len(ids) - n + 1):
            h = 0
            for v in ids[i : i + n]:
                h = (h * int(d._BASE) + int(v)) % 2**64
            expected.append(h)
        assert d.rolling(ids, n).tolist() == expected


def slow_tiles(item, text, least):
    """Mark the longest common unmarked run, smallest places first, until none is long enough."""
    free_i, free_t, done = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return done
        free_i[i : i + n] = [False] * n
        free_t[t : t + n] = [False] * n
        done.append(best)


@pytest.mark.parametrize("seed", range(12))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    letters = 3 + seed % 6
    item = [rng.randrange(1, letters) for _ in range(rng.randint(3, 40))]
    text = [rng.randrange(1, letters) for _ in range(30)]
    for _ in range(3):
        a = rng.randrange(len(item))
        text[rng.randrange(30) : 0] = item[a : a + rng.randint(2, 15)]
    got = d.tiles(np.array(item), np.array(text), 3, first=4)
    expected = slow_tiles(item, text, 3)
    assert sorted((s for s, _, _ in got), reverse=True) == [s for s, _, _ in expected]
    assert sum(s for s, _, _ in got) == sum(s for s, _, _ in expected)
    seen_i, seen_t = set(), set()
    for size, i, t in got:
        assert item[i : i + size] == text[t : t + size]
        assert not seen_i & set(range(i, i + size)) and not seen_t & set(range(t, t + size))
        seen_i |= set(range(i, i + size))
        seen_t |= set(range(t, t + size))


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_reordered_passages(spark):
    rows = [
        (1, f"noise before {ITEM.upper()}, and noise after"),
        (2, "seven eight nine ten eleven twelve -- other words -- One, two; three four five six!"),
        (3, "one two three four five then nothing"),
        (4, "one three five seven nine eleven two four six eight ten twelve"),
        (5, "short item"),
    ]
    items = spark.createDataFrame([(10, ITEM), (11, "short item"), (12, None), (13, ""), (10, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in d.leaked_items(docs, items).collect()}
    assert set(found) == {(1, 10), (2, 10), (5, 11)}
    assert (found[2, 10].coverage, found[2, 10].n_tiles, found[2, 10].longest_tile) == (1.0, 2, 6)
    assert [tuple(t) for t in found[2, 10].tiles] == [(0, 8, 6), (6, 0, 6)]
    blocks = {(r.doc_id, r.item_id) for r in d.leaked_items(docs, items, block_chars=5).collect()}
    assert blocks == set(found)
    low = {(r.doc_id, r.item_id) for r in d.leaked_items(docs, items, covered=0.4).collect()}
    assert low == set(found) | {(3, 10)}


def test_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    from pagecorpus.llm.queries import op9_decontamination

    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()
    expected = set()
    for r in documents():
        words = d.tokens_of(r["text"])
        text = " " + " ".join(words) + " "
        for item in items:
            parts = d.tokens_of(item["text"])
            if any(f" {' '.join(parts[i : i + 5])} " in text for i in range(len(parts) - 4)):
                numbers = {w: k for k, w in enumerate(sorted(set(words + parts)))}
                tiles = slow_tiles([numbers[w] for w in parts], [numbers[w] for w in words], 5)
                if sum(s for s, _, _ in tiles) >= d.COVERED * len(parts):
                    expected.add((r["doc_id"], item["item_id"], sum(s for s, _, _ in tiles)))
    got = {(r.doc_id, r.item_id, r.covered_tokens) for r in op9_decontamination(spark, FOLDER).collect()}
    assert got == expected and got


def test_awkward_rows(spark):
    items = spark.createDataFrame([("i", "the quick brown fox jumps over the lazy dog"), (None, "cat sat on the mat and then it ran off")], "item_id string, text string")
    found = d.leaked_items(awkward(spark), items).collect()
    assert sorted((r.doc_id, r.item_id or "") for r in found) == [(1, "i"), (5, "i"), (5, "i"), (7, "")]
    assert d.leaked_items(empty(spark), items).count() == 0
    assert d.leaked_items(awkward(spark), items.where("false")).count() == 0
    kept = d.drop_leaking(awkward(spark), items)
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2, 3, 4, 8]


def test_memory_of_repetitive_texts():
    """One token over and over on both sides, a million times in the text."""
    tracemalloc.start()
    got = d.tiles(np.full(100, 7), np.full(1_000_000, 7))
    assert got == [(100, 0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "string", "double", "date", "decimal(9,2)", "binary"])
def test_identifiers_of_any_type(spark, kind):
    item = spark.range(1, 2).selectExpr("id AS item_id", "'alpha beta gamma delta epsilon zeta' AS text")
    value = {"date": "date'2020-01-02'", "binary": "cast('x' AS binary)"}.get(kind, f"cast(item_id AS {kind})")
    items = item.selectExpr(f"{value} AS item_id", "text")
    found = d.leaked_items(item.selectExpr("item_id AS doc_id", "text"), items)
    assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
    assert [r.item_id for r in found.collect()] == [r.item_id for r in items.collect()]
