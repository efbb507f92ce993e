"""Packing: ids, pieces, patterns and ranks."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from data import FOLDER, awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagecorpus.llm import packing
from pagecorpus.llm.common import crc32_of

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


TEXTS = ["", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\tb c\t d", "x\x1cy z", "é ü　z w", "<|endoftext|> a", "a\0b c", "don't we'll 12,5 …", "😀 😀a", "\r\na b\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(encoder, plain, text):
    assert encoder.encode(text).tolist() == plain(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("ab, .\n\t 　é's1"), max_size=60))
def test_ids_of_any_blanks(text):
    tokenizer = packing.encoder(PATH)
    assert tokenizer.encode(text).tolist() == tokenizer.whole(text).tolist()


def test_ids_of_documents_with_a_small_cache_and_small_blocks(plain, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    small = packing.Encoder(PATH, kept=300)
    for row in documents()[:60]:
        assert small.encode(row["text"]).tolist() == plain(row["text"])
    assert len(small.index) <= 300


@settings(max_examples=60, deadline=None)
@given(histogram=st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for p in patterns:
        assert sum(p.lengths) <= 64 and p.count > 0
        for size in p.lengths:
            held[size] += p.count
    assert held == Counter(histogram)
    places = defaultdict(list)
    for size, low, high, _, _ in packing.placements(patterns):
        places[size].append((low, high))
    for size, ranges in places.items():
        ends = sorted(ranges)
        assert ends[0][0] == 0 and ends[-1][1] == histogram[size]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def slow_shortest_pack_first(sizes, capacity):
    packs = []
    for size in sorted(sizes, reverse=True):
        room = max((capacity - sum(p) for p in packs), default=0)
        if room >= size:
            next(p for p in packs if capacity - sum(p) == room).append(size)
        else:
            packs.append([size])
    return len(packs)


def test_as_many_packs_as_one_by_one():
    rng = random.Random(3)
    sizes = [rng.randint(1, 40) for _ in range(500)] + [40] * 7
    patterns = packing.shortest_pack_first(Counter(sizes), 40)
    assert sum(p.count for p in patterns) == slow_shortest_pack_first(sizes, 40)


def check(rows, ids_of, capacity=2048):
    """Every id in one piece, sequences gapless and not too long; the share that is filled."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, own in pieces.items():
        ids, at = ids_of[doc], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == crc32_of(ids[at : at + r.length].astype("<u4"))
            at += r.length
        assert at == len(ids)
    assert sorted(pieces) == sorted(ids_of)
    whole = padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        whole += at
        padded += at if at & (at - 1) == 0 else capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return whole / padded


def test_query(spark, plain):
    from pagecorpus.llm.queries import op3_packing

    ids = {r["doc_id"]: np.array(plain(r["text"] or "") + [1], dtype=np.uint32) for r in documents()}
    assert check(op3_packing(spark, FOLDER).collect(), ids) > 0.97


def test_ranks_over_many_buckets(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    docs = spark.createDataFrame([(i, "ab " * (i % 7)) for i in range(200)], "doc_id bigint, text string")
    ids = {i: np.array(plain("ab " * (i % 7)) + [1], dtype=np.uint32) for i in range(200)}
    check(packing.pack(packing.tokenised(docs, length=16), 16).collect(), ids, 16)


def test_sequences_hold_the_ids(spark, plain):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(1, 30)], "doc_id bigint, text string")
    packed = packing.pack(packing.tokenised(docs, length=32, with_ids=True), 32)
    rows = packing.sequences(packed, 32).collect()
    assert sum(r.used for r in rows) == sum(len(plain("some words " * i)) + 1 for i in range(1, 30))
    for r in rows:
        assert len(r.ids) == (r.used if r.used & (r.used - 1) == 0 else 32)
        assert set(r.ids[r.used :]) <= {0}


def test_awkward_rows(spark):
    packed = packing.pack(packing.tokenised(awkward(spark))).collect()
    whole = Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert sum(r.start == 0 for r in packed) == 10
    assert (whole[2], whole[3]) == (1, 1) and whole[5] == 2 * whole[1]
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert packing.pack(packing.tokenised(empty(spark))).count() == 0
