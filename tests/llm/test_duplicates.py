"""Exact and near duplicates."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from data import FOLDER, awkward, documents, empty
from pyspark.sql import functions as F

from pagecorpus.llm import decontaminate, exact_stream, simhash


def slow_fingerprint(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Smallest row index reachable over two or fewer differing bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(spark):
    from pagecorpus.llm.queries import op1_simhash

    rows = sorted(documents(), key=lambda r: r["doc_id"])
    prints = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(prints)
    expected = {r["doc_id"]: (f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, FOLDER).collect()}
    assert got == expected


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(3):
            v ^= 1 << rng.randrange(64)
            v ^= 1 << rng.randrange(64)
            values.append(v)
    values += [values[0] ^ (1 << 63), values[0] ^ (1 << 63) ^ 1, 0, 2**64 - 1]
    values = sorted(set(values))
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    links = simhash.fingerprint_links(df).collect()
    at = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = at[r.u], at[r.v]
        assert (values[a] ^ values[b]).bit_count() <= 2
        parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = slow_components(values)
    assert Counter(Counter(find(i) for i in range(len(values))).values()) == Counter(Counter(expected).values())
    assert [find(i) for i in range(len(values))] == expected


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == np.array([slow_fingerprint(text)], dtype=np.uint64).view(np.int64)[0]


def test_near_awkward_rows(spark):
    groups = simhash.simhash_groups(awkward(spark)).collect()
    assert len(groups) == 10
    by = Counter((r.component_id, r.group_size) for r in groups)
    assert by[(1, 3)] == 3  # equal texts, one of them twice
    assert by[(2, 4)] == 4  # null, empty and blank texts, with or without identifier
    assert simhash.simhash_groups(empty(spark)).count() == 0
    kept = simhash.drop_near_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, None, 7, 8])
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_exact_awkward_rows(spark):
    groups = exact_stream.exact_groups(awkward(spark)).collect()
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in groups)
    assert got == sorted(
        [(1, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True), (2, 3, 3, False), (3, 3, 3, True), (0, 3, 3, False)]
        + [(4, 4, 1, True), (0, 0, 1, True), (7, 7, 1, True), (8, 8, 1, True)]
    )
    assert exact_stream.exact_groups(empty(spark)).count() == 0
    kept = exact_stream.drop_exact_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([5, 3, 4, None, 7, 8])


@pytest.mark.parametrize("files", [1, 3])
def test_exact_over_several_batches_and_colliding_digests(spark, tmp_path, files):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(400)]
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(folder)
    docs = spark.read.parquet(folder)
    weak = lambda t: (F.crc32(t.cast("binary")) % 7).cast("string")
    largest, count = {}, Counter(t for _, t in rows)
    for i, t in rows:
        largest[t] = max(i, largest.get(t, 0))
    expected = {i: (largest[t], count[t], i == largest[t]) for i, t in rows}
    for digest in (exact_stream.sha256, weak):
        found = exact_stream.exact_groups(docs, digest=digest, files_per_batch=files)
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()} == expected


def test_state_goes_on_with_new_files(spark, tmp_path):
    """Three calls over one state: only new files are read, groups span all calls, collisions are resolved."""
    folder, state = str(tmp_path / "files"), str(tmp_path / "state")
    lots = [
        [(1, "a"), (2, "b"), (3, None)],
        [(4, "a"), (0, "b"), (None, ""), (5, "c")],
        [(6, "ab"), (7, "a"), (7, "a")],
    ]

    def weak(text):
        return F.substring(F.concat(text, F.lit("-")), 1, 1)

    so_far = []
    for number, lot in enumerate(lots):
        rows = spark.createDataFrame([(i, x, "d") for i, x in lot], "doc_id bigint, text string, digest string")
        rows.coalesce(1).write.mode("append").parquet(folder)
        so_far += lot
        found = exact_stream.follow(spark, folder, state, digest=weak).collect()
        sizes = Counter(x or "" for _, x in so_far)
        keep = {}
        for i, x in so_far:
            keep[x or ""] = max(keep.get(x or "", -1), -1 if i is None else i)
        expected = Counter((i, keep[x or ""], sizes[x or ""]) for i, x in so_far)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == expected
        assert sum(r.kept for r in found) == len(sizes)
        batches = sorted(p.name for p in (tmp_path / "state" / "updates").iterdir())
        assert batches == sorted(f"batch={n}" for n in range(-1, number + 1))
    # Nothing new: the same answer, and no further batch.
    again = exact_stream.follow(spark, folder, state, digest=weak).collect()
    assert Counter(again) == Counter(found)
    assert len(list((tmp_path / "state" / "updates").iterdir())) == len(batches)


def test_state_is_read_in_batches(spark, tmp_path):
    """A digest that comes back in a later batch meets the state of the earlier ones."""
    folder = str(tmp_path / "arrivals")
    for part in range(4):
        rows = [(part * 10 + k, f"f{part}", k, f"d{k}") for k in range(3)]
        form = "doc_id bigint, __llm_file string, __llm_row bigint, digest string"
        spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(folder)
    state = exact_stream._final_state(spark.read.parquet(folder), files_per_batch=1)
    assert {(r.digest, r.group_size, r.keeper.doc_id) for r in state.collect()} == {(f"d{k}", 4, 30 + k) for k in range(3)}


@pytest.fixture
def passages(spark):
    """Five passages of two documents, four of them distinct."""
    fox, leaks = "the quick brown fox jumps over the lazy dog and runs off", "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, [fox, "two", "three"]), (2, [fox, leaks])], "doc_id bigint, texts array<string>")
    return docs.select("doc_id", F.explode("texts").alias("text")), leaks


@pytest.mark.parametrize("form", ["explode", "union", "filtered"])
def test_rows_of_derived_inputs(spark, tmp_path, passages, form):
    flat, leaks = passages
    folder = str(tmp_path / "t")
    flat.write.parquet(folder)
    source = spark.read.parquet(folder)
    nested = source.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    nested.write.parquet(folder + "2")
    again = spark.read.parquet(folder + "2").select("doc_id", F.explode("texts").alias("text"))
    docs = {"explode": again, "union": again.unionByName(again.limit(0)), "filtered": source.where("doc_id > 0")}[form]
    texts = lambda df: sorted(r.text[:5] for r in df.collect())
    assert texts(exact_stream.drop_exact_copies(docs)) == ["alpha", "the q", "three", "two"]
    assert texts(simhash.drop_near_copies(docs)) == ["alpha", "the q", "three", "two"]
    items = spark.createDataFrame([(1, leaks)], "item_id bigint, text string")
    assert texts(decontaminate.drop_leaking(docs, items)) == ["the q", "the q", "three", "two"]
