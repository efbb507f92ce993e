"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import itertools
import random
from collections import defaultdict

from data import documents

import corpus_pipeline
from pagecorpus.llm import minhash


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows, least=0.8):
    """Smallest identifiers of the groups, by all pairs that share a shingle."""
    sets, holders = {i: slow_shingles(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}:
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i for i in sets if parent[i] == i}


def stage(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(folder)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(folder), "").collect()}


def test_stage_finds_what_brute_force_finds(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents("/root/testdata/sf0.01")]
    expected = slow_kept(rows)
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert 56 not in kept
    assert kept == expected


def test_large_groups_and_a_common_passage(spark, tmp_path):
    """One large group whose members are mostly unlike each other and joined by a few, many small ones, a passage all of them hold."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, origin = [word() for _ in range(60)], [word() for _ in range(80)]
    rows = []
    for i in range(150):
        text = list(origin)
        text[rng.randrange(80)] = word()
        rows.append((i, " ".join(text)))
    for i in range(1000, 1200, 2):
        own = [word() for _ in range(40)]
        rows += [(i, " ".join(passage + own)), (i + 1, " ".join(passage + own[:-2]))]
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert kept == slow_kept(rows)
    assert kept == {0} | set(range(1000, 1200, 2))


def test_bands_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    n, whole = minhash.signature(text)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert (minhash.signature(text)[1] == whole).all() and len(set(whole)) == 2 * minhash.BANDS
    assert n == len(minhash.shingles(text)) == 496


def test_bands_meet_at_the_threshold():
    """Pairs at Jaccard 0.8, the least alike that count."""
    rng = random.Random(6)
    met = 0
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        # 90 shingles, of which ten are lost and ten new: 80 / 100.
        other = words[:84] + [f"x{k}.{i}" for i in range(10)]
        assert minhash.similarity(minhash.shingles(" ".join(words)), minhash.shingles(" ".join(other))) == 0.8
        met += bool(set(minhash.signature(" ".join(words))[1]) & set(minhash.signature(" ".join(other))[1]))
    assert met >= 297


def test_many_unlike_members_and_a_chain(spark, tmp_path):
    """Members that the hub does not join: a chain along which neighbours are alike and others are not."""
    rng = random.Random(9)
    words, rows = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for i in range(120):
        rows.append((i, " ".join(words)))
        at = rng.randrange(96)
        words = words[:at] + [f"v{rng.randrange(10**6)}" for _ in range(2)] + words[at + 2 :]
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert kept == slow_kept(rows)


def edited(rng, count, most):
    """Texts of 150 words with up to ``most`` words changed."""
    origin = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(count):
        text = list(origin)
        for _ in range(rng.randrange(1, most + 1)):
            text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_group_below_and_above_the_threshold(spark, tmp_path):
    """One bucket whose members are about as alike as the threshold: many stay apart from the hub."""
    rows = edited(random.Random(12), 250, 5)
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert kept == slow_kept(rows) and len(kept) > 20


def test_a_group_of_thousands(spark, tmp_path):
    """Any two of these with a changed word are alike, and those with two are alike to them."""
    assert stage(spark, edited(random.Random(13), 3000, 2), str(tmp_path / "docs")) == {0}


def test_few_pairs_in_a_group_below_the_threshold(spark, tmp_path, monkeypatch):
    """Members that are alike none of the others are told by the shingles that they alone hold, not by all their pairs."""
    rows, verified, linked = edited(random.Random(21), 500, 12), [], minhash._linked

    def counted(pairs, texts):
        verified.append(pairs.count())
        return linked(pairs, texts)

    monkeypatch.setattr(minhash, "_linked", counted)
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert kept == slow_kept(rows) and len(kept) > 200
    assert sum(verified) < 10 * len(rows)
