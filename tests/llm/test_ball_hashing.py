"""The candidates of the pipeline's near-duplicate stage: seeded fingerprints and the balls around them."""

import random

import pytest
from pyspark.sql import functions as F
from test_near_copies import slow_kept, stage

from pagecorpus.llm import minhash, simhash

_, BITS, PRINTS = simhash.WIDTHS[0]


def balls(text, bits=BITS, prints=PRINTS):
    """All variants that a text emits, and its fingerprints."""
    _, numbers, _ = simhash.near_prints(text, bits, prints)
    found, own = set(), []
    for at, number in enumerate(n & (1 << 64) - 1 for n in numbers.tolist()):
        own.append(number & (1 << 40) - 1)
        ball = [own[-1]]
        for i in range(simhash.UNSURE):
            ball += [v ^ (1 << (number >> 40 + 6 * i & 63)) for v in ball]
        found |= {(at, v) for v in ball}
    return found, own


@pytest.mark.parametrize("size,new", [(94, 10), (49, 5), (24, 2)])
def test_balls_meet_at_the_threshold(size, new):
    rng, met = random.Random(6), 0
    for k in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        one, other = " ".join(words), " ".join(words[: size - new] + [f"x{k}.{i}" for i in range(new)])
        assert 0.8 <= minhash.similarity(minhash.shingles(one), minhash.shingles(other)) < 0.82
        met += bool(balls(one)[0] & balls(other)[0])
    assert met >= 297


def test_unlike_texts_do_not_meet():
    rng = random.Random(7)
    texts = [balls(" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)))[0] for _ in range(40)]
    assert not any(texts[i] & texts[j] for i in range(40) for j in range(i))


@pytest.mark.parametrize("bits,prints", [w[1:] for w in simhash.WIDTHS])
def test_variants_in_spark(spark, bits, prints):
    text = "one two three four five six seven eight nine ten"
    _, numbers, _ = simhash.near_prints(text, bits, prints)
    rows = spark.createDataFrame(list(enumerate(numbers.tolist())), "t int, p bigint")
    found = rows.select("t", F.explode(F.array(*simhash._variants("p", simhash.UNSURE))).alias("v")).collect()
    assert {(r.t, r.v) for r in found} == balls(text, bits, prints)[0] and len(found) == 16 * prints


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = simhash.near_prints(text, BITS, PRINTS)
    monkeypatch.setattr(simhash, "WEIGHED", 7)
    assert all((a == b).all() for a, b in zip(whole[1:], simhash.near_prints(text, BITS, PRINTS)[1:]))


def test_stage_needs_no_bands(spark, tmp_path, monkeypatch):
    """Near copies, a short pair, texts without words and clean texts, told by ball hashing alone."""
    for name in ("signature", "_signed", "near_groups"):
        monkeypatch.delattr(minhash, name)
    rng, rows = random.Random(8), [(900, ""), (901, " \t"), (902, "a b c d e f g h"), (903, "a b c d e f g h i")]
    for i in range(0, 60, 3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        other = words[:40] + ["x", "y"] + words[42:]
        rows += [(i, " ".join(words)), (i + 1, " ".join(other)), (i + 2, " ".join(words[::-1]))]
    kept = stage(spark, rows, str(tmp_path / "docs"))
    assert kept == slow_kept(rows) - {901} and len(kept) == 42
