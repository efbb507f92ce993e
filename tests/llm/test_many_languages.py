"""More languages than one table of slots holds."""

import random

from pagecorpus.llm import language

N = 70


def test_every_language_is_learned_and_predicted(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, probes = [], []
    for k in range(N):
        # Every language has syllables of its own; the first ones have more documents.
        syllables = ["".join(rng.sample(letters, 3)) for _ in range(30)]
        text = lambda: " ".join("".join(rng.choices(syllables, k=2)) for _ in range(60))
        rows += [(text(), f"l{k:02}") for _ in range(8 if k < 64 else 4)]
        probes.append((text(), f"l{k:02}"))
    filters = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.languages == [f"l{k:02}" for k in range(N)]
    assert len(filters.false_rate) == N and filters.false_rate.max() < 0.05
    assert [language.predict(t, filters)[0] for t, _ in probes] == [name for _, name in probes]
