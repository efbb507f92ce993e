"""Toxicity and language-model scores."""

import math
from collections import Counter

import numpy as np
import pytest
from data import FOLDER, awkward, crc, documents, empty
from pyspark.sql import functions as F

from pagecorpus.llm import suffix_tree, toxicity


def made(n, seed=0):
    """Texts of common words; toxic ones hold one of two words, or words of one beginning."""
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(rng.choice(common, rng.integers(5, 80)))
        label = int(i % 4 == 0)
        if label:
            bad = ["vile", "nasty"][i % 2] if i % 3 else f"grim{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"
            words[rng.integers(len(words))] = bad
        rows.append((" ".join(words), label))
    return rows


def test_network_learns_words_and_beginnings():
    train, test = made(1200), made(400, seed=9)
    net = toxicity.train([t for t, _ in train], [y for _, y in train])
    scorer = toxicity.Scorer(net)
    values = np.array([scorer.logit(t) for t, _ in test])
    labels = np.array([y for _, y in test])
    cut = toxicity.best_cut(values, labels)
    assert ((values >= cut) == labels).mean() >= 0.97


def test_long_texts_in_blocks_and_small_caches(monkeypatch):
    net = toxicity.train(*zip(*made(200)))
    text = " ".join(t for t, _ in made(40, seed=4))
    whole = toxicity.Scorer(net).logit(text)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 11)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 20)
    assert toxicity.Scorer(net).logit(text) == pytest.approx(whole, rel=1e-4)


def test_best_cut():
    cut = lambda v, y: toxicity.best_cut(np.array(v), np.array(y))
    assert cut([1.0, 2.0, 3.0, 5.0], [0, 0, 1, 1]) == 2.5
    assert cut([1.0, 1.0], [0, 1]) is not None and cut([], []) is None and cut([1.0], [1]) is None


def test_pooling_against_brute_force():
    rng = np.random.default_rng(1)
    projected = rng.normal(size=(9, len(toxicity.COLUMNS) * toxicity.FILTERS)).astype(np.float32)
    best, where = toxicity._pooled(projected)
    k, at = 0, 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            sums = [
                sum(projected[i + j, at + j * toxicity.FILTERS + f] for j in range(width)) for i in range(9 - width + 1)
            ]
            assert best[k] == pytest.approx(max(sums), rel=1e-5) and where[k] == int(np.argmax(sums))
            k += 1
        at += width * toxicity.FILTERS


def test_scores_in_spark(spark):
    rows = [(i, t, "en", y) for i, (t, y) in enumerate(made(800))]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(10**6, 1)], "doc_id bigint, toxic int")
    held = F.col("doc_id") % 4 == 1
    labelled = toxicity.with_labels(docs.where(~held), labels)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labelled).collect()}
    assert all(0 <= r.score <= 1 for r in found.values())
    right = [(found[i].score >= toxicity.CUT) == bool(y) for i, _, _, y in rows]
    assert sum(right) / len(right) >= 0.95


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, t, "en", y) for i, (t, y) in enumerate(made(60))]
    labelled = spark.createDataFrame([r[1:] for r in rows], "text string, lang string, toxic int")
    found = toxicity.toxicity(awkward(spark), labelled).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.toxicity(empty(spark), labelled).count() == 0
    for few in (labelled.where("false"), labelled.where("toxic = 0"), labelled.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.toxicity(awkward(spark), few).count() == 10


def test_base_scores_against_brute_force(spark):
    from pagecorpus.llm.queries import op8_suffix_tree

    texts = {r["doc_id"]: r["text"] for r in documents()}
    counts = Counter()
    for i, t in texts.items():
        if crc(i) % 10:
            counts.update([*suffix_tree.tokens_of(t), suffix_tree.END])
    n, v = sum(counts.values()), len(counts)
    found = op8_suffix_tree(spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        words = [*suffix_tree.tokens_of(texts[r.doc_id]), suffix_tree.END]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.held_out == (crc(r.doc_id) % 10 == 0)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


class SlowTree:
    """The same tree with dictionaries of word tuples and a recursive chance."""

    def __init__(self, texts):
        lines = [("<", *suffix_tree.tokens_of(t), suffix_tree.END) for t in texts]
        grams = Counter(tuple(x[i : i + k]) for x in lines for k in range(1, suffix_tree.DEEPEST + 2) for i in range(len(x) - k + 1))
        self.words = {g[0]: n for g, n in grams.items() if len(g) == 1 and g != ("<",)}
        self.tokens = sum(self.words.values())
        self.states, self.longest = {}, 0
        examined = {(w,): n for w, n in self.words.items() if n >= 2 and w != suffix_tree.END} | {("<",): len(lines)}
        for length in range(1, suffix_tree.DEEPEST + 1):
            seen = {g: n for g, n in grams.items() if len(g) == length + 1 and n >= 2 and g[:-1] in examined}
            own = {}
            for g, n in seen.items():
                if n * math.log2(n / examined[g[:-1]] / self.chance(g[1:-1], g[-1])) > suffix_tree.LEAST_GAIN:
                    own.setdefault(g[:-1], {})[g[-1]] = n
            if not own:
                break
            self.longest = length
            for context, following in own.items():
                total = examined[context]
                self.states[context] = (following, total - sum(following.values()) + len(following), total + len(following))
            examined = {g: n for g, n in seen.items() if g[-1] != suffix_tree.END and g[1:] in own}

    def chance(self, context, word):
        if not context:
            return (self.words.get(word, 0) + 0.1) / (self.tokens + 0.1 * (len(self.words) + 1))
        if context not in self.states:
            return self.chance(context[1:], word)
        following, left, whole = self.states[context]
        return (following.get(word, 0) + left * self.chance(context[1:], word)) / whole

    def score(self, text):
        line = ["<", *suffix_tree.tokens_of(text), suffix_tree.END]
        return sum(math.log10(self.chance(tuple(line[max(0, i - suffix_tree.DEEPEST) : i]), line[i])) for i in range(1, len(line)))


def test_tree_of_the_query_against_dictionaries(spark):
    from pagecorpus.llm.queries import op8_suffix_tree

    texts = {r["doc_id"]: r["text"] for r in documents()}
    slow = SlowTree([t for i, t in texts.items() if crc(i) % 10])
    found = op8_suffix_tree(spark, FOLDER).collect()
    assert len(found) == len(texts) and slow.states
    for r in found:
        assert r.score == pytest.approx(slow.score(texts[r.doc_id]), abs=1e-5)


def test_deep_contexts_and_joined_grams(spark, monkeypatch):
    """Contexts of every length, with all grams carried and with nearly none; chances sum to one."""
    monkeypatch.setattr(suffix_tree, "LEAST_GAIN", 1.0)
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(120):
        text, last = [], 0
        for _ in range(rng.integers(0, 30)):
            last = (last + 1 + (text[-3:-2] == [2])) % 6 if rng.random() < 0.6 else int(rng.integers(0, 6))
            text.append(last)
        texts.append(" ".join(f"w{x}" for x in text))
    texts += ["x w1 y w2 z w3", "q w1 y w2 z w4"] * 3
    slow = SlowTree(texts)
    assert slow.longest == suffix_tree.DEEPEST
    for context in [(), ("<",), *list(slow.states)[::17]]:
        unseen = slow.chance(context, b"unseen")
        assert sum(slow.chance(context, w) for w in slow.words) + unseen == pytest.approx(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for carried, chunk in ((suffix_tree.CARRIED_GRAMS, suffix_tree.CHUNK), (5, 40)):
        monkeypatch.setattr(suffix_tree, "CARRIED_GRAMS", carried)
        monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
        monkeypatch.setattr(suffix_tree, "PAIRS", chunk)
        found = suffix_tree.score_texts(docs, F.lit(True)).collect()
        assert len(found) == len(texts)
        for r in found:
            assert r.score == pytest.approx(slow.score(texts[r.doc_id]), abs=1e-6)


def test_keys_equal_those_of_spark(spark):
    rng = np.random.default_rng(5)
    first, last = (rng.integers(-(2**63), 2**63 - 1, 200, dtype=np.int64) for _ in range(2))
    table = spark.createDataFrame([(int(a), int(b)) for a, b in zip(first, last)], "a bigint, b bigint")
    found = {(r.a, r.b): r.k for r in table.select("a", "b", F.xxhash64("a", "b").alias("k")).collect()}
    assert [found[int(a), int(b)] for a, b in zip(first, last)] == suffix_tree.joined_keys(first, last).tolist()
    words = spark.createDataFrame([(w,) for w in (b"a", b"a longer word than 32 bytes, as they come", "\u00fc".encode())], "w binary")
    for r in words.select("w", F.xxhash64("w").alias("k")).collect():
        assert suffix_tree._symbols([bytes(r.w)], {}, np.zeros(0, dtype=np.int64))[1].tolist() == [r.k]


def test_words_looked_up_by_the_join(spark, monkeypatch):
    """With few carried words the rest go through the join and give the same scores."""
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i % 50} " * 3) for i in range(100)], "doc_id bigint, text string")
    training = F.col("doc_id") % 10 != 0
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in suffix_tree.score_texts(docs, training).collect()}
    monkeypatch.setattr(suffix_tree, "CARRIED", 3)
    monkeypatch.setattr(suffix_tree, "FLUSH", 5)
    few = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in suffix_tree.score_texts(docs, training).collect()}
    assert whole == few and len(whole) == 100


def test_identifiers_of_other_types(spark):
    docs = spark.createDataFrame([("x", "a b a b"), ("y", "a c")], "doc_id string, text string")
    found = {r.doc_id: r.n_tokens for r in suffix_tree.score_texts(docs, F.lit(True)).collect()}
    assert found == {"x": 5, "y": 3}


def test_scores_of_awkward_rows(spark):
    found = suffix_tree.score_texts(awkward(spark), F.lit(True)).collect()
    assert len(found) == 10
    assert all(r.n_tokens == 1 for r in found if r.doc_id in (2, 3, 4))
    assert suffix_tree.score_texts(empty(spark), F.lit(True)).count() == 0
    untrained = suffix_tree.score_texts(awkward(spark), F.lit(None).cast("boolean")).collect()
    assert len(untrained) == 10 and all(r.n_known == r.train_tokens == 0 and r.base_score == 0 for r in untrained)
