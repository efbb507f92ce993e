"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed vectors of the word, its first and its last letters.
Filters of several widths run over the words, each is max pooled over the whole text, and a
logistic layer gives the score. The network learns from every distinct labelled text: shards
of them are trained side by side from shared weights and what they changed is averaged, round
after round. Scoring projects every distinct word once and then only adds and compares.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.session import broadcast_if_small, freeze, spread

#: Score from which a text counts as toxic where nothing else is said.
CUT = 0.3
#: Rows of each class that :func:`_chosen` takes at least half of; no model is learned from them.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 3_000
#: Labelled texts that are trained on one after the other; shards, of this size about, meet
#: after each of so many rounds over all texts.
SHARD_ROWS, ROUNDS = 4_500, 2
#: Weights of a row in which changes are summed up, and steps of a logit in which cuts are looked for.
CHUNK, STEPS = 1 << 13, 100
#: Words whose buckets a worker remembers while it trains.
KNOWN_WORDS = 200_000

BUCKETS, DIMENSIONS = 1 << 16, 12
WIDTHS, FILTERS = (1, 2, 3), 6
COLUMNS = [(w, j) for w in WIDTHS for j in range(w)]
EPOCHS, RATE, DECAY = 3, 0.05, 1e-4
#: Distinct words a worker keeps projected, and words worked on at once.
KEPT_WORDS, BLOCK_WORDS = 200_000, 1 << 17

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Network:
    """Weights, and the cut of each language on the calibration rows."""

    embeddings: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def pieces(word: str) -> tuple[int, int, int]:
    """Buckets of a word, its first four letters and its last three."""
    mask = BUCKETS - 1
    return (
        crc32(word.encode()) & mask,
        crc32(b"<" + word[:4].encode()) & mask,
        crc32(word[-3:].encode() + b">") & mask,
    )


def _pooled(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of every filter and where it begins; minus infinity if none fits."""
    n, at = len(projected), 0
    best = np.full((len(WIDTHS), FILTERS), -np.inf, dtype=np.float32)
    where = np.zeros((len(WIDTHS), FILTERS), dtype=np.int64)
    for k, width in enumerate(WIDTHS):
        if n >= width:
            total = projected[: n - width + 1, at : at + FILTERS].copy()
            for j in range(1, width):
                total += projected[j : n - width + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            where[k] = total.argmax(axis=0)
            best[k] = total[where[k], np.arange(FILTERS)]
        at += width * FILTERS
    return best.ravel(), where.ravel()


def _logit(best: np.ndarray, net: Network) -> tuple[float, np.ndarray]:
    hidden = np.maximum(best + net.bias, 0)
    return float(hidden @ net.out[:-1] + net.out[-1]), hidden


def _start(toxic: np.ndarray, clean: np.ndarray, p: int, n: int, random: np.random.Generator) -> Network:
    """Small random weights; the first dimension and filter begin as the log-odds of pieces.

    ``toxic`` and ``clean`` are in how many of ``p`` and ``n`` texts of a class each bucket occurs.
    """
    p, n = max(1, p), max(1, n)
    odds = np.log((toxic + 0.5) / (p + 1)) - np.log((clean + 0.5) / (n + 1))
    sure = np.maximum(toxic, clean) / (np.maximum(toxic, clean) + 3 + 0.01 * p)
    embeddings = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embeddings[:, 0] = np.where(toxic + clean > 0, odds * sure, 0) / 2
    kernel = random.normal(0, 0.2, (DIMENSIONS, len(COLUMNS) * FILTERS)).astype(np.float32)
    kernel[:, 0] = 0
    kernel[0, 0] = 1
    out = np.zeros(len(WIDTHS) * FILTERS + 1, dtype=np.float32)
    out[0], out[-1] = 1, -3
    out[1:-1] = random.normal(0, 0.05, len(out) - 2)
    return Network(embeddings, kernel, np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32), out)


def _one_class(net: Network, p: int, n: int) -> Network:
    """Without a text of either class all scores are alike."""
    net.out[-1] = 6 if p and not n else -6
    return net


def _balance(p: int, n: int) -> float:
    return float(n / max(1, p)) ** 0.5


class Buckets:
    """The buckets of a text's words, one row each; those of frequent words are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = pieces(w)
        return np.array([self.known[w] for w in words], dtype=np.int64).reshape(-1, 3)


def _fresh_steps(net: Network) -> list[np.ndarray]:
    return [np.full_like(w, 0.1) for w in (net.embeddings, net.kernel, net.bias, net.out)]


_WIDTH_OF = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
_SHIFT_OF = np.array([j for _, j in COLUMNS])


def _step(net: Network, steps: list[np.ndarray], ids: np.ndarray, label: float, balance: float) -> None:
    """Learn from one whole text, with step sizes per weight."""
    if not len(ids):
        return
    vectors = net.embeddings[ids].sum(axis=1)
    best, where = _pooled(vectors @ net.kernel)
    z, hidden = _logit(best, net)
    slope = (1 / (1 + np.exp(-z)) - label) * (balance if label else 1.0)
    if abs(slope) < 1e-3:
        return
    grad_out = slope * np.append(hidden, 1).astype(np.float32) + DECAY * net.out
    back = np.where(hidden > 0, slope * net.out[:-1], 0).astype(np.float32)
    # Each column of the kernel met the text at one place: where its filter was greatest.
    g = back.reshape(len(WIDTHS), FILTERS)[_WIDTH_OF].ravel()
    places = (where.reshape(len(WIDTHS), FILTERS)[_WIDTH_OF] + _SHIFT_OF[:, None]).ravel()
    live = np.nonzero(g)[0]
    grad_kernel = np.zeros_like(net.kernel)
    grad_kernel[:, live] = (vectors[places[live]] * g[live, None]).T
    touched = ids[places[live]].ravel()
    grad_rows = np.repeat(g[live, None] * net.kernel[:, live].T, ids.shape[1], axis=0)
    for weight, step, grad in ((net.kernel, steps[1], grad_kernel), (net.bias, steps[2], back), (net.out, steps[3], grad_out)):
        step += grad * grad
        weight -= RATE * grad / np.sqrt(step)
    np.add.at(steps[0], touched, grad_rows * grad_rows)
    np.add.at(net.embeddings, touched, -RATE * grad_rows / np.sqrt(steps[0][touched]))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Train on whole texts, one at a time, in this process."""
    random, buckets = np.random.default_rng(seed), Buckets()
    rows, y = [buckets(t) for t in texts], np.asarray(labels, dtype=np.float32)
    p, n = int((y == 1).sum()), int((y == 0).sum())
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for ids, label in zip(rows, y):
        (toxic if label else clean)[np.unique(ids)] += 1
    net = _start(toxic, clean, p, n, random)
    if not p or not n:
        return _one_class(net, p, n)
    steps = _fresh_steps(net)
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            _step(net, steps, rows[r], y[r], _balance(p, n))
    return net


class Scorer:
    """Scores whole texts of any length with bounded memory."""

    def __init__(self, net: Network):
        self.net, self.index = net, {}
        self.rows = np.zeros((KEPT_WORDS + BLOCK_WORDS, net.kernel.shape[1]), dtype=np.float32)

    def _projected(self, words: list[str]) -> np.ndarray:
        new = {w for w in words if w not in self.index}
        if len(self.index) + len(new) > KEPT_WORDS:
            self.index, new = {}, set(words)
        if new:
            ids = np.array([pieces(w) for w in new], dtype=np.int64)
            at = len(self.index)
            self.rows[at : at + len(new)] = self.net.embeddings[ids].sum(axis=1) @ self.net.kernel
            self.index.update(zip(new, range(at, at + len(new))))
        return self.rows[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))]

    def logit(self, text: str | None) -> float:
        words, best = words_of(text), np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        for at in range(0, len(words), BLOCK_WORDS):
            # Blocks overlap by the widest filter less one word, so no window is missed.
            best = np.maximum(best, _pooled(self._projected(words[at : at + BLOCK_WORDS + WIDTHS[-1] - 1]))[0])
        return _logit(best, self.net)[0]

    def score(self, text: str | None) -> float:
        """Calibrated so that the best cut of the calibration rows is at ``CUT``."""
        z = self.logit(text) - self.net.shift + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def best_cut(values: np.ndarray, labels: np.ndarray) -> float | None:
    """The value with the fewest mistakes from which on to call toxic; midway in the gap."""
    if not len(values) or labels.min() == labels.max():
        return None
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    wrong = np.where(np.concatenate(([True], v[1:] > v[:-1], [True])), wrong, len(v) + 1)
    at = int(wrong.argmin())
    if at in (0, len(v)):
        return float(v[0] - 1 if at == 0 else v[-1] + 1)
    return float((v[at - 1] + v[at]) / 2)


def _share(column: str) -> Column:
    """A number from 0 to 1 that depends on a value alone."""
    return F.pmod(F.xxhash64(column), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def _chosen(rows: DataFrame, key: str, toxic: str) -> DataFrame:
    """Rows of about twice the sample's distinct keys of each class, chosen by the hash of ``key``."""
    distinct = rows.select(toxic, F.xxhash64(key).alias("__llm_digest")).distinct()
    sizes = {r[toxic]: r["n"] for r in distinct.groupBy(toxic).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    most = F.when(F.col(toxic) == 1, 2 * SAMPLE_TOXIC / max(1, sizes.get(1, 0))).otherwise(2 * SAMPLE_CLEAN / max(1, sizes.get(0, 0)))
    return rows.where(_share(key) <= most)


def _flat(net: Network, steps: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in (net.embeddings, net.kernel, net.bias, net.out, *steps)])


def _unflat(flat: np.ndarray, like: Network) -> tuple[Network, list[np.ndarray]]:
    parts, at = [], 0
    for w in (like.embeddings, like.kernel, like.bias, like.out) * 2:
        parts.append(flat[at : at + w.size].reshape(w.shape).copy())
        at += w.size
    return Network(*parts[:4]), parts[4:]


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of either class each bucket occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, found = Buckets(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"]):
                found[y, np.unique(buckets(text))] += 1
        bucket = np.nonzero(found.any(axis=0))[0]
        yield pd.DataFrame({"bucket": bucket, "clean": found[0, bucket], "toxic": found[1, bucket]})

    summed = rows.select("_text", "_y").mapInPandas(count, "bucket long, clean long, toxic long").groupBy("bucket")
    both = np.zeros((2, BUCKETS))
    for r in summed.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():  # BUCKETS rows at most
        both[:, r.bucket] = r.clean, r.toxic
    return both[1], both[0]


def _round(rows: DataFrame, net: Network, steps: list[np.ndarray], balance: float) -> tuple[Network, list[np.ndarray]]:
    """One round over all texts. A weight moves by the mean of the shards that changed it."""
    old = _flat(net, steps)
    shared = rows.sparkSession.sparkContext.broadcast((net, old))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        like, start = shared.value
        buckets, shard, first, own = Buckets(), None, None, None
        moved, movers = np.zeros(len(start), dtype=np.float32), np.zeros(len(start), dtype=np.float32)

        def close() -> None:
            if own is not None:
                change = _flat(*own) - start
                moved[:] += change
                movers[:] += change != 0

        for batch in batches:
            for s, text, y in zip(batch["_shard"], batch["_text"], batch["_y"]):
                if s != shard:
                    close()
                    shard, first, own = s, s if first is None else first, _unflat(start, like)
                _step(*own, buckets(text), y, balance)
        close()
        if first is not None:
            at = range(0, len(start), CHUNK)
            cut = lambda a: [a[i : i + CHUNK].tobytes() for i in at]
            yield pd.DataFrame({"chunk": range(len(at)), "first": first, "moved": cut(moved), "movers": cut(movers)})

    def mean(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("first")
        moved, movers = (sum(np.frombuffer(b, dtype=np.float32) for b in parts[c]) for c in ("moved", "movers"))
        return pd.DataFrame({"chunk": parts["chunk"][:1], "moved": [(moved / np.maximum(movers, 1)).astype(np.float32).tobytes()]})

    parts = rows.select("_shard", "_text", "_y").mapInPandas(run, "chunk long, first long, moved binary, movers binary")
    new = old.copy()
    for r in parts.groupBy("chunk").applyInPandas(mean, "chunk long, moved binary").collect():  # the weights, of fixed size
        new[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] += np.frombuffer(r.moved, dtype=np.float32)
    return _unflat(new, net)


def learn(labelled: DataFrame, text: str = "text", toxic: str = "toxic", lang: str = "lang") -> Network:
    """Train on every distinct labelled text, whole; a fifth of them, by hash, calibrates instead."""
    rows = labelled.select(
        F.coalesce(text, F.lit("")).alias("_text"), F.col(toxic).cast("int").alias("_y"), F.col(lang).alias("_lang")
    ).where(F.col("_y").isin(0, 1))
    shards = -(-rows.count() // SHARD_ROWS) or 1
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("_text"), F.lit(shards))).repartition(shards, "_shard")
    few = dealt.groupBy("_shard", "_text", "_y").agg(F.min("_lang").alias("_lang"))
    few = freeze(few.sortWithinPartitions("_shard", F.xxhash64("_text", F.lit(1)), "_y", "_text"))
    checks = F.pmod(F.xxhash64("_text", F.lit(2)), F.lit(5)) == 4
    fit = few.where(~checks)
    sizes = {r["_y"]: r["n"] for r in fit.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    net = _start(*_counts(fit), p, n, np.random.default_rng(1))
    if p and n:
        steps = _fresh_steps(net)
        for _ in range(ROUNDS):
            net, steps = _round(fit, net, steps, _balance(p, n))
    else:
        net = _one_class(net, p, n)
    return _calibrated(net, few.where(checks))


def _calibrated(net: Network, rows: DataFrame) -> Network:
    """The cuts with the fewest mistakes on ``rows``, over all and in each language."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("long")
    def step(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([round(STEPS * min(60.0, max(-60.0, scorer.logit(t)))) for t in batch], dtype="int64")

    binned = rows.select("_lang", "_y", step("_text").alias("bin")).groupBy("_lang", "bin", "_y").agg(F.count(F.lit(1)).alias("n"))
    found = binned.toPandas().sort_values(["bin", "_y"])  # no more rows than bins and languages
    net.shift = _binned_cut(found) or 0.0
    for name, own in found.groupby("_lang"):
        cut = _binned_cut(own)
        if cut is not None:
            net.cuts[name] = float(1 / (1 + np.exp(-np.clip(cut - net.shift + np.log(CUT / (1 - CUT)), -60, 60))))
    return net


def _binned_cut(found: pd.DataFrame) -> float | None:
    """:func:`best_cut` of counted values."""
    bins = found.pivot_table(index="bin", columns="_y", values="n", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0)
    clean, toxic, v = bins[0].to_numpy(), bins[1].to_numpy(), bins.index.to_numpy() / STEPS
    if not clean.sum() or not toxic.sum():
        return None
    wrong = np.concatenate(([0], np.cumsum(toxic))) + np.concatenate((np.cumsum(clean[::-1])[::-1], [0]))
    at = int(wrong.argmin())
    if at in (0, len(v)):
        return float(v[0] - 1 if at == 0 else v[-1] + 1)
    return float((v[at - 1] + v[at]) / 2)


def toxicity(
    docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic"
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, score, toxic)``.

    ``score`` depends on the text alone; null counts as empty, and an empty text has the
    score of no evidence. ``toxic`` compares it with the cut calibrated for the row's
    language, or with 0.3 where that is null or unknown. Labels other than 0 and 1 are not
    learned from; with labels of one class only, or none, all scores are alike. Identifiers
    may be null or repeat; other columns are not looked at; an empty table gives no rows.
    """
    net = learn(labelled, text, toxic, lang)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # the weights, of fixed size

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")

    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")))
    scored = rows.select("doc_id", "_lang", run("_text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= _cut_of(net, F.col("_lang"))).alias("toxic"))


def _cut_of(net: Network, lang: Column) -> Column:
    found = F.lit(None).cast("double")
    for name, cut in net.cuts.items():
        found = F.when(lang == name, F.lit(cut)).otherwise(found)
    return F.coalesce(found, F.lit(CUT))


def with_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic", text: str = "text") -> DataFrame:
    """The ``docs`` that have a label, with it; each text once per label.

    Labels meet digests of the texts, so copies count once and texts are not shuffled; of
    equal texts with equal labels the smallest identifier is taken. A repeated identifier
    takes the greatest of its labels. A column of the documents that is named like the label
    gives way to it.
    """
    docs = docs.drop(toxic)
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isin(0, 1))
    one = freeze(usable.groupBy(doc_id).agg(F.max(toxic).alias(toxic)))
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    digests = docs.select(doc_id, digest.alias("__llm_digest"))
    texts = digests.join(one, doc_id).groupBy(toxic, "__llm_digest").agg(F.min(doc_id).alias(doc_id))
    return docs.withColumn("__llm_digest", digest).join(broadcast_if_small(freeze(texts), 1_000_000), [doc_id, "__llm_digest"]).drop("__llm_digest")
