"""Passages that repeat across documents, by seed and extend.

Seeds are winnowed anchors: of every ``length - GRAM + 1`` neighbouring grams of ``GRAM`` words
the one of smallest hash, so that two documents that share ``length`` words hold the same
anchor at the same place in them. Documents are joined on anchors that lie in two or more of
them. A match is extended in both directions as far as a window of ``length`` words over the
anchor can reach, in two steps:

* occurrences whose whole surroundings are equal meet under one key: each but the first
  document's is covered on both sides, however many there are;
* where surroundings differ, which is at the edges of a passage, one occurrence of each kind
  is laid against the others at every alignment of a window over the anchor.

Both steps are keyed minima of identifiers, so no pairs within a group are ever made. Runs that
overlap are joined into maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import broadcast_if_small, freeze, spread

LENGTH, GRAM, SEED = 50, 16, 42
#: Rows a task holds before it hands them on, and grams compared at once.
HELD, BLOCK = 1 << 18, 1 << 16
#: Characters of kept text a task holds before it hands them on.
HELD_CHARS = 4 << 20
#: Uses of a key from which its rows are dealt out over salts, and rows per salt.
HOT, PER_SALT = 20_000, 5_000

#: Odd multipliers of the two running hashes of word sequences, with their inverses mod 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)

#: A document by identifier and text, since identifiers may repeat.
DOC = ["doc_id", "t"]


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Runs:
    """Hashes of any run of a document's words, from running sums of its words' hashes."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        own = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
        self.sums, self.powers = [], []
        for k, (base, inverse) in enumerate(zip(BASES, _INVERSES)):
            falling = np.full(len(words), inverse, dtype=np.uint64)
            falling[:1] = 1
            rising = np.full(len(words) + 1, base, dtype=np.uint64)
            rising[:1] = 1
            np.cumprod(falling, out=falling)
            total = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum((mixed(own + np.uint64(k))) * falling, out=total[1:])
            self.sums.append(total)
            self.powers.append(np.cumprod(rising))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        total = self.sums[which]
        return mixed((total[ends] - total[starts]) * self.powers[which][starts])


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the last smallest hash of every ``width`` neighbours, each once, in order."""
    found = []
    for at in range(0, len(hashes) - width + 1, BLOCK):
        part = hashes[at : at + BLOCK + width - 1]
        views = np.lib.stride_tricks.sliding_window_view(part, width)
        found.append(np.unique(np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1)) + at)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def anchors_of(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Places, hashes and two hashes of the surroundings of a document's anchors."""
    n = len(words)
    if n < length:
        return tuple(np.zeros(0, dtype=t) for t in ("i8", "u8", "u8", "u8"))
    runs = Runs(words)
    starts = np.arange(n - gram + 1)
    grams = runs.hashes(starts, starts + gram, 0)
    at = winnowed(grams, length - gram + 1)
    low, high = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
    # Surroundings of unequal extent are unequal.
    extent = ((at - low) * (2 * length) + (high - low)).astype(np.uint64)
    one, two = (mixed(runs.hashes(low, high, k) ^ extent) for k in (0, 1))
    return at, grams[at], one, two


def _rows(batches: Iterator[pa.RecordBatch], keys: int, names: list[str], per_row: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of the first ``keys`` columns and of the arrays that ``per_row`` makes of the other ones."""
    for batch in batches:
        origin, held = [], []
        for k in range(batch.num_rows):
            held.append(per_row(*(c[k].as_py() for c in batch.columns[keys:])))
            origin += [k] * len(held[-1][0])
            if len(origin) >= HELD or k == batch.num_rows - 1:
                made = [np.concatenate(c) for c in zip(*held)]
                columns = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[:keys]]
                columns += [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in made]
                yield pa.RecordBatch.from_arrays(columns, names)
                origin, held = [], []


def _smaller(first: str) -> Column:
    """Whether ``first``, the least identifier of a group, is smaller than the row's own; null comes last."""
    return F.col(first).isNotNull() & (F.col("doc_id").isNull() | (F.col(first) < F.col("doc_id")))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    return rows.select("doc_id", F.xxhash64("_text").alias("t"), "_text")


def _by_document(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` joined to ``found``, unique per document; null identifiers are equal."""
    found = broadcast_if_small(found)
    same = [rows[c].eqNullSafe(found[c]) for c in DOC]
    return rows.join(found, same, how).drop(*[found[c] for c in DOC])


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``(doc_id, t, at, n, a, c, d)``: place, words of the document, hashes of anchor and surroundings."""

    def per_row(text: str):
        words = words_of(text)
        at, *hashes = anchors_of(words, length, gram)
        return at, np.full(len(at), len(words)), *hashes

    form = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t bigint, at int, n int, a bigint, c bigint, d bigint"
    return spread(rows).mapInArrow(lambda batches: _rows(batches, 2, [*DOC, "at", "n", "a", "c", "d"], per_row), form)


def _windows(rows: DataFrame, edges: DataFrame, length: int, gram: int) -> DataFrame:
    """``(doc_id, t, s, c, d)``: start and hashes of all windows over the anchors ``edges(doc_id, t, at)``."""

    def per_row(text: str, places: list[int]):
        words = words_of(text)
        starts = np.zeros(len(words) - length + 2, dtype=np.int64)
        for at in places:
            starts[max(0, at - length + gram)] += 1
            starts[min(at, len(words) - length) + 1] -= 1
        s, runs = np.flatnonzero(np.cumsum(starts)), Runs(words)
        return s, *(runs.hashes(s, s + length, k) for k in (0, 1))

    per_doc = freeze(edges.groupBy(*DOC).agg(F.collect_set("at").alias("places")))
    texts = _by_document(rows, per_doc, "inner")
    form = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t bigint, s int, c bigint, d bigint"
    return texts.mapInArrow(lambda batches: _rows(batches, 2, [*DOC, "s", "c", "d"], per_row), form)


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, t, low, high)``: words of a document that lie in a window of ``length`` words
    which also starts in a document of smaller identifier.

    Runs may overlap. ``t`` is the XXH64 of the text. Anchors are only candidates; 128 bits
    of hash stand for windows and surroundings. See :func:`cut_repeats` for awkward rows.
    """
    if not 0 < gram <= length:
        raise ValueError("an anchor must fit into a window")
    rows = _named(docs, doc_id, text)
    reach = length - gram
    anchors = freeze(_anchors(rows, length, gram))

    # Seeds: anchors that lie in one document only can match nothing.
    ids = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("none")]
    seeds = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("uses"), *ids)
    seeds = freeze(seeds.where((F.col("least") < F.col("most")) | (F.col("none") & F.col("least").isNotNull())).select("a", "uses"))
    met = freeze(spread_lookup(anchors, seeds, ["a"], "uses", ["doc_id", "at"], "inner", HOT, PER_SALT))

    # Equal surroundings: a match that reaches as far as any window over the anchor.
    around = freeze(met.groupBy("a", "c", "d").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("uses")))
    kinds = freeze(around.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).withColumn("differ", F.col("kinds") > 1))
    around = freeze(spread_lookup(around, kinds, ["a"], "kinds", ["c", "d"], "inner", HOT, PER_SALT))
    met = freeze(spread_lookup(met, around, ["a", "c", "d"], "uses", ["doc_id", "at"], "inner", HOT, PER_SALT))
    wide = met.where(_smaller("first")).select(
        *DOC, F.greatest(F.lit(0), F.col("at") - reach).alias("low"), F.least("n", F.col("at") + length).alias("high")
    )

    # Unequal ones: the first document of each kind, at every alignment.
    windows = freeze(_windows(rows, met.where(F.col("differ") & ~_smaller("first")), length, gram))
    firsts = windows.groupBy("c", "d").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("uses"))
    firsts = freeze(firsts.where("uses > 1"))
    laid = spread_lookup(windows, firsts, ["c", "d"], "uses", ["doc_id", "s"], "inner", HOT, PER_SALT)
    narrow = laid.where(_smaller("first")).select(*DOC, F.col("s").alias("low"), (F.col("s") + length).alias("high"))
    return wide.unionByName(narrow)


def _cut(text: str, runs: list[dict]) -> tuple[int, list[dict], str]:
    """Words of a text, its maximal runs, and the other words."""
    words, merged, kept, at = words_of(text), [], [], 0
    for run in sorted(runs, key=lambda r: r["low"]):
        if merged and run["low"] <= merged[-1]["high"]:
            merged[-1]["high"] = max(merged[-1]["high"], run["high"])
        else:
            merged.append(dict(run))
    for run in merged:
        kept += words[at : run["low"]]
        at = run["high"]
    return len(words), merged, b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass")


def maximal(runs: Column) -> Column:
    """Runs ``(low, high)`` in order, those that overlap or touch joined."""

    def extend(done: Column, run: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], run["high"]).alias("high"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when(run["low"] <= last["high"], joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<low:int,high:int>>"), extend)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, removed, kept)``.

    ``removed`` are the maximal runs ``(low, high)`` of words covered by windows of ``length``
    words that also start in a document of smaller identifier, ``kept`` the other words
    joined by single spaces. Windows are judged on the input. Rows of one identifier are one
    document: they take nothing from each other. A null identifier is larger than any other.
    Null and empty texts and those under ``length`` words lose nothing. Other columns are not
    looked at. An empty table gives no rows. Identifiers must have an order.
    """
    rows = _named(docs, doc_id, text)
    runs = repeated_runs(docs, doc_id, text, length, gram).groupBy(*DOC)
    # One per passage instead of one per window, so that runs may travel and the texts stay.
    runs = freeze(runs.agg(maximal(F.collect_list(F.struct("low", "high"))).alias("runs")))
    form = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, removed array<struct<low:int,high:int>>, kept string"
    types = [pa.int64(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])), pa.string()]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, found = 0, 0, []
            for k, (value, spans) in enumerate(zip(batch.column(2), batch.column(3))):
                found.append(_cut(value.as_py(), spans.as_py() or []))
                held += len(found[-1][2])
                if held > HELD_CHARS or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    ids = batch.column(0).slice(first, len(found))
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "removed", "kept"])
                    first, held, found = k + 1, 0, []

    return _by_document(spread(rows), runs, "left").select(*DOC, "_text", "runs").mapInArrow(parted, form)
