"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of 64-bit slots serves 64 languages: bit l of a slot belongs to language l. The
AND of an n-gram's slots returns every language that contains it in one look-up per table;
there are as many tables as all languages need. For a text
the bits are counted per language, the counts are corrected for the filters' false
positives, and the language with the largest corrected count decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagecorpus.llm.common import give_back
from pagecorpus.session import broadcast_if_small, freeze, spread

UNDETERMINED = "und"
#: Lengths of the n-grams, in characters of a line in which runs of non-letters are one blank.
SIZES = (2, 3, 4)
#: Labelled documents per language the filters are fitted on, at most.
SAMPLE = 2_000
#: An n-gram belongs to a language if it makes up this share of the language's n-grams of
#: its length, and at least a quarter of the share it has in any other language.
LEAST_SHARE = {2: 1e-3, 3: 2e-4, 4: 5e-5}
AGAINST_BEST = 0.25
#: Slots per inserted n-gram, and slots read per n-gram.
SLOTS_PER_GRAM, HASHES = 16, 3
#: Languages per table of slots.
PER_TABLE = 64
#: Characters worked on at once; bounds memory for a text of any length.
BLOCK = 1 << 19


@dataclass
class Filters:
    """The slots of every 64 languages, the languages by table and bit, and the share of n-grams each holds falsely."""

    languages: list[str]
    slots: np.ndarray | list[np.ndarray]
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to its lower case, or to a blank if it is no letter."""
    table = np.full(0x110000, ord(" "), dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _line(text: str) -> np.ndarray:
    """The folded code points with runs of blanks squeezed and one blank at both ends."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _grams(line: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every n-gram of a line."""
    n = len(line) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + line[i : i + n]
    return _mixed(total)


def gram_hashes(line: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The n-gram hashes of a whole folded text, block by block."""
    for at in range(0, max(1, len(line)), BLOCK):
        yield _grams(line[at : at + BLOCK + size - 1], size)


def _slots_of(hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * step) & np.uint64(n - 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def scores(text: str, filters: Filters) -> tuple[np.ndarray, int]:
    """Corrected counts per language, and the number of n-grams."""
    counts, total, line = np.zeros(len(filters.languages)), 0, _line(text)
    tables = filters.slots if isinstance(filters.slots, list) else [filters.slots]
    for size in SIZES:
        for hashes in gram_hashes(line, size):
            if not len(hashes):
                continue
            total += len(hashes)
            for first, table in zip(range(0, len(counts), PER_TABLE), tables):
                held = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
                for slots in _slots_of(hashes, len(table)):
                    held &= table[slots]
                held = held[held != 0]
                for bit in range(min(PER_TABLE, len(counts) - first)):
                    counts[first + bit] += int(((held >> np.uint64(bit)) & np.uint64(1)).sum())
    wrong = filters.false_rate
    return np.clip((counts - wrong * total) / np.maximum(1 - wrong, 1e-6), 0, None), total


def predict(text: str | None, filters: Filters) -> tuple[str, float, float]:
    """``(language, score, fit)``: the share of the best among all corrected counts, and the
    share of the text's n-grams the best language holds."""
    if not filters.languages or not has_letter(text):
        return UNDETERMINED, 0.0, 0.0
    counts, total = scores(text, filters)
    best = int(counts.argmax())
    whole = counts.sum()
    return (
        filters.languages[best],
        float(counts[best] / whole) if whole else 0.0,
        float(min(1.0, counts[best] / total)) if total else 0.0,
    )


def _sample(labelled: DataFrame, text: str, lang: str, per_language: int) -> DataFrame:
    """At most ``per_language`` distinct texts of each language, chosen by their hash."""
    rows = labelled.select(F.col(text).alias("_text"), F.col(lang).alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    # Copies of a text are one, so the share that is kept follows the distinct texts.
    distinct = rows.select("_lang", F.xxhash64("_text").alias("_digest")).distinct()
    sizes = freeze(distinct.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")))
    key = F.pmod(F.xxhash64("_text"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    few = rows.withColumn("_key", key).join(broadcast_if_small(sizes), "_lang").where(F.col("_key") * F.col("_n") <= 2 * per_language)
    order = Window.partitionBy("_lang").orderBy("_key", "_text")
    return few.distinct().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language).select("_text", "_lang")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE) -> Filters:
    """Fit the filters on a bounded sample of every language.

    What reaches the driver is one row per kept n-gram, bounded by the inverse of the least
    shares for each language, whatever the number of documents.
    """
    spark = labelled.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for text_, lang_ in zip(batch["_text"], batch["_lang"]):
                line = _line(text_)
                for size in SIZES:
                    for hashes in gram_hashes(line, size):
                        grams, times = np.unique(hashes.view(np.int64), return_counts=True)
                        found.setdefault((lang_, size), Counter()).update(dict(zip(grams.tolist(), times.tolist())))
            rows = [(k, size, g, n) for (k, size), c in found.items() for g, n in c.items()]
            yield pd.DataFrame(rows, columns=["lang", "size", "gram", "n"])
            del found, rows
        give_back()

    sample = spread(freeze(_sample(labelled, text, lang, per_language)))
    counted = sample.mapInPandas(count, "lang string, size int, gram bigint, n bigint")
    counted = freeze(counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang", "size"))
    shares = counted.withColumn("share", share)
    best = F.max("share").over(Window.partitionBy("size", "gram"))
    least = F.coalesce(*[F.when(F.col("size") == s, F.lit(v)) for s, v in LEAST_SHARE.items()])
    kept = shares.withColumn("best", best).where((F.col("share") >= least) & (F.col("share") >= AGAINST_BEST * F.col("best")))
    rows = kept.select("lang", "gram").toPandas()
    grams = {name: part.to_numpy(dtype=np.int64) for name, part in rows.groupby("lang")["gram"]}
    languages = sorted(grams)
    tables, filled = [], []
    for first in range(0, max(1, len(languages)), PER_TABLE):
        own = languages[first : first + PER_TABLE]
        distinct = len(np.unique(np.concatenate([grams[name] for name in own]))) if own else 1
        n = 1 << max(10, int(np.ceil(np.log2(distinct * SLOTS_PER_GRAM))))
        slots = np.zeros(n, dtype=np.uint64)
        for bit, name in enumerate(own):
            for at in _slots_of(grams[name].view(np.uint64), n):
                np.bitwise_or.at(slots, at, np.uint64(1 << bit))
        filled += [((slots >> np.uint64(b)) & np.uint64(1)).mean() for b in range(len(own))]
        tables.append(slots)
    return Filters(languages, tables, np.array(filled) ** HASHES)


def identify(spark: SparkSession, filters: Filters, text: Column) -> Column:
    """Struct (lang, score, fit) of a text column."""
    shared = spark.sparkContext.broadcast(filters)  # the kept n-grams of the learned languages

    @F.pandas_udf("lang string, score double, fit double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([predict(t, shared.value) for t in batch], columns=["lang", "score", "fit"])
        give_back()

    return run(text)


def language_of(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, lang_pred, score, fit)``.

    Learned from the rows for which ``training`` holds and ``lang`` is not null. A text that
    is null or has no letter is ``und`` with score 0, and so is every text if nothing could
    be learned. Equal counts go to the language that sorts first. Identifiers may be null or
    repeat; other columns are not looked at; an empty table gives no rows.
    """
    filters = learn(docs.where(training), text, lang)
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    found = rows.select("doc_id", identify(docs.sparkSession, filters, F.col("_text")).alias("r"))
    return found.select("doc_id", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), F.col("r.fit").alias("fit"))
