"""Benchmark decontamination by greedy string tiling.

Texts are joined to test items on shared token seeds; for every pair that shares one, the
longest non-overlapping common runs are marked again and again by running Karp-Rabin, in
search lengths that shrink to the seed's. An item counts as leaked if the marked tiles
cover enough of it, wherever in the text and in whatever order they stand.

The items are a query set that goes against all texts in blocks of bounded size, so a
benchmark of any size fits: a larger one takes more blocks, not more memory.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm.common import FILE, ROW, bare, give_back, located, without
from pagecorpus.session import freeze, spread

#: Tokens of a seed, and so of the shortest tile. A shorter item is a seed as a whole.
SEED = 5
#: Share of an item's tokens under tiles from which on it counts as leaked.
COVERED = 0.6
#: Search length to begin with.
FIRST = 64
#: Characters of items per block.
BLOCK_CHARS = 4 << 20

_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _TOKEN.findall((text or "").lower())


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of every window of a length, modulo 2 ** 64, by doubling."""
    if len(ids) < length:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, part, done = _BASE, ids.astype(np.uint64), 1
        total, have = None, 0
        left = length
        while True:
            if left & 1:
                total = part.copy() if total is None else total[: len(part) - have] * power + part[have:]
                have += done
                total = total[: len(ids) - have + 1]
            left >>= 1
            if not left:
                return total
            part = part[: len(part) - done] * power + part[done:]
            power, done = power * power, done * 2


@dataclass
class Items:
    """A block of test items: their token numbers, and the seeds of all of them."""

    names: list
    tokens: list[np.ndarray]
    numbers: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, dict[int, list[int]]]]

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        numbers: dict[str, int] = {}
        tokens = [np.array([numbers.setdefault(t, len(numbers) + 1) for t in tokens_of(x)], dtype=np.int64) for _, x in rows]
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, ids in enumerate(tokens):
            if len(ids):
                n = min(SEED, len(ids))
                for h in set(rolling(ids, n).tolist()):
                    found[n][h].append(k)
        seeds = {n: (np.array(sorted(d), dtype=np.uint64), dict(d)) for n, d in found.items()}
        return Items([name for name, _ in rows], tokens, numbers, seeds)

    def sharing(self, ids: np.ndarray) -> list[int]:
        """Items that share a seed with a text."""
        found: set[int] = set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, (hashes, items) in self.seeds.items():
            if len(ids) < n:
                continue
            own = np.unique(rolling(ids, n)[unknown[n:] == unknown[:-n]])
            at = np.searchsorted(hashes, own)
            for h in own[hashes[np.minimum(at, len(hashes) - 1)] == own].tolist():
                found.update(items[h])
        return sorted(found)


def _longest(item: np.ndarray, text: np.ndarray, length: int, free_i: np.ndarray, free_t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Size of the longest unmarked common runs if it is ``length`` or more, else 0, and their places in both.

    Every hit of a window is followed along its diagonal from where the run begins, for all
    places in the text at once, so memory is bounded by the text also where both sides repeat
    one token.
    """

    def windows(ids: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[length:] == taken[:-length])
        return rolling(ids, length)[at], at

    best, places = 0, []
    if len(item) >= length and len(text) >= length:
        hashes, at_item = windows(item, free_i)
        own, at_text = windows(text, free_t)
        order = np.argsort(own, kind="stable")
        own, at_text = own[order], at_text[order]
        low, high = np.searchsorted(own, hashes, "left"), np.searchsorted(own, hashes, "right")
        for k in np.flatnonzero(high > low):
            i, t = int(at_item[k]), at_text[low[k] : high[k]]
            if i and free_i[i - 1]:
                t = t[(t == 0) | ~free_t[t - 1] | (text[t - 1] != item[i - 1])]
            # Tokens are compared from the start: the hash alone proves nothing.
            size = np.zeros(len(t), dtype=np.int64)
            going = np.arange(len(t))
            for n in range(len(item) - i):
                if not len(going) or not free_i[i + n]:
                    break
                going = going[t[going] + n < len(text)]
                going = going[free_t[t[going] + n] & (text[t[going] + n] == item[i + n])]
                size[going] += 1
            most = int(size.max(initial=0))
            if most >= max(best, length):
                places = places if most == best else []
                best = most
                places.append((i, t[size == most]))
    if not places:
        return 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return best, np.concatenate([np.full(len(t), i) for i, t in places]), np.concatenate([np.sort(t) for _, t in places])


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED, first: int = FIRST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(size, in item, in text)``, longest first.

    No token of either side lies under two tiles. Equal sizes go to the smaller places.
    """
    free_i, free_t = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    done: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(item)))
    while True:
        longest, at_item, at_text = _longest(item, text, length, free_i, free_t)
        if longest > 2 * length:
            length = longest
            continue
        if not longest:
            if length == least:
                return done
            length = max(least, length // 2)
        # Only the longest are marked in a pass: what they leave of others is found again.
        while len(at_item):
            i, t = int(at_item[0]), int(at_text[0])
            free_i[i : i + longest] = free_t[t : t + longest] = False
            done.append((longest, i, t))
            taken = [np.concatenate(([0], np.cumsum(~free))) for free in (free_i, free_t)]
            left = (taken[0][at_item + longest] == taken[0][at_item]) & (taken[1][at_text + longest] == taken[1][at_text])
            at_item, at_text = at_item[left], at_text[left]


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about ``block_chars`` characters, dealt by hash."""
    rows = items.select(F.col(item_id).alias("i"), F.coalesce(text, F.lit("")).alias("x")).distinct()
    rows = freeze(rows)
    chars = rows.agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("i", "x"), F.lit(n)) == k) if n > 1 else rows
        yield Items.of([(r.i, r.x) for r in block.collect()])


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    covered: float = COVERED,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(doc_id, item_id, item_tokens, covered_tokens, coverage, n_tiles, longest_tile, tiles)``.

    One row for each row of ``docs`` and item whose coverage is at least ``covered``;
    ``tiles`` lists (item_start, text_start, length) in tokens, by item_start. Null and
    empty texts and items without a token match nothing. Repeated rows of ``docs`` give
    repeated rows; items equal in identifier and text count once. Identifiers may be null;
    other columns are not looked at; empty tables give no rows.
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")))
    number = items.schema[item_id].dataType.simpleString()
    kind = rows.schema["doc_id"].dataType.simpleString()
    form = (
        f"doc_id {kind}, item_id {number}, item_tokens bigint, covered_tokens bigint, coverage double, "
        "n_tiles int, longest_tile int, tiles array<struct<item_start:int,text_start:int,length:int>>"
    )
    tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("length", pa.int32())]))
    item_type = items.select(item_id).limit(0).toArrow().schema.field(0).type
    spark = docs.sparkSession

    def against(block: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # of block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            known = own.numbers.get
            for batch in batches:
                found: list[tuple] = []
                for doc, text_ in zip(batch.column(0), batch.column(1)):
                    words = tokens_of(text_.as_py())
                    ids = np.fromiter((known(w, 0) for w in words), dtype=np.int64, count=len(words))
                    for k in own.sharing(ids):
                        item = own.tokens[k]
                        done = tiles(item, ids, min(SEED, len(item)))
                        under = sum(size for size, _, _ in done)
                        if done and under >= covered * len(item):
                            spans = [{"item_start": i, "text_start": t, "length": s} for s, i, t in sorted(done, key=lambda d: d[1])]
                            found.append(
                                (doc.as_py(), own.names[k], len(item), under, under / len(item), len(done), done[0][0], spans)
                            )
                columns = list(zip(*found)) or [()] * 8
                types = [None, None, pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), tile_type]
                types[0], types[1] = batch.column(0).type, item_type
                names = ["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "n_tiles", "longest_tile", "tiles"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            give_back()

        return rows.mapInArrow(run, form)

    return reduce(DataFrame.unionByName, [against(b) for b in _blocks(items, item_id, item_text, block_chars)])


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item has leaked."""
    source = bare(docs)
    rows = located(source, source.columns)
    key = F.concat_ws("#", F.col(ROW).cast("string"), FILE)
    pairs = leaked_items(rows.select(key.alias("key"), F.col(text).alias("text")), items, "key", "text", item_id, item_text)
    cut = F.split("doc_id", "#", 2)
    return without(rows, pairs.select(cut[0].cast("bigint").alias(ROW), cut[1].alias(FILE)))
