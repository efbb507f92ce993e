"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Lengths are placed longest first, each into the pack with most room, by counts: packs with
equal contents are one pattern with a count, so the work depends on the longest length and
not on the number of documents. The patterns are then joined back to the pieces by their
rank within their length. Ranks are counted in hash buckets and shifted by the counts of
the buckets before, so the pieces of one length never meet in one task.
"""

from __future__ import annotations

import math
import os
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.llm.common import crc32_of, give_back
from pagecorpus.session import freeze, spread

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 2048, 1
TOKENIZER = "byte_bpe_50k.json"
#: Strings between blanks whose ids a worker keeps, and characters it works on at once.
KEPT, BLOCK = 600_000, 1 << 20
#: Texts of a batch that are encoded before they are cut into pieces.
AT_ONCE = 128
#: Pieces per hash bucket in which ranks are counted.
BUCKET_ROWS = 100_000

#: A blank of any kind before a blank or line break.
_BLANK = "\t\n\v\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TWO_BLANKS = f"[{_BLANK}][ \n]"


class Encoder:
    """Token ids of whole texts; the ids of strings between blanks are encoded once and kept.

    The vocabulary's pre-tokenizer always ends a token between a non-blank and a following
    blank or line break, so a text may be cut there. Texts in which another blank comes
    before such a place are encoded as they are, and so are texts that hold an added token.
    """

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.index: dict[str, int] = {}
        self.kept = kept
        self.starts, self.sizes = np.zeros(kept + BLOCK, dtype=np.int64), np.zeros(kept + BLOCK, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # Every character of a byte-level token stands for one byte.
        self.bytes = np.ones(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)

    def whole(self, text: str) -> np.ndarray:
        # The form without character offsets, which nobody asks for here.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Encode new strings in one go and cut the ids where the bytes of each end."""
        joined = "".join(new)
        ids = self.whole(joined)
        ends = np.cumsum([len(s.encode()) for s in new])
        token_ends = np.cumsum(self.bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(ids) == 0 or not np.array_equal(token_ends[np.minimum(last, len(ids) - 1)], ends):
            raise ValueError("a token crosses the end of a string")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), dtype=np.uint32)))
        at = len(self.index)
        first = np.concatenate(([0], last[:-1] + 1))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[at : at + len(new)], self.sizes[at : at + len(new)] = self.used + first, last + 1 - first
        self.used += len(ids)
        self.index.update(zip(new, range(at, at + len(new))))

    def encode(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of some texts, without nulls; longer ones than ``BLOCK`` in parts."""
        unsafe = pc.match_substring_regex(texts, _TWO_BLANKS)
        for token in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, token))
        unsafe = unsafe.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        held, total = [], 0
        for k in range(len(texts)):
            if unsafe[k] or sizes[k] > BLOCK:
                text = texts[k].as_py()
                parts = [text] if any(t in text for t in self.added) else _blocks(text)
                out[k] = np.concatenate([self.whole(p) if _unsafe(p) or len(parts) == 1 and unsafe[k] else self._short(pa.array([p]))[0] for p in parts])
            elif sizes[k]:
                held.append(k)
                total += sizes[k]
            if held and (total > BLOCK or k == len(texts) - 1):
                for i, ids in zip(held, self._short(texts.take(pa.array(held)))):
                    out[i] = ids
                held, total = [], 0
        return out

    def _short(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of safe, non-empty texts: their strings between blanks are told apart in one go."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        first = offsets[:-1] - offsets[0]
        begins = (data == 32) | (data == 10)
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data)).astype(np.int32)
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        names = strings.dictionary.to_pylist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        missing = np.flatnonzero(at < 0)
        new = [names[i] for i in missing]
        known, used = len(self.index), self.used
        # Strings with a blank in front can stand one after the other; others start a text.
        for p in new:
            if p[0] not in " \n":
                self._learn([p])
        rest = [p for p in new if p[0] in " \n"]
        if rest:
            self._learn(rest)
        at[missing] = [self.index[p] for p in new]
        at = at[strings.indices.to_numpy()]
        sizes = self.sizes[at]
        last = np.cumsum(sizes)
        ids = self.pool[np.arange(last[-1]) + np.repeat(self.starts[at] - last + sizes, sizes)]
        if known + len(new) > self.kept:
            # Full: what is known stays, the strings of this part are forgotten again.
            for p in new:
                del self.index[p]
            self.used = used
        return np.split(ids, last[np.searchsorted(starts, first[1:]) - 1])


@lru_cache(maxsize=1)
def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder per worker process, so that what it has learned outlives a task."""
    return Encoder(path, kept)


def _unsafe(text: str) -> bool:
    """Whether a blank or line break follows another blank of any kind."""
    return bool(pc.match_substring_regex(pa.array([text]), _TWO_BLANKS)[0].as_py())


def _blocks(text: str) -> list[str]:
    """A long text cut before single blanks; one without any stays whole."""
    at, parts = 0, []
    while len(text) - at > BLOCK:
        cut = text.find(" ", at + BLOCK)
        while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenised(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    tokenizer: str | None = None,
    end: int = END,
    with_ids: bool = False,
    strings: int = KEPT,
    retain: bool = True,
) -> DataFrame:
    """Pieces of at most ``length`` ids: ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``.

    A document's ids and the end id are cut from the front into full pieces and a rest.
    ``tokenizer`` is the path of a tokenizer file on the executors. A worker keeps the ids of
    ``strings`` strings; without ``retain`` it gives that memory back after each task. A null text is empty and
    has one piece, the end id. Identifiers may be null or repeat; other columns are not
    looked at; an empty table gives no pieces.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    form = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # of what other work has left in this worker
        own = (encoder if retain else Encoder)(tokenizer or default_tokenizer(), strings)
        for batch in batches:
            origin, starts, sizes, checks, totals, kept, held = [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(origin, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (starts, sizes, checks, totals)]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, names)

            texts = batch.column(1).fill_null("")
            for k, found in enumerate(i for at in range(0, len(texts), AT_ONCE) for i in own.many(texts.slice(at, AT_ONCE))):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    origin.append(k)
                    starts.append(at)
                    sizes.append(len(part))
                    checks.append(crc32_of(part))
                    totals.append(len(ids))
                    if with_ids:
                        kept.append(part.astype(np.int32))
                        held += len(part)
                if held > 1 << 22:
                    yield out()
                    origin, starts, sizes, checks, totals, kept, held = [], [], [], [], [], [], 0
            yield out()
        del own
        give_back()

    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))).mapInArrow(cut, form)


@dataclass(frozen=True)
class Pattern:
    """The lengths of a pack in the order in which they stand, and how many packs are alike."""

    lengths: tuple[int, ...]
    count: int


def shortest_pack_first(histogram: dict[int, int], capacity: int = LENGTH) -> list[Pattern]:
    """Patterns that hold every length as often as the histogram says.

    Longest lengths first; each goes to the packs with most room, that is the shortest. If
    it doesn't fit there it fits nowhere and opens packs of its own.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room
    closed: list[tuple[tuple[int, ...], int]] = []
    shortest = min(histogram, default=0)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]

        def place(lengths: tuple[int, ...], count: int, room: int) -> None:
            (open_packs[room] if room >= shortest else closed).append((lengths, count))

        while left and max(open_packs, default=0) >= size:
            room = max(open_packs)
            lengths, count = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(count, left)
            if count > used:
                place(lengths, count - used, room)
            place((*lengths, size), used, room - size)
            left -= used
        # A fresh pack has most room, so it takes the length as often as it fits.
        each = capacity // size
        for copies, count in ((each, left // each), (left % each, 1)):
            if copies and count:
                place((size,) * copies, count, capacity - copies * size)
    packs = closed + [p for group in open_packs.values() for p in group]
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for lengths, count in packs:
        merged[lengths] += count
    return [Pattern(k, merged[k]) for k in sorted(merged, reverse=True)]


def placements(patterns: Sequence[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, end rank, first sequence, offset)`` for every place in a pattern."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for size in p.lengths:
            rows.append((size, used[size], used[size] + p.count, sequence, offset))
            used[size] += p.count
            offset += size
        sequence += p.count
    return rows


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 within a sequence.

    Only the histogram of lengths, ``capacity`` rows at most, and the patterns, whose number
    depends on it alone, reach the driver. Pieces alike in all columns take ranks in any
    order. Without pieces there are no rows.
    """
    pieces = freeze(pieces)
    spark = pieces.sparkSession
    sizes = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = placements(shortest_pack_first(sizes, capacity))
    ranges: dict[int, list[tuple]] = defaultdict(list)
    for size, low, high, sequence, offset in rows:
        ranges[size].append((low, high, sequence, offset))
    by_length = spark.createDataFrame(
        [(size, sorted(r)) for size, r in sorted(ranges.items())],
        "length bigint, ranges array<struct<low:bigint,high:bigint,sequence:bigint,offset:bigint>>",
    )
    n = max(1, math.ceil(sum(sizes.values()) / BUCKET_ROWS))
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    dealt = pieces.withColumn("_bucket", F.pmod(key, F.lit(n)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(shifts, ["length", "_bucket"])
    placed = ranked.withColumn("_rank", F.col("_in") + F.col("_before")).join(F.broadcast(by_length), "length")
    own = F.filter("ranges", lambda r: (r["low"] <= F.col("_rank")) & (F.col("_rank") < r["high"]))[0]
    placed = placed.withColumn("_own", own)
    return placed.select(
        *pieces.columns,
        (F.col("_own.sequence") + F.col("_rank") - F.col("_own.low")).alias("sequence_id"),
        F.col("_own.offset").alias("offset"),
    )


def sequences(packed: DataFrame, capacity: int = LENGTH, padding: int = 0) -> DataFrame:
    """``(sequence_id, ids, used)`` of pieces packed with their ids.

    A sequence is padded to ``capacity`` unless its ids fill a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence: capacity ids at most
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("_ids"))
    used = F.size("_ids")
    whole = F.bit_count(used) == 1
    filled = F.concat("_ids", F.array_repeat(F.lit(padding), F.lit(capacity) - used))
    return joined.select("sequence_id", F.when(whole, F.col("_ids")).otherwise(filled).alias("ids"), used.alias("used"))
