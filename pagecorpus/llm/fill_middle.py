"""Fill-in-the-middle rearrangement of texts, cut at lines found in an indexable skip list.

The lines of a text stand in lanes: lane 0 links every line to the next, and a line in four
rises to the lane above. Every link carries its width in lines and in code points. A cut rank
is reached from the top lane down by adding up line widths that stay at or below the rank; the
code-point widths of the same links add up to the place of the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.session import spread

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: A lane with this many links or fewer has none above it; one node in 2^RISE bits rises.
SHORT, RISE = 8, 2
#: Characters of output a task holds before it hands them on.
HELD = 4 << 20

FORM = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def line_widths(text: str) -> np.ndarray:
    """Code points of each line ``[^\\n]*\\n|[^\\n]+``, counted on the UTF-8 bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(raw[:-1] == 10) + 1
    starts = np.concatenate((np.zeros(1, dtype=np.int64), starts))
    return np.add.reduceat((raw & 0xC0 != 0x80).astype(np.int64), starts)


def _rising(nodes: int) -> np.ndarray:
    """Which nodes of a lane rise, the head first; the same for lanes of equal length."""
    number = np.arange(nodes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RISE)
    return np.concatenate(([0], np.flatnonzero(number[1:] == 0) + 1))


class SkipList:
    """Units of given widths with express lanes; ``place(rank)`` takes logarithmic steps."""

    def __init__(self, widths: np.ndarray):
        #: Per lane from the bottom: widths in units and in points of the links, and where
        #: each node stands in the lane below.
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        units, points, below = np.ones(len(widths), dtype=np.int64), widths, np.zeros(0, dtype=np.int64)
        while True:
            self.lanes.append((units.tolist(), points.tolist(), below.tolist()))
            if len(units) <= SHORT:
                break
            below = _rising(len(units) + 1)
            last = below[-1]
            if len(below) < 2:
                break
            units, points = (np.add.reduceat(w[:last], below[:-1]) for w in (units, points))

    def place(self, rank: int) -> int:
        """Points before unit ``rank``, which may be the number of units."""
        node, at, points = 0, 0, 0
        for lane, (units, wide, below) in reversed(list(enumerate(self.lanes))):
            while node < len(units) and at + units[node] <= rank:
                at += units[node]
                points += wide[node]
                node += 1
            if lane:
                node = below[node]
        return points


def rearranged(
    text: str, doc_id: object, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS
) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    widths = line_widths(text)
    n = len(widths)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    lines = SkipList(widths)
    low, high = (lines.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    pre, suf, mid = marks
    if h4 % 100 < spm_percent:
        return n, "spm", low, high - low, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", low, high - low, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n, form, prefix_chars, middle_chars, output)``.

    ``n`` counts the lines; cuts, form and order come from a hash of ``seed`` and identifier.
    ``form`` is plain (the text as it is: empty, holding a mark, or not drawn), psm or spm.
    A null text is empty; a null identifier hashes like an empty one; repeated rows are
    rearranged alike. Other columns are not looked at. An empty table gives no rows. Every
    mark must begin with a character that none has further on, so that output can be undone.
    """
    if any(m[:1] in other[1:] for m in marks for other in marks) or not all(marks) or len(set(marks)) < 3:
        raise ValueError("marks must differ and begin with a character that none of them has further on")
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, found = 0, 0, []
            for k, (number, value) in enumerate(zip(*batch.columns)):
                found.append(rearranged(value.as_py(), number.as_py(), seed, fim_percent, spm_percent, marks))
                held += len(found[-1][-1])
                if held > HELD or k == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), *columns], names)
                    first, held, found = k + 1, 0, []

    return rows.mapInArrow(moved, f"doc_id {kind}, {FORM}")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone."""
    pre, suf, mid = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        after = lambda whole, part, mark: F.substr(whole, F.length(part) + len(mark) + 1)
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = after(body, one, second)
        two = F.substring_index(rest, mid, 1)
        return one, two, after(rest, two, mid)

    prefix, suffix, middle = parts(pre, suf)
    suffix_, prefix_, middle_ = parts(suf, pre)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
    )
