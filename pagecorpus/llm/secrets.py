"""Secrets in texts, with DataFrame functions only; nothing is shuffled.

Known forms are found by pattern. The rest are candidate strings whose sliding-window
Shannon entropy, kept up by incremental character counts, is high for their character
class, less an allow-list of well-known harmless forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the known forms and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters per entropy window.
WINDOW = 20
#: Least bits per character, for hexadecimal strings and for mixed ones.
HEX_BITS, MIXED_BITS = 2.9, 3.6
#: Harmless candidates: UUIDs, digits only, no digit or no letter, sample words, plain sequences.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^[^0-9]*$|^[^A-Za-z]*$|example|sample|dummy|placeholder|abcdefgh|01234567|12345678|xxxxxx"
)
_LOW, _CELLS = ord("+"), ord("z") - ord("+") + 1


def _matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping: array of (start, end, match) in code points."""
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<struct<start:bigint,end:bigint,match:string>>").alias("found"),
    )

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.when(pair["match"].isNull(), state).otherwise(
            F.struct(end.alias("at"), F.concat(state["found"], one).alias("found"))
        )

    return F.aggregate(pairs, start, step, lambda s: s["found"])


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of any window, in bits per character.

    Every step adds one character and takes off the one that leaves; the sum of
    c * log2(c) over the counts c is kept up from the two counts that change.
    """

    def term(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - _LOW)
    leaving = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    pairs = F.slice(F.arrays_zip(codes.alias("into"), leaving.alias("out")), 1, F.greatest(F.length(text), F.lit(1)))
    state = F.struct(
        F.array_repeat(F.lit(0), _CELLS).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("n"),
        F.lit(0.0).alias("best"),
    )

    def step(s: Column, pair: Column) -> Column:
        old_out = F.coalesce(F.get(s["counts"], pair["out"]), F.lit(0))
        less = s["sum"] - term(old_out) + term(old_out - 1)
        same = pair["out"].eqNullSafe(pair["into"])
        old_in = F.get(s["counts"], pair["into"]) - F.when(same, 1).otherwise(0)
        total = less - term(old_in) + term(old_in + 1)
        counts = F.transform(
            s["counts"],
            lambda c, i: c + F.when(i == pair["into"], 1).otherwise(0) - F.when(i.eqNullSafe(pair["out"]), 1).otherwise(0),
        )
        n = s["n"] + 1
        bits = F.lit(window).cast("double")
        now = F.when(n >= window, F.log2(bits) - total / bits).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(pairs, state, step, lambda s: s["best"])


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, base, found)``.

    ``base`` and ``found`` are arrays of (start, rank, end, kind) sorted by start and then
    kind, in code points with exclusive ends; a span of kind assign is the whole match.
    ``base`` has the known forms, ``found`` also candidates of high entropy that lie
    outside them. A null text counts as empty and has no spans. Identifiers may be null or
    repeat; other columns are not looked at; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_t"))
    low = F.lower("_t")
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token")
    named = named | low.contains("apikey") | low.contains("api_key")

    def kept(spans: Column, kind: str, long_enough) -> Column:
        good = F.filter(spans, lambda s: long_enough(s["match"]))
        rank = KINDS.index(kind)
        return F.transform(
            good,
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    # A shorter run than the least length is dropped by its pattern already, and a run
    # can't begin inside another, so the counted forms find what "+" and a filter would.
    access = rf"{ACCESS[:-1]}{{{LEAST_ACCESS - 4},}}"
    hexes = rf"{HEX[:-1]}{{{LEAST_HEX},}}"
    always = lambda m: F.lit(True)
    rows = rows.select(
        "doc_id",
        "_t",
        kept(
            F.when(named, _matches(F.col("_t"), ASSIGN)).otherwise(_none()),
            "assign",
            lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN,
        ).alias("_assign"),
        kept(F.when(F.col("_t").contains("AKIA"), _matches(F.col("_t"), access)).otherwise(_none()), "access", always).alias("_access"),
        kept(F.when(F.col("_t").rlike(hexes), _matches(F.col("_t"), hexes)).otherwise(_none()), "hex", always).alias("_hex"),
        F.filter(
            F.when(F.col("_t").rlike(CANDIDATE), _matches(F.col("_t"), CANDIDATE)).otherwise(_none()),
            lambda s: ~s["match"].rlike(ALLOWED),
        ).alias("_candidates"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))

    def random_enough(span: Column) -> Column:
        least = F.when(span["match"].rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"), HEX_BITS).otherwise(MIXED_BITS)
        inside = F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return ~inside & (window_entropy(span["match"]) >= least)

    added = kept(F.filter("_candidates", random_enough), "entropy", always)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("found"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
