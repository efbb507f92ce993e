"""Text fitting: vertical columns, wrapped lines, largest size that fits, containers.

Horizontal widths come from a small advance-width table (thousandths of an em per
character class) in place of font metrics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.functions.text import _col

# The factors, shares and size limits in the functions below.


@dataclass(frozen=True)
class AdvanceWidths:
    """Thousandths of an em by class of the first code point of a character."""

    wide: int = 920
    narrow: int = 300
    other: int = 560
    space: int = 260
    wide_pattern: str = r"^[\x{1100}-\x{11ff}\x{2e80}-\x{d7a3}\x{f900}-\x{faff}\x{ff00}-\x{ff60}\x{1f300}-\x{1faff}]"
    narrow_pattern: str = r"^[iljtfr.,:;!'|()\[\]]"

    def of(self, char: Column) -> Column:
        return (
            F.when(F.rlike(char, F.lit(self.narrow_pattern)), self.narrow)
            .when(F.rlike(char, F.lit(self.wide_pattern)), self.wide)
            .otherwise(self.other)
        )


# Every character and the space count one: widths are then character counts.
UNIT_WIDTHS = AdvanceWidths(wide=1, narrow=1, other=1, space=1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column | str, widths: AdvanceWidths) -> Column:
    """Array of ``(word, chars, w, total)``: characters and widths of each word."""
    parts = F.filter(F.split(_col(text), " "), lambda p: p != "")

    def measured(part: Column) -> Column:
        chars = F.regexp_extract_all(part, F.lit(r"(\X)"), F.lit(1))
        return F.struct(part.alias("word"), chars.alias("chars"), F.transform(chars, widths.of).alias("w"))

    def totalled(m: Column) -> Column:
        total = F.aggregate(m["w"], F.lit(0), lambda acc, w: acc + w)
        return F.struct(m["word"].alias("word"), m["chars"].alias("chars"), m["w"].alias("w"), total.alias("total"))

    return F.transform(F.transform(parts, measured), totalled)


def wrapped_lines(measured: Column | str, limit: Column, space: int) -> Column:
    """Greedy lines no wider than ``limit``; a longer word is split by character.

    A split word starts a new line and its last piece continues as the current line.
    """
    limit = limit.cast("double")
    start = F.struct(
        F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"), F.lit(0).alias("cur_w")
    )

    def state(lines: Column, cur: Column, cur_w: Column) -> Column:
        return F.struct(lines.alias("lines"), cur.alias("cur"), cur_w.alias("cur_w"))

    def split_word(word: Column, done: Column) -> Column:
        def step(acc: Column, char: Column) -> Column:
            full = (acc["cur"] != "") & (acc["cur_w"] + char["w"] > limit)
            return F.when(
                full, state(F.array_append(acc["lines"], acc["cur"]), char["chars"], char["w"])
            ).otherwise(state(acc["lines"], F.concat(acc["cur"], char["chars"]), acc["cur_w"] + char["w"]))

        return F.aggregate(F.arrays_zip(word["chars"], word["w"]), state(done, F.lit(""), F.lit(0)), step)

    def place(acc: Column, word: Column) -> Column:
        first = acc["cur"] == ""
        joined_w = F.when(first, word["total"]).otherwise(acc["cur_w"] + F.lit(space) + word["total"])
        joined = F.when(first, word["word"]).otherwise(F.concat(acc["cur"], F.lit(" "), word["word"]))
        done = F.when(first, acc["lines"]).otherwise(F.array_append(acc["lines"], acc["cur"]))
        return (
            F.when(joined_w <= limit, state(acc["lines"], joined, joined_w))
            .when(word["total"] <= limit, state(done, word["word"], word["total"]))
            .otherwise(split_word(word, done))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["cur"]))

    return F.aggregate(_col(measured), start, place, finish)


def line_count(measured: Column | str, limit: Column, space: int) -> Column:
    """Number of lines :func:`wrapped_lines` gives, without building them."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("cur_w"))

    def state(n: Column, cur_w: Column) -> Column:
        return F.struct(n.alias("n"), cur_w.alias("cur_w"))

    def split_word(word: Column, done: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            full = (acc["cur_w"] > 0) & (acc["cur_w"] + w > limit)
            return state(acc["n"] + full.cast("int"), F.when(full, w).otherwise(acc["cur_w"] + w))

        return F.aggregate(word["w"], state(done, F.lit(0)), step)

    def place(acc: Column, word: Column) -> Column:
        joined_w = F.when(acc["cur_w"] == 0, word["total"]).otherwise(acc["cur_w"] + F.lit(space) + word["total"])
        done = acc["n"] + (acc["cur_w"] > 0).cast("int")
        return (
            F.when(joined_w <= limit, state(acc["n"], joined_w))
            .when(word["total"] <= limit, state(done, word["total"]))
            .otherwise(split_word(word, done))
        )

    return F.aggregate(_col(measured), start, place, lambda acc: acc["n"] + (acc["cur_w"] > 0).cast("int"))


def first_fitting(high: Column, low: Column, fits: Callable[[Column], Column]) -> Column:
    """First of ``high, high - 1, ...`` down to ``low`` that fits, null when none does.

    Sizes after the first fit are not tried.
    """
    none = F.lit(None).cast("double")
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(high - low).cast("int")))

    def attempt(found: Column, i: Column) -> Column:
        size = high - i.cast("double")
        return F.coalesce(found, F.when((size >= low) & fits(size), size))

    return F.aggregate(steps, none, attempt)


def _minimum_size(r: Column, scale: float, base: float, share: float) -> Column:
    wanted = F.greatest(F.lit(base), F.least(r["width"], r["height"]) * F.lit(share)) * F.lit(scale)
    return F.greatest(F.lit(8.0), F.least(F.greatest(wanted, F.lit(11.0)), F.lit(28.0)))


def _base(text_only: bool) -> float:
    return 10.0 if text_only else 13.0


def vertical_columns(units: Column, rows: Column) -> Column:
    """Characters in chunks of ``rows``; no characters, no columns."""
    size = F.greatest(rows, F.lit(1))

    def chunks(u: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(u) - 1, F.lit(0)), size)
        cut = F.transform(starts, lambda i: F.slice(u, i + 1, size))
        return F.when((F.size(u) > 0) & (rows > 0), cut).otherwise(F.array().cast("array<array<string>>"))

    return _let(units, chunks)


def fit_vertical(
    blocks: DataFrame,
    rect: str = "text_rect",
    n_chars: str = "n_chars",
    detected: str = "detected_font_size",
    scale: float = 1.0,
    text_only: bool = False,
) -> DataFrame:
    """Add font_size, line_height, column_width, max_rows, n_columns, overflow."""
    r, n = F.col(rect), F.col(n_chars)
    width = F.greatest(F.lit(1.0), r["width"] - F.lit(4.0))
    height = F.greatest(F.lit(1.0), r["height"] - F.lit(4.0))
    geometry = F.least(r["width"] * F.lit(0.52), r["height"] * F.lit(0.16))
    source = F.coalesce(F.col(detected) * F.lit(0.78), geometry)
    high = F.least(F.greatest(geometry, source, F.lit(16.0)), F.lit(96.0)) * F.lit(scale)
    low = _minimum_size(r, scale, _base(text_only), 0.12)

    def rows(size: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col("_h") / F.ceil(size * F.lit(1.08))).cast("int"))

    def columns(size: Column) -> Column:
        return F.ceil(n / rows(size)).cast("int")

    def fits(size: Column) -> Column:
        return (n > 0) & (columns(size) * F.ceil(size * F.lit(1.18)) <= F.col("_w"))

    staged = blocks.withColumns({"_w": width, "_h": height, "_high": high, "_low": low})
    staged = staged.withColumn("_fit", first_fitting(F.col("_high"), F.col("_low"), fits))
    hard = F.greatest(F.lit(7.0), F.col("_low") * F.lit(0.72))
    staged = staged.withColumn("font_size", F.coalesce("_fit", hard))
    size = F.col("font_size")
    return (
        staged.withColumn("line_height", F.ceil(size * F.lit(1.08)).cast("double"))
        .withColumn("column_width", F.ceil(size * F.lit(1.18)).cast("double"))
        .withColumn("max_rows", rows(size))
        .withColumn("n_columns", columns(size))
        .withColumn("overflow", F.col("_fit").isNull())
        .drop("_w", "_h", "_high", "_low", "_fit")
    )


def fit_horizontal(
    blocks: DataFrame,
    text: str = "render_text",
    rect: str = "text_rect",
    detected: str = "detected_font_size",
    scale: float = 1.0,
    text_only: bool = False,
    widths: AdvanceWidths = AdvanceWidths(),
    with_lines: bool = True,
) -> DataFrame:
    """Add font_size, line_height, n_lines, overflow and, if asked, lines.

    ``text`` is one-line text (see ``renderable``).
    """
    r = F.col(rect)
    width = F.greatest(F.lit(1.0), r["width"] - F.lit(12.0))
    height = F.greatest(F.lit(1.0), r["height"] - F.lit(8.0))
    geometry = F.least(r["height"] * F.lit(0.42), r["width"] * F.lit(0.22))
    source = F.coalesce(F.col(detected) * F.lit(0.92), geometry)
    high = F.least(F.greatest(geometry, source, F.lit(16.0)), F.lit(112.0)) * F.lit(scale)
    low = _minimum_size(r, scale, _base(text_only), 0.10)
    hard = F.greatest(F.lit(7.0), F.col("_low") * F.lit(0.72))

    staged = blocks.withColumns(
        {"_w": width, "_h": height, "_high": high, "_low": low, "_words": words(text, widths)}
    ).withColumns(
        {
            "_ink": F.aggregate("_words", F.lit(0).cast("bigint"), lambda acc, w: acc + w["total"]),
            "_widest": F.array_max(F.transform("_words", lambda w: F.array_max(w["w"]))),
            "_hard": hard,
        }
    )

    def limit(size: Column) -> Column:
        return F.col("_w") * F.lit(1000.0) / size

    def lines_allowed(size: Column) -> Column:
        return F.floor(F.col("_h") / F.ceil(size * F.lit(1.06)))

    def fits(size: Column) -> Column:
        # Cheap necessary conditions first: one character per line fits, the ink fits.
        cheap = (F.col("_widest") <= limit(size)) & (F.col("_ink") <= limit(size) * lines_allowed(size))
        return cheap & (line_count("_words", limit(size), widths.space) <= lines_allowed(size))

    fitting = F.coalesce(
        first_fitting(F.col("_high"), F.col("_low"), fits),
        first_fitting(F.col("_low") - F.lit(1.0), F.col("_hard"), fits),
    )
    sized = staged.withColumn("_fit", fitting).withColumn("font_size", F.coalesce("_fit", "_hard"))
    size = F.col("font_size")
    result = sized.withColumn("line_height", F.ceil(size * F.lit(1.06)).cast("double"))
    if with_lines:
        result = result.withColumn("lines", wrapped_lines("_words", limit(size), widths.space)).withColumn(
            "n_lines", F.size("lines")
        )
    else:
        result = result.withColumn("n_lines", line_count("_words", limit(size), widths.space))
    return result.withColumn("overflow", F.col("_fit").isNull()).drop(
        "_w", "_h", "_high", "_low", "_words", "_ink", "_widest", "_hard", "_fit"
    )


def container_rect(
    fallback: Column, original: Column, region: Column, img_w: Column, img_h: Column
) -> Column:
    """Light region joined with the text box when large enough, else ``fallback``.

    ``region`` is null where no light region was found (or the style does not use it).
    """
    merged = g.union_rect(region, original)
    large = (merged["width"] >= fallback["width"] * F.lit(0.72)) & (
        merged["height"] >= fallback["height"] * F.lit(0.72)
    )
    return F.when(region.isNotNull() & large, g.clamp_rect(merged, img_w, img_h)).otherwise(fallback)


def needs_narrow_column(bubble: Column, flow: Column, source_is_vertical: Column) -> Column:
    """Horizontal text from a vertical source in a tall bubble is set in one column."""
    tall = bubble["height"] >= bubble["width"] * F.lit(1.12)
    return (flow == g.HORIZONTAL) & F.coalesce(source_is_vertical, F.lit(False)) & tall


def column_width(base: Column, original: Column, bubble: Column) -> Column:
    narrow = F.least(original["width"] * F.lit(0.70), bubble["width"] * F.lit(0.44))
    return F.least(base["width"], F.greatest(F.lit(96.0), narrow))


def text_rect(bubble: Column, original: Column, flow: Column, source_is_vertical: Column, column_x: Column) -> Column:
    """Where text goes inside ``bubble``.

    ``column_x`` is the best light column position or null, which centres the column.
    """
    base = g.text_inset(bubble, flow)
    width = column_width(base, original, bubble)
    middle = bubble["x"] + bubble["width"] / F.lit(2.0) - width / F.lit(2.0)
    centred = F.greatest(base["x"], F.least(g.max_x(base) - width, middle))
    column = g.rect(F.coalesce(column_x, centred), base["y"], width, base["height"])
    return F.when(needs_narrow_column(bubble, flow, source_is_vertical), column).otherwise(base)
