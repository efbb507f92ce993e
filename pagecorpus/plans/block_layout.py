"""Layout of text blocks: flow, cover area, container, text area, fitted size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import geometry as g
from pagecorpus.functions.text import char_count, graphemes, renderable
from pagecorpus.operators import layout, regions
from pagecorpus.operators.blocks import drawable
from pagecorpus.session import freeze


def measured_blocks(blocks: DataFrame) -> DataFrame:
    """Drawable blocks with rect, render_text, n_chars, flow and fallback.

    ``blocks`` carry box, img_w, img_h, original_text, translated_text,
    source_is_vertical and detected_font_size.
    """
    w, h = F.col("img_w"), F.col("img_h")
    shown = drawable(blocks).withColumn("render_text", renderable("display_text"))
    counted = shown.withColumn("n_chars", char_count("render_text")).withColumn("rect", g.pixel_rect(F.col("box"), w, h))
    flowed = counted.withColumn("flow", g.text_flow(F.col("rect"), F.col("n_chars")))
    return flowed.withColumn("fallback", g.redaction_rect(F.col("rect"), F.col("flow"), F.col("n_chars"), w, h))


def lay_out(
    blocks: DataFrame,
    keys: Sequence[str] = ("page_key", "pos"),
    text_only: bool = False,
    sampler: regions.Sampler | None = None,
    scale: float = 1.0,
    widths: layout.AdvanceWidths = layout.AdvanceWidths(),
) -> DataFrame:
    """``(keys, flow, container, text_rect, font_size, line_height, lines, columns, overflow)``.

    ``text_only`` draws on the page itself: containers then follow the light region that
    ``sampler`` finds around each text.
    """
    keys = list(keys)
    w, h = F.col("img_w"), F.col("img_h")
    staged = measured_blocks(blocks)
    if text_only and sampler is not None:
        staged = freeze(staged)
        found = regions.light_regions(regions.search_windows(staged), sampler, keys)
        staged = staged.join(found, keys, "left")
    else:
        staged = staged.withColumn("region", F.lit(None).cast(staged.schema["rect"].dataType))
    container = layout.container_rect(F.col("fallback"), F.col("rect"), F.col("region"), w, h)
    staged = staged.withColumn("container", g.integral_rect(container))
    bubble, rect = F.col("container"), F.col("rect")
    if text_only and sampler is not None:
        staged = freeze(staged)
        narrow = staged.where(layout.needs_narrow_column(bubble, F.col("flow"), F.col("source_is_vertical")))
        base = g.text_inset(bubble, F.col("flow"))
        bases = narrow.withColumn("base", base).withColumn("column_width", layout.column_width(base, rect, bubble))
        staged = staged.join(regions.best_column_x(bases, sampler, keys), keys, "left")
    else:
        staged = staged.withColumn("column_x", F.lit(None).cast("double"))
    staged = staged.withColumn(
        "text_rect",
        layout.text_rect(bubble, rect, F.col("flow"), F.col("source_is_vertical"), F.col("column_x")),
    )
    kept = [*keys, "flow", "container", "text_rect", "font_size", "line_height", "lines", "columns", "overflow"]
    upright = layout.fit_vertical(staged.where(F.col("flow") == g.VERTICAL), scale=scale, text_only=text_only)
    upright = upright.withColumn("columns", layout.vertical_columns(graphemes("render_text"), F.col("max_rows")))
    across = layout.fit_horizontal(
        staged.where(F.col("flow") == g.HORIZONTAL), scale=scale, text_only=text_only, widths=widths
    )
    return (
        upright.withColumn("lines", F.lit(None).cast("array<string>"))
        .select(*kept)
        .unionByName(across.withColumn("columns", F.lit(None).cast("array<array<string>>")).select(*kept))
    )
