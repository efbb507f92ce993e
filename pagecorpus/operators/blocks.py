"""Block tables: normalisation, display text, page summaries and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.functions.geometry import box_of_corners, clipped_corners
from pagecorpus.functions.text import contains_script, display_text, is_blank, utrim

def normalise_boxes(blocks: DataFrame, xyxy: str = "xyxy", img_w: str = "img_w", img_h: str = "img_h") -> DataFrame:
    """Add ``box``; blocks without four usable corners are dropped."""
    w, h = F.col(img_w), F.col(img_h)
    cut = blocks.withColumn("_c", clipped_corners(F.col(xyxy), w, h)).where(F.col("_c").isNotNull())
    return cut.withColumn("box", box_of_corners(F.col("_c"), w, h)).drop("_c")


def block_content(blocks: DataFrame, lines: str = "text", translation: str = "translation") -> DataFrame:
    """Joined and trimmed original, trimmed translation; both empty drops the block."""
    texts = blocks.withColumn("original_text", utrim(F.array_join(F.col(lines), "\n"))).withColumn(
        "translated_text", utrim(F.coalesce(F.col(translation), F.lit("")))
    )
    kept = texts.where((F.col("original_text") != "") | (F.col("translated_text") != ""))
    return kept.withColumn("confidence", F.lit(1.0).cast("float"))


def with_display_text(blocks: DataFrame, trim_original: bool = True) -> DataFrame:
    return blocks.withColumn("display_text", display_text("translated_text", "original_text", trim_original))


def drawable(blocks: DataFrame) -> DataFrame:
    """Blocks that have something to show."""
    return with_display_text(blocks).where(F.coalesce(F.col("display_text") != "", F.lit(False)))


def page_summary(pages: DataFrame, blocks: DataFrame, script: tuple[str, str] = ("가", "힣"), key: str = "page_key") -> DataFrame:
    """Counts and verdicts per page; pages without blocks are kept with zeros.

    status: ok, no_text_blocks (nothing recognised: reported, not cached),
    no_translation_blocks (nothing to draw).
    """
    shown = F.coalesce(display_text("translated_text", "original_text") != "", F.lit(False))
    per_page = blocks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(shown).alias("n_drawable"),
        F.bool_or(~is_blank("translated_text")).alias("has_translation"),
        F.bool_or(contains_script("translated_text", *script)).alias("has_target_script"),
    )
    joined = pages.select(key).join(per_page, key, "left")
    blocks_n = F.coalesce("n_blocks", F.lit(0))
    drawable_n = F.coalesce("n_drawable", F.lit(0))
    return joined.select(
        key,
        blocks_n.alias("n_blocks"),
        drawable_n.alias("n_drawable"),
        F.coalesce("has_translation", F.lit(False)).alias("has_translation"),
        F.coalesce("has_target_script", F.lit(False)).alias("has_target_script"),
        F.when(blocks_n == 0, schema.NO_TEXT_BLOCKS)
        .when(drawable_n == 0, schema.NO_TRANSLATION_BLOCKS)
        .otherwise(schema.OK)
        .alias("status"),
    )


def exportable_pages(pages: DataFrame, blocks: DataFrame, artefacts: DataFrame, key: str = "page_key") -> DataFrame:
    """A page can be exported with a rendered artefact or any non-blank translation."""
    texts = blocks.groupBy(key).agg(F.bool_or(~is_blank("translated_text")).alias("_text"))
    drawn = artefacts.select(key).distinct().withColumn("_drawn", F.lit(True))
    joined = pages.select(key).join(texts, key, "left").join(drawn, key, "left")
    verdict = F.coalesce("_drawn", F.lit(False)) | F.coalesce("_text", F.lit(False))
    return joined.select(key, verdict.alias("exportable"))


def has_translation(blocks: Column) -> Column:
    """The same verdict on a nested block array."""
    return F.exists(blocks, lambda b: ~is_blank(b["translated_text"]))


def assemble_pages(
    blocks: DataFrame,
    fields: Sequence[str | Column],
    keys: Sequence[str] = ("page_key",),
    pos: str = "pos",
    segment: int | None = None,
    more: Sequence[Column] = (),
) -> DataFrame:
    """Blocks back into ordered arrays, one row per page: a page is one document.

    Every block starts with its ``pos``, so gaps stay. With ``segment`` a row holds that
    many positions at most and a page may have several. ``more`` are further aggregates.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).cast("int").alias("pos"), *fields)))
    if segment is None:
        # By the keys alone, so that rows dealt out by them are not dealt out again.
        whole = blocks.groupBy(*keys).agg(items.alias("blocks"), *more)
        return whole.withColumn("segment", F.lit(0)).select(*keys, "segment", *[c for c in whole.columns if c not in keys])
    number = F.floor(F.col(pos) / segment).cast("int")
    return blocks.withColumn("segment", number).groupBy(*keys, "segment").agg(items.alias("blocks"), *more)


def explode_pages(pages: DataFrame, keys: Sequence[str] = ("page_key",)) -> DataFrame:
    """Inverse of :func:`assemble_pages`, whatever its segments."""
    return pages.select(*keys, F.explode("blocks").alias("_block")).select(*keys, "_block.*")


def page_text(
    blocks: DataFrame,
    text: str = "original_text",
    sep: str = "\n",
    key: str = "page_key",
    pos: str = "pos",
    segment: int | None = None,
) -> DataFrame:
    """Texts of a page joined in order, one text per page.

    With ``segment`` that many positions are joined at a time, so that the blocks of a long
    page spread over tasks and only its text comes together.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    joined = F.array_join(F.transform(items, lambda i: i["t"]), sep)
    if segment is None:
        return blocks.groupBy(key).agg(joined.alias("page_text"))
    number = F.floor(F.col(pos) / segment)
    # A segment without any text adds no separator.
    parts = blocks.withColumn("_p", number).groupBy(key, "_p").agg(F.when(F.count(text) > 0, joined).alias("_t"))
    return page_text(parts.withColumnRenamed("_t", text), text, sep, key, "_p")


def rejoin(blocks: DataFrame, translations: DataFrame, keys: Sequence[str] = ("page_key", "pos")) -> DataFrame:
    """Block i of a page gets translation i."""
    return blocks.join(translations, list(keys), "inner")


def top_candidates(candidates: DataFrame, key: str, score: str, index: str, keep: Sequence[str]) -> DataFrame:
    """Best candidate per observation; the lower index wins a tie, no candidate no row."""
    best = F.max_by(F.struct(score, index, *keep), F.struct(F.col(score), -F.col(index)))
    grouped = candidates.where(F.col(score).isNotNull()).groupBy(key).agg(best.alias("_best"))
    return grouped.select(key, "_best.*")
