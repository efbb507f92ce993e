"""Page lists: natural order, page numbers, neighbours, folder siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import paths
from pagecorpus.functions.text import natural_key
from pagecorpus.operators.ordering import with_positions


def supported_pages(manifest: DataFrame, path: str = "path", recursive: bool = True) -> DataFrame:
    """Visible image files; a recursive scan also leaves resource-fork folders out."""
    keep = paths.is_image(path) & ~paths.is_hidden(path)
    if recursive:
        keep = keep & ~paths.in_resource_folder(path)
    return manifest.where(keep)


def natural_order(pages: DataFrame, path: str = "path") -> DataFrame:
    """Global natural order as a range-partitioned sort."""
    return pages.withColumn("_nat", natural_key(path)).orderBy("_nat", path).drop("_nat")


def natural_positions(pages: DataFrame, path: str = "path", tie: str | None = None) -> DataFrame:
    """``position`` of every page in the natural order of the whole list."""
    order = ["_nat", path] + ([tie] if tie else [])
    keyed = pages.withColumn("_nat", natural_key(path)).withColumn("_all", F.lit(0))
    return with_positions(keyed, ["_all"], order).drop("_nat", "_all", "group_size")


def page_numbers(
    pages: DataFrame, volume: str = "volume", path: str = "path", tie: str | None = None
) -> DataFrame:
    """Page number, label ``i / n`` and neighbours within each volume."""
    order = ["_nat", path] + ([tie] if tie else [])
    keyed = pages.withColumn("_nat", natural_key(path))
    numbered = with_positions(keyed, [volume], order, neighbours_of=path).drop("_nat")
    return (
        numbered.withColumnRenamed("position", "page_no")
        .withColumnRenamed("group_size", "page_count")
        .withColumnRenamed("prev", "prev_path")
        .withColumnRenamed("next", "next_path")
        .withColumn("page_label", F.concat_ws(" / ", "page_no", "page_count"))
    )


def volume_labels(volumes: DataFrame, pages: DataFrame, volume: str = "volume") -> DataFrame:
    """First label of every volume; ``0 / 0`` for volumes without pages."""
    counts = pages.groupBy(volume).agg(F.count(F.lit(1)).alias("page_count"))
    n = F.coalesce(F.col("page_count"), F.lit(0))
    label = F.when(n == 0, "0 / 0").otherwise(F.concat(F.lit("1 / "), n.cast("string")))
    return volumes.join(counts, volume, "left").select(volume, n.alias("page_count"), label.alias("page_label"))


def folder_siblings(manifest: DataFrame, selected: DataFrame, path: str = "path") -> DataFrame:
    """All supported pages that share a folder with a selected page, in natural order.

    Columns: folder, path, page_no, is_selected. A selected page in a folder without
    supported pages is returned alone.
    """
    chosen = selected.select(path).distinct().withColumn("folder", paths.parent(path))
    # Hidden means the name itself: the folder was chosen, so its own name does not count.
    visible = paths.is_image(path) & ~F.rlike(F.regexp_extract(F.col(path), r"([^/]*)$", 1), F.lit(r"^\."))
    pages = manifest.where(visible).select(path).distinct().withColumn("folder", paths.parent(path))
    siblings = pages.join(chosen.select("folder").distinct(), "folder", "left_semi")
    alone = chosen.join(siblings.select("folder").distinct(), "folder", "left_anti").select("folder", path)
    listed = siblings.select("folder", path).unionByName(alone)
    marked = listed.join(chosen.select(path, F.lit(True).alias("_chosen")), path, "left")
    keyed = marked.withColumn("_nat", natural_key(path))
    numbered = with_positions(keyed, ["folder"], ["_nat", path])
    return numbered.select(
        "folder",
        path,
        F.col("position").alias("page_no"),
        F.coalesce("_chosen", F.lit(False)).alias("is_selected"),
    )


def selected_index(siblings: DataFrame, selected: DataFrame, path: str = "path") -> DataFrame:
    """0-based index of each selected page among its siblings, 0 when it is not listed."""
    found = siblings.where("is_selected").select(path, (F.col("page_no") - 1).alias("page_index"))
    return (
        selected.select(path)
        .distinct()
        .join(found, path, "left")
        .select(path, F.coalesce("page_index", F.lit(0)).cast("bigint").alias("page_index"))
    )
