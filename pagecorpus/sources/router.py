"""What is opened when a path is given: a folder, a page with its folder, an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.functions import paths
from pagecorpus.functions.text import natural_key
from pagecorpus.operators.ordering import with_positions
from pagecorpus.operators.paging import supported_pages
from pagecorpus.session import freeze
from pagecorpus.sources.scan import route_inputs


def open_inputs(
    inputs: DataFrame, manifest: DataFrame, entries: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(opened, pages, problems)`` for ``inputs(path, is_folder)``.

    A folder opens its own pages, an image the pages of its folder, an archive the pages
    among ``entries(archive, entry)``. pages: folder, path, page_no, once per folder or
    archive however many inputs open it. opened: input, input_kind, folder, page_index (the
    image's place, else 0). problems: input, status ``unsupported`` or ``no_images``.
    ``manifest(path)`` lists known files.
    """
    routed = freeze(
        route_inputs(inputs, is_folder="is_folder").select(F.col("path").alias("input"), "input_kind", "status").distinct()
    )
    folder = F.when(F.col("input_kind") == "image", paths.parent("input")).otherwise(F.col("input"))
    opened = routed.where(F.col("status") == schema.OK).select("input", "input_kind", folder.alias("folder"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    visible = manifest.where(paths.is_image("path") & ~F.startswith(name, F.lit(".")))
    files = visible.select("path", paths.parent("path").alias("folder")).distinct()
    wanted = opened.where(F.col("input_kind").isin("folder", "image")).select("folder").distinct()
    listed = files.join(wanted, "folder", "left_semi").select("folder", "path")
    if entries is not None:
        inside = supported_pages(entries.withColumnRenamed("entry", "path")).select(F.col("archive").alias("folder"), "path")
        archives = opened.where(F.col("input_kind") == "archive").select("folder")
        listed = listed.unionByName(inside.join(archives.distinct(), "folder", "left_semi").select("folder", "path"))
    found = freeze(listed.select("folder").distinct())
    alone = opened.where(F.col("input_kind") == "image").join(found, "folder", "left_anti")
    listed = listed.unionByName(alone.select("folder", F.col("input").alias("path")))
    keyed = listed.withColumn("_nat", natural_key("path"))
    pages = with_positions(keyed, ["folder"], ["_nat", "path"]).select("folder", "path", F.col("position").alias("page_no"))
    pages = freeze(pages)
    empty = opened.where(F.col("input_kind") != "image").join(found, "folder", "left_anti")
    places = pages.select("folder", F.col("path").alias("input"), (F.col("page_no") - 1).alias("page_index"))
    usable = opened.join(empty.select("input"), "input", "left_anti").join(places, ["folder", "input"], "left")
    usable = usable.select("input", "input_kind", "folder", F.coalesce("page_index", F.lit(0)).cast("bigint").alias("page_index"))
    problems = (
        routed.where(F.col("status") != schema.OK)
        .select("input", "status")
        .unionByName(empty.select("input", F.lit(schema.NO_IMAGES).alias("status")))
    )
    return usable, pages, problems
