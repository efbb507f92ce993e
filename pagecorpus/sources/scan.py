"""Page scans, input routing, image sizes and artefact presence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.functions import geometry as g
from pagecorpus.functions import paths
from pagecorpus.functions.keys import fingerprint
from pagecorpus.functions.text import _col
from pagecorpus.operators.paging import natural_positions, supported_pages
from pagecorpus.operators.regions import Sampler
from pagecorpus.sources.remote import hash_in_place, walk


def file_manifest(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, rel_path, length, modified`` of the files below ``root``; contents are not read.

    Names that start with ``_`` or ``.`` are listed too, which Spark's own listing leaves out.
    """
    bare = F.regexp_replace("path", "^file:/+", "/")
    below = paths.relative_to(bare, root.removeprefix("file:"))
    return walk(spark, root, recursive).select("path", below.alias("rel_path"), "length", "modified")


def scan_pages(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Supported pages of a folder with their ``position`` in natural order."""
    pages = supported_pages(file_manifest(spark, root, recursive), "rel_path", recursive)
    return natural_positions(pages, "rel_path")


def fingerprinted(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Supported pages with the SHA-256 of their bytes.

    Pages below names that start with ``_``, which Spark's reader passes over, are hashed
    as streams.
    """
    pages = supported_pages(file_manifest(spark, root, recursive), "rel_path", recursive).select("path", "rel_path", "length")
    passed_over = F.rlike("rel_path", F.lit("(^|/)_"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    read = files.where(paths.is_image("path")).select("path", fingerprint("content").alias("sha"))
    plain = pages.where(~passed_over).join(read, "path").select("path", "length", "sha")
    streamed = pages.where(passed_over).select("path", "length").mapInPandas(hash_in_place, "path string, length bigint, sha string")
    return plain.unionByName(streamed)


def route_inputs(inputs: DataFrame, path: str = "path", is_folder: str | None = None) -> DataFrame:
    """Add ``input_kind`` and ``status``; what cannot be opened has status ``unsupported``."""
    kind = paths.input_kind(path, F.col(is_folder) if is_folder else None)
    return inputs.withColumn("input_kind", kind).withColumn(
        "status", F.when(F.col("input_kind") == "unsupported", schema.UNSUPPORTED).otherwise(schema.OK)
    )


def read_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Decoded images: ``path, width, height, channels, data`` and a status.

    Formats the decoder does not know get status ``invalid_image`` and no size.
    """
    images = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).load(root)
    usable = (F.col("image.width") > 0) & (F.col("image.height") > 0)
    return images.select(
        F.col("image.origin").alias("path"),
        F.when(usable, F.col("image.width")).alias("width"),
        F.when(usable, F.col("image.height")).alias("height"),
        F.when(usable, F.col("image.nChannels")).alias("channels"),
        F.when(usable, F.col("image.data")).alias("data"),
        F.when(usable, schema.OK).otherwise(schema.INVALID_IMAGE).alias("status"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pixel_is_light(data: Column, channels: Column, index: Column) -> Column:
    """Lightness of pixel ``index`` of interleaved grey, BGR or BGRA bytes."""

    def level(value: Column, shift: int) -> Column:
        return F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("double") / F.lit(255.0)

    def colour(value: Column) -> Column:
        rest = F.when(channels == 4, F.shiftright(value, 8)).otherwise(value)
        grey = channels < 3
        return F.struct(
            F.when(grey, level(value, 0)).otherwise(level(rest, 16)).alias("b"),
            F.when(grey, level(value, 0)).otherwise(level(rest, 8)).alias("g"),
            level(rest, 0).alias("r"),
            F.when(channels == 4, level(value, 0)).otherwise(1.0).alias("a"),
        )

    pixel = F.substring(data, index * channels + 1, channels)
    number = F.conv(F.hex(pixel), 16, 10).cast("bigint")
    return _let(_let(number, colour), lambda c: g.is_light(c["r"], c["g"], c["b"], c["a"]))


def image_sampler(images: DataFrame) -> Sampler:
    """Sample ``images(page_key, width, height, channels, data)``; rectangles carry img_w, img_h."""
    return lambda rects, rect, step: sample_images(rects, images, rect, step)


def sample_images(rects: DataFrame, images: DataFrame, rect: str, step: str) -> DataFrame:
    """Light flags of a sampling grid straight from image bytes.

    The rectangles of a page go to the row that holds its bytes, which are read there and
    go no further; there is one such row per page however many rectangles it has.
    """
    own = [c for c in rects.columns if c != "page_key"]
    gathered = rects.groupBy("page_key").agg(F.collect_list(F.struct(*own)).alias("_rects"))
    joined = images.select("page_key", "width", "height", "channels", "data").join(gathered, "page_key")

    def sampled(o: Column) -> Column:
        r, s = o[rect], o[step]
        rows, cols = g.grid_extent(r, s)

        def line(row: Column) -> Column:
            py = g.sample_y(r, s, row)
            start = g.pixel_index(o["img_h"] - py, o["img_h"], F.col("height")) * F.col("width")
            return F.struct(row.alias("row"), py.alias("py"), start.alias("start"))

        def across(col: Column) -> Column:
            px = g.sample_x(r, s, col)
            return F.struct(col.alias("col"), px.alias("px"), g.pixel_index(px, o["img_w"], F.col("width")).alias("at"))

        def point(ln: Column, ac: Column) -> Column:
            light = pixel_is_light(F.col("data"), F.col("channels"), ln["start"] + ac["at"])
            fields = [ln["row"].alias("row"), ac["col"].alias("col"), ac["px"].alias("px"), ln["py"].alias("py")]
            return F.struct(o.alias("_o"), *fields, light.alias("light"))

        axes = F.struct(
            F.transform(F.sequence(F.lit(0), rows - 1), line).alias("lines"),
            F.transform(F.sequence(F.lit(0), cols - 1), across).alias("columns"),
        )
        return _let(axes, lambda a: F.flatten(F.transform(a["lines"], lambda ln: F.transform(a["columns"], lambda ac: point(ln, ac)))))

    # A grid has at least one point. The outer form keeps the planner from testing that,
    # for which it would work the grids out again.
    points = joined.select("page_key", F.inline_outer(F.flatten(F.transform("_rects", sampled))))
    return points.select("page_key", "_o.*", "row", "col", "px", "py", "light").select(
        *rects.columns, "row", "col", "px", "py", "light"
    )


# The default names below.
@dataclass(frozen=True)
class ArtefactNames:
    """Where a run leaves its files, below ``root/<cache key>/``; ``{run}`` is the key."""

    rendered: str = "result/001.png"
    inpainted: str = "inpainted/001.png"
    project: str = "imgtrans_{run}.json"
    source_text: str = "imgtrans_{run}_source.txt"
    translation_text: str = "imgtrans_{run}_translation.txt"
    required: tuple[str, ...] = ("rendered", "inpainted", "project")
    optional: tuple[str, ...] = ("source_text", "translation_text")

    def path(self, kind: str, key: Column | str, root: str = "runs") -> Column:
        before, _, after = getattr(self, kind).partition("{run}")
        run = _col(key)
        inner = [F.lit(before), run, F.lit(after)] if "{run}" in getattr(self, kind) else [F.lit(before)]
        return F.concat(F.lit(root + "/"), run, F.lit("/"), *inner)


def artefact_paths(
    runs: DataFrame, files: DataFrame, names: ArtefactNames = ArtefactNames(), root: str = "runs", key: str = "cache_key"
) -> DataFrame:
    """One row per run: each artefact's path, or null where it is absent.

    status: ok, or ``missing_<kind>`` for the first required artefact that is absent.
    """
    kinds = [*names.required, *names.optional]
    expected = runs.select(
        key,
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), names.path(k, key, root).alias("path")) for k in kinds])
        ).alias("_a"),
    ).select(key, "_a.kind", "_a.path")
    present = expected.join(files.select("path").distinct(), "path", "left_semi")
    columns = present.groupBy(key).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds]
    )
    joined = runs.select(key).distinct().join(columns, key, "left")
    status = F.when(F.lit(False), "")
    for kind in names.required:
        status = status.when(F.col(kind).isNull(), f"missing_{kind}")
    return joined.select(key, *kinds, status.otherwise(schema.OK).alias("status"))
