"""The translations table and its JSON interchange form.

The table is a folder of committed versions (:mod:`pagecorpus.sources.versions`); a later
version of a cache key replaces earlier ones, a deletion is a version too. Writing a version
again replaces that version only, in one step, so a repeated batch changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus import schema
from pagecorpus.sources import versions

RECORD = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("source_language", T.StringType()),
        T.StructField("target_language", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("blocks", T.ArrayType(schema.BLOCK)),
    ]
)

STORED = T.StructType([*RECORD.fields, T.StructField("deleted", T.BooleanType())])
KEY = "cache_key"

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ssXXX"


def write_version(records: DataFrame, root: str, version: int, prefix_length: int = 1) -> None:
    """Add or replace records by cache key; ``records`` have the columns of ``RECORD``."""
    rows = records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])
    versions.write(rows.withColumn("deleted", F.lit(False)), root, version, KEY, prefix_length)


def write_deletions(keys: DataFrame, root: str, version: int, prefix_length: int = 1) -> None:
    """Delete by ``cache_key``; keys that are not stored do nothing."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields[1:]]
    rows = keys.select(KEY, *empty).distinct().withColumn("deleted", F.lit(True))
    versions.write(rows, root, version, KEY, prefix_length)


def read_current(spark: SparkSession, root: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The records in force: for each cache key those of its last committed version, unless deleted.

    ``before`` ignores that version and later ones. With ``keys(cache_key)`` only these are
    looked up; a list of up to ``versions.MAX_KEYS`` reaches the files' Bloom filters.
    """
    log = versions.read(spark, root, STORED, before, keys, KEY)
    current = versions.in_force(log, KEY)
    return current.where(~F.col("deleted")).select(*RECORD.fieldNames())


def current_keys(spark: SparkSession, root: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The cache keys in force, read without any other column of the records."""
    log = versions.read(spark, root, STORED, before, keys, KEY)
    gone = log.groupBy(KEY).agg(F.max_by("deleted", "version").alias("deleted"))
    return gone.where(~F.col("deleted")).select(KEY)


def merge_versions(spark: SparkSession, root: str, before: int | None = None) -> int:
    """Merge versions of about equal size, so that look-ups open few files; how often."""
    return versions.merge(spark, root, STORED, KEY, before, "deleted")


def initialise(spark: SparkSession, root: str) -> None:
    """Commit an empty first version. A table without any version reads as empty too."""
    write_version(spark.createDataFrame([], RECORD), root, 0, 0)


def compact(spark: SparkSession, source: str, target: str, version: int = 0) -> None:
    """Write the records in force as the first version of a fresh folder."""
    write_version(read_current(spark, source), target, version)


def _document() -> Column:
    def block(b: Column) -> Column:
        box = F.struct(*[b["box"][n].alias(n) for n in ("height", "width", "x", "y")])
        return F.struct(
            box.alias("box"),
            b["confidence"].alias("confidence"),
            b["detected_font_size"].alias("detectedFontSize"),
            b["id"].alias("id"),
            b["original_text"].alias("originalText"),
            b["pos"].alias("position"),
            b["source_is_vertical"].alias("sourceIsVertical"),
            b["translated_text"].alias("translatedText"),
        )

    return F.struct(
        F.transform("blocks", block).alias("blocks"),
        F.col("created_at").alias("createdAt"),
        F.col("cache_key").alias("imageFingerprint"),
        F.col("image_url").alias("imageURL"),
        F.col("source_language").alias("sourceLanguage"),
        F.col("target_language").alias("targetLanguage"),
    )


def to_documents(records: DataFrame) -> DataFrame:
    """``cache_key, file_name, json``, one document per page: indented, keys sorted, ISO-8601 times.

    The segments of a page become one document again.
    """
    rest = [f for f in RECORD.fieldNames() if f not in ("cache_key", "segment", "blocks")]
    parts = F.array_sort(F.collect_list(F.struct("segment", "blocks")))
    whole = records.groupBy("cache_key").agg(
        F.min_by(F.struct(*rest), "segment").alias("_r"), F.flatten(F.transform(parts, lambda p: p["blocks"])).alias("blocks")
    )
    body = F.to_json(_document(), {"pretty": "true", "timestampFormat": ISO_SECONDS})
    name = F.concat(F.col("cache_key"), F.lit(".json"))
    return whole.select("cache_key", "_r.*", "blocks").select("cache_key", name.alias("file_name"), body.alias("json"))


def _parsed(documents: DataFrame, text: str) -> DataFrame:
    """Add ``_d`` and ``status``: what the format requires is there, or ``invalid_document``."""
    options = {"timestampFormat": ISO_SECONDS}
    d = documents.withColumn("_d", F.from_json(F.col(text), schema.PAGE_DOCUMENT, options))

    def incomplete(b: Column) -> Column:
        needed = [b["id"], b["originalText"], b["translatedText"], b["confidence"]]
        needed += [b["box"][n] for n in ("x", "y", "width", "height")]
        return b.isNull() | reduce(Column.__or__, [c.isNull() for c in needed])

    fields = [f.name for f in schema.PAGE_DOCUMENT.fields]
    present = reduce(Column.__and__, [F.col(f"_d.{f}").isNotNull() for f in fields])
    valid = F.coalesce(present & ~F.exists("_d.blocks", incomplete), F.lit(False))
    return d.withColumn("status", F.when(valid, schema.OK).otherwise(schema.INVALID_DOCUMENT))


def quarantined_documents(documents: DataFrame, text: str = "json") -> DataFrame:
    """Interchange documents that can't be used, with their status."""
    return _parsed(documents, text).where(F.col("status") != schema.OK).drop("_d")


def from_documents(documents: DataFrame, text: str = "json") -> DataFrame:
    """Records out of valid interchange documents (a text column, one document per row).

    A block without a stored position has its place in the list.
    """
    d = _parsed(documents, text).where(F.col("status") == schema.OK)

    def block(b: Column, i: Column) -> Column:
        box = F.struct(*[b["box"][n].alias(n) for n in ("x", "y", "width", "height")])
        return F.struct(
            F.coalesce(b["position"], i).alias("pos"),
            b["id"].alias("id"),
            box.alias("box"),
            b["originalText"].alias("original_text"),
            b["translatedText"].alias("translated_text"),
            b["confidence"].alias("confidence"),
            b["sourceIsVertical"].alias("source_is_vertical"),
            b["detectedFontSize"].alias("detected_font_size"),
        )

    return d.select(
        F.col("_d.imageFingerprint").alias("cache_key"),
        F.lit(0).alias("segment"),
        F.col("_d.imageURL").alias("image_url"),
        F.col("_d.sourceLanguage").alias("source_language"),
        F.col("_d.targetLanguage").alias("target_language"),
        F.col("_d.createdAt").alias("created_at"),
        F.transform("_d.blocks", block).alias("blocks"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records out of a folder of interchange files, one document per file."""
    return from_documents(spark.read.text(path, wholetext=True), "value")
