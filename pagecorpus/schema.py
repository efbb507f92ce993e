"""Record shapes and status values."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")])

BLOCK = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("box", BOX),
        T.StructField("original_text", T.StringType()),
        T.StructField("translated_text", T.StringType()),
        T.StructField("confidence", T.FloatType()),
        T.StructField("source_is_vertical", T.BooleanType()),
        T.StructField("detected_font_size", T.DoubleType()),
    ]
)

# Interchange form of one page, with the field names existing cache documents use.
PAGE_DOCUMENT = T.StructType(
    [
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("box", T.StructType([T.StructField(n, T.DoubleType()) for n in ("height", "width", "x", "y")])),
                        T.StructField("confidence", T.FloatType()),
                        T.StructField("detectedFontSize", T.DoubleType()),
                        T.StructField("id", T.StringType()),
                        T.StructField("originalText", T.StringType()),
                        T.StructField("position", T.IntegerType()),
                        T.StructField("sourceIsVertical", T.BooleanType()),
                        T.StructField("translatedText", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("createdAt", T.TimestampType()),
        T.StructField("imageFingerprint", T.StringType()),
        T.StructField("imageURL", T.StringType()),
        T.StructField("sourceLanguage", T.StringType()),
        T.StructField("targetLanguage", T.StringType()),
    ]
)

# Detection/OCR project documents: {"pages": {page name: [block, ...]}}.
PROJECT_DOCUMENT = T.StructType(
    [
        T.StructField(
            "pages",
            T.MapType(
                T.StringType(),
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("xyxy", T.ArrayType(T.DoubleType())),
                            T.StructField("text", T.ArrayType(T.StringType())),
                            T.StructField("translation", T.StringType()),
                            T.StructField("src_is_vertical", T.BooleanType()),
                            T.StructField("_detected_font_size", T.DoubleType()),
                        ]
                    )
                ),
            ),
        )
    ]
)

RULES = "rule_ord INT, needles ARRAY<STRING>, replacements ARRAY<STRUCT<pattern: STRING, value: STRING>>"

LANGUAGES = ("ja", "ko", "en")

# Row statuses that replace per-item failures.
OK = "ok"
EMPTY_TEXT = "empty_text"
MISSING_TRANSLATION = "missing_translation"
TRANSLATOR_ERROR = "translator_error"
PAGE_FAILED = "page_failed"
NO_TEXT_BLOCKS = "no_text_blocks"
NO_TRANSLATION_BLOCKS = "no_translation_blocks"
UNSUPPORTED = "unsupported"
NO_IMAGES = "no_images"
OVERSIZE = "oversize"
INVALID_DOCUMENT = "invalid_document"
INVALID_IMAGE = "invalid_image"
UNREADABLE_PAGE = "unreadable_page"
