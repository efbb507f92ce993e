"""Rows the tests of this folder share."""

import zlib

import pyarrow.parquet as pq

FOLDER = "/root/testdata/sf0.001"
#: A table with columns whose names the operators use themselves.
CLASHING = "doc_id bigint, text string, lang string, digest string, f bigint, row bigint, word string, _text string, score double, key string"


def documents(folder=FOLDER):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def crc(value):
    return zlib.crc32(str(value).encode())


def awkward(spark):
    """Nulls, empty and blank texts, one long text, ties, a repeated row, clashing names."""
    long = "the cat sat on the mat and then it ran off. " * 30_000
    rows = [
        (1, "the quick brown fox jumps over the lazy dog"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, "the quick brown fox jumps over the lazy dog"),
        (5, "the quick brown fox jumps over the lazy dog"),
        (None, "a text without identifier"),
        (7, long),
        (8, "😀 ünï 123"),
        (None, None),
    ]
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "w", "t", 0.5, "k") for i, t in rows], CLASHING)


def empty(spark):
    return spark.createDataFrame([], CLASHING)
