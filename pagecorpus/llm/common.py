"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import string
import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.session import broadcast_if_small, freeze, is_small

#: Characters that end a word, as the contracts of several operators fix them.
BLANKS = r"[\x20\x09-\x0D]+"

#: Where a row lies. The names should clash with none of a user's table.
FILE, ROW = "__llm_file", "__llm_row"
PLACE = [FILE, ROW]
#: Rows of a file by the block, one bit each: what Spark's bitmaps hold.
BLOCK, BITS, BLOCK_ROWS = "__llm_block", "__llm_bits", 32_768
#: Places that are sent to the tasks as they are.
FEW_PLACES = 100_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a whole table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def remainder(doc_id: str, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def is_remainder(doc_id: str, modulus: int, value: int) -> Column:
    """Whether a row belongs to a fold; a null identifier belongs to none."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def without(rows: DataFrame, gone: DataFrame, few: int = FEW_PLACES) -> DataFrame:
    """Located ``rows`` less those whose place is in ``gone``; only the places are shuffled.

    More than ``few`` places go to the tasks as bits, 4 KB for ``BLOCK_ROWS`` rows of a file: a
    file's path with every row would fill the driver.
    """
    gone = freeze(gone.select(*PLACE).distinct())
    if is_small(gone, few):
        return rows.join(F.broadcast(gone), PLACE, "left_anti").drop(*PLACE)
    block, at = F.floor(F.col(ROW) / BLOCK_ROWS).alias(BLOCK), F.col(ROW) % BLOCK_ROWS
    bits = gone.groupBy(FILE, block).agg(F.bitmap_construct_agg(at).alias(BITS))
    marked = rows.select("*", block).join(broadcast_if_small(freeze(bits)), [FILE, BLOCK], "left")
    byte = F.conv(F.hex(F.substring(F.col(BITS), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (at % 8).cast("int")) == 1
    return marked.where(~F.coalesce(set_, F.lit(False))).drop(*PLACE, BLOCK, BITS)


def crc32_of(values) -> int:
    """CRC-32 of an array's bytes."""
    return zlib.crc32(values.tobytes())


def give_back() -> None:
    """Hand the memory that a task has freed back to the system: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def bare(df: DataFrame) -> DataFrame:
    """``df`` if it only selects and filters columns of one file relation, else a frozen copy.

    Rows of such a relation have a place of their own that every read finds again. Rows made
    by an explode share the place of the row they come from, and those of a union have none.
    """
    node = df._jdf.queryExecution().analyzed()
    steady = node.deterministic()
    while steady and node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return df if steady and node.getClass().getSimpleName() == "LogicalRelation" else freeze(df)


def located(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """``columns`` of a :func:`bare` table with the columns ``PLACE``: where each row lies, the same in every read."""
    return df.select(*columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
