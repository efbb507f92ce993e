"""Queries over documents with empty, blank and padded lines, against their SQL twins."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module

SOURCE = "/root/testdata/sf0.001"
NAMES = "memo_translate page_translation_records page_results auto_mode stream_progress page_translation"
ODD = """SELECT doc_id, CASE doc_id % 20 WHEN 1 THEN '' WHEN 3 THEN ' ' WHEN 6 THEN replace(text, chr(10), chr(10) || chr(10))
 WHEN 11 THEN replace(text, chr(10), ' ' || chr(10)) WHEN 14 THEN replace(text, chr(10), chr(10) || ' Is ') ELSE text END AS text,
 lang, source, n_chars FROM read_parquet('{source}/documents.parquet') WHERE doc_id < 60"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    duck = duckdb.connect()
    duck.execute(f"COPY ({ODD.format(source=SOURCE)}) TO '{made}/documents.parquet'")
    duck.execute(f"COPY (SELECT * FROM read_parquet('{SOURCE}/labels.parquet') WHERE doc_id % 20 <> 1) TO '{made}/labels.parquet'")
    return str(made)


def rows_of(spark, folder, name):
    """The rows of a query and those of its SQL."""
    duck = duckdb.connect()
    for table in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    result = entry_module.queries()[name](spark, folder)
    columns = result.columns
    cursor = duck.execute(entry_module.oracle_sql()[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    return Counter(map(tuple, result.collect())), Counter(tuple(row[i] for i in order) for row in cursor.fetchall())


@pytest.mark.parametrize("name", NAMES.split())
def test_lines_are_looked_up_as_they_stand(spark, folder, name):
    got, expected = rows_of(spark, folder, name)
    assert got == expected


def test_empty_texts_arrive_as_files(spark, folder):
    got, expected = rows_of(spark, folder, "arriving_files")
    assert got == expected
