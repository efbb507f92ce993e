"""Every registered query against its SQL twin, and checks of the plans."""

import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from pagecorpus import session
from pagecorpus.operators import translate
from pagecorpus.plans import catalogue, page_translation, queries_translation, queries_text
from pagecorpus.plans.views import Views

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def canonical(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else repr(value)


def catalogue_names():
    """Queries of the library proper; those of the training-data package have tests of their own."""
    own = "pagecorpus.plans."
    return sorted(n for n in entry_module.queries() if catalogue.MODULES.get(n, "").startswith(own))


PYTHON = {"expand_archives", "enrich_texts", "arriving_files", "image_sizes", "journalled_answers"}


UNWANTED = ("MapInPandas", "PythonUDF", "ArrowEval", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture
def frozen_plans(monkeypatch):
    """The plans of all tables written on the way, whichever module writes them."""
    plans = []

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return session.freeze(df)

    for name, module in list(sys.modules.items()):
        if name.startswith("pagecorpus.") and getattr(module, "freeze", None) is session.freeze and module is not session:
            monkeypatch.setattr(module, "freeze", recorded)
    return plans


@pytest.mark.parametrize("name", catalogue_names())
def test_query_matches_sql_and_stays_in_the_engine(spark, duck, frozen_plans, name):
    result = entry_module.queries()[name](spark, FOLDER)
    if name not in PYTHON:
        last = result._jdf.queryExecution().executedPlan().toString()
        assert not [u for plan in [*frozen_plans, last] for u in UNWANTED if u in plan]
    columns = sorted(result.columns)
    got = sorted(tuple(canonical(row[c]) for c in columns) for row in result.collect())
    cursor = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(canonical(row[i]) for i in order) for row in cursor.fetchall())
    assert got == expected


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_page_job_scans_of_texts(spark, frozen_plans):
    """For the hashes, for the page keys of the blocks (here made of the texts), and for the chosen blocks.

    The memo's own table is not the job's.
    """
    views = Views(spark, FOLDER)
    memo = session.freeze(queries_translation.memory(views))
    pages = page_translation.freeze(views.doc_pages)
    nothing = spark.createDataFrame([], "cache_key string")
    result = page_translation.translate_pages(
        pages,
        views.doc_blocks,
        nothing,
        queries_text.sample_rules(views),
        lambda texts: translate.from_memory(texts, memo),
        queries_translation.JOB,
    )
    page_translation.page_report(result)
    scans = sum(len(re.findall(r"FileScan parquet [^\n]*documents.parquet[^\n]*text:string", plan)) for plan in frozen_plans)
    assert scans == 3
