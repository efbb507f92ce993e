"""The pipeline's stages, each against what it should keep."""

import re
from collections import Counter

import pytest
from data import FOLDER, awkward
from test_near_copies import slow_kept

import __spark_entry__
import corpus_pipeline
from pagecorpus.llm import decontaminate


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage over a small corpus with planted cases."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet")
    planted = [(9001, "123 456 !!", "en", "p", 10), (9002, None, "en", "p", 0), (9003, "зачем вам это нужно сегодня и завтра", "en", "p", 36)]
    docs = base.unionByName(spark.createDataFrame(planted, base.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp("stages") / name)
        out[-1].write.parquet(folder)
        out[-1] = spark.read.parquet(folder)
        out.append(stage(spark, out[-1], FOLDER))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_language_stage_keeps_clean_documents(stages):
    gone = {r[0] for r in rows(stages[0])} - {r[0] for r in rows(stages[1])}
    assert gone == {9001, 9002, 9003}


def test_exact_stage(stages):
    last = {}
    for r in rows(stages[1]):
        last[r[1]] = max(r, last.get(r[1], r))
    assert rows(stages[2]) == sorted(last.values(), key=str)


def test_near_stage(stages):
    assert {r[0] for r in rows(stages[3])} == slow_kept([(r[0], r[1]) for r in rows(stages[2])])


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    before, after = {r[0]: r[1] for r in rows(stages[3])}, {r[0] for r in rows(stages[4])}
    holding = {i for i, t in before.items() if any(plain(x) in plain(t) for x in items)}
    assert holding and not holding & after
    assert {r.doc_id for r in decontaminate.leaked_items(stages[3], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()} == set(before) - after


def test_packing_stage(stages):
    whole = Counter()
    for r in stages[5].collect():
        whole[r.doc_id] += r.length
    assert set(whole) == {r[0] for r in rows(stages[4])}


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == awkward(spark).columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r.doc_id for r in docs.collect()} <= {1, 5, None, 7, 8}


def test_every_operator_has_its_query():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
