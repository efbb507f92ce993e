"""Language identification: filters, false-positive correction, held-out accuracy."""

import numpy as np
from data import FOLDER, awkward, crc, documents, empty
from pyspark.sql import functions as F

from pagecorpus.llm import language
from pagecorpus.llm.common import is_remainder


def test_folded_line_and_grams():
    assert "".join(map(chr, language._line("  Ab1 ÇD\n--é"))) == " ab çd é "
    line = language._line("Hello, big World")
    text = "".join(map(chr, line))
    for n in language.SIZES:
        grams = [text[i : i + n] for i in range(len(text) - n + 1)]
        hashes = np.concatenate(list(language.gram_hashes(line, n))).tolist()
        assert len(hashes) == len(grams)
        assert len(set(zip(grams, hashes))) == len(set(grams)) == len(set(hashes))


def test_blocks_change_nothing(monkeypatch):
    line = language._line("the quick brown fox " * 50)
    whole = {n: np.concatenate(list(language.gram_hashes(line, n))).tolist() for n in language.SIZES}
    monkeypatch.setattr(language, "BLOCK", 17)
    assert whole == {n: np.concatenate(list(language.gram_hashes(line, n))).tolist() for n in language.SIZES}


def test_filters_hold_all_their_grams_and_few_others():
    rng = np.random.default_rng(0)
    own = rng.integers(0, 2**63, (2, 3000)).astype(np.uint64)
    slots = np.zeros(1 << 16, dtype=np.uint64)
    for bit in range(2):
        for at in language._slots_of(own[bit], len(slots)):
            np.bitwise_or.at(slots, at, np.uint64(1 << bit))

    def held(hashes, bit):
        out = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in language._slots_of(hashes, len(slots)):
            out &= slots[at]
        return (out >> np.uint64(bit)) & np.uint64(1)

    other = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    for bit in range(2):
        assert held(own[bit], bit).all()
        filled = float(((slots >> np.uint64(bit)) & np.uint64(1)).mean()) ** language.HASHES
        assert abs(held(other, bit).mean() - filled) < 0.002


def test_false_positives_are_taken_off():
    everything = np.full(1 << 10, np.uint64(0b11))
    filters = language.Filters(["a", "b"], everything, np.array([0.5, 0.0]))
    counts, total = language.scores("some words here", filters)
    assert counts[1] == total and abs(counts[0] - total) < 1e-9
    half = language.Filters(["a", "b"], everything, np.array([0.999, 0.0]))
    assert language.predict("some words here", half)[0] in ("a", "b")
    none = language.Filters(["a", "b"], np.zeros(1 << 10, dtype=np.uint64), np.zeros(2))
    assert language.predict("some words here", none) == ("a", 0.0, 0.0)


def test_query_on_held_out_documents(spark):
    from pagecorpus.llm.queries import op2_language

    rows = {r["doc_id"]: r for r in documents("/root/testdata/sf0.01")}
    found = op2_language(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(rows)
    known = {r["lang"] for r in rows.values()}
    right = 0
    held = [r for r in found if r.held_out]
    for r in found:
        assert r.held_out == (crc(r.doc_id) % 4 == 2)
        assert r.lang_pred in known and 0 <= r.score <= 1
    right = sum(r.lang_pred == rows[r.doc_id]["lang"] for r in held)
    assert right / len(held) >= 0.98


def test_awkward_rows(spark):
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    filters = language.learn(base)
    named = awkward(spark).select("doc_id", language.identify(spark, filters, F.col("text")).alias("r")).collect()
    und = [r for r in named if r.r.lang == language.UNDETERMINED]
    assert len(named) == 10 and len(und) == 4 and all(r.r.score == 0 for r in und)
    for docs in (awkward(spark).where("false"), empty(spark)):
        assert language.language_of(docs, F.lit(True)).count() == 0
    unlabelled = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_of(unlabelled, F.lit(True)).collect()} == {language.UNDETERMINED}
    held = awkward(spark).select(is_remainder("doc_id", 4, 2).alias("h"))
    assert held.where("h is null").count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(500).select(F.concat(F.lit("words number "), "id").alias("text"), F.lit("x").alias("lang"))
    assert language._sample(docs, "text", "lang", 40).count() == 40
    assert language._sample(docs.limit(10), "text", "lang", 40).count() == 10
