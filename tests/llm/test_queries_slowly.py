"""The queries of operators 2 and 5 against plain loops over the same tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from data import FOLDER, crc, documents

from pagecorpus.llm import language, toxicity
from pagecorpus.llm.common import is_remainder
from pagecorpus.llm.queries import op2_language, op5_toxicity


def slow_grams(text):
    line = " " + "".join(c if c.isalpha() else " " for c in text) + " "
    folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return [folded[i : i + n] for n in (2, 3, 4) for i in range(len(folded) - n + 1)]


def test_language_query_against_plain_sets(spark):
    """N-gram sets of whole languages in place of the filters; only near ties may differ."""
    rows = documents()
    counts, texts = defaultdict(Counter), defaultdict(set)
    for r in rows:
        if crc(r["doc_id"]) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            texts[r["lang"]].add(r["text"])
    for lang, own in texts.items():
        for t in own:
            for g in slow_grams(t):
                counts[lang, len(g)][g] += 1
    share = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    sets = defaultdict(set)
    for (lang, n), own in share.items():
        for g, s in own.items():
            best = max(share[other, n].get(g, 0) for other in texts)
            if s >= language.LEAST_SHARE[n] and s >= language.AGAINST_BEST * best:
                sets[lang].add(g)
    got = {r.doc_id: r for r in op2_language(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    settled = 0
    for r in rows:
        found = got[r["doc_id"]]
        assert found.held_out == (crc(r["doc_id"]) % 4 == 2) and 0 <= found.score <= 1
        if not any(map(str.isalpha, r["text"] or "")):
            assert found.lang_pred == "und"
            continue
        own = Counter({lang: sum(g in s for g in slow_grams(r["text"])) for lang, s in sets.items()})
        (first, most), (_, second) = own.most_common(2)
        if most > 1.05 * second + 3:
            settled += 1
            assert found.lang_pred == first
            assert found.score == pytest.approx(most / sum(own.values()), abs=0.05)
    assert settled > 0.95 * len(rows)


def slow_score(text, net):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    vectors = [sum(net.embeddings[b].astype(float) for b in toxicity.pieces(w)) for w in words]
    z, column = float(net.out[-1]), 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -math.inf
            for at in range(len(words) - width + 1):
                response = sum(float(vectors[at + j] @ net.kernel[:, column + j * toxicity.FILTERS + f]) for j in range(width))
                best = max(best, response)
            unit = k * toxicity.FILTERS + f
            z += max(0.0, best + float(net.bias[unit])) * float(net.out[unit])
        column += width * toxicity.FILTERS
    return 1 / (1 + math.exp(-min(60, max(-60, z - net.shift + math.log(toxicity.CUT / (1 - toxicity.CUT))))))


def test_toxicity_query_against_loops(spark):
    """Every score from the learned weights by loops over words, filters and places."""
    rows = documents()
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist() if crc(r["doc_id"]) % 4 != 2}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").where(~is_remainder("doc_id", 4, 2))
    labelled = toxicity.with_labels(docs, labels)
    assert {r.doc_id for r in labelled.collect()} <= set(toxic)
    net = toxicity.learn(labelled)
    got = {r.doc_id: r for r in op5_toxicity(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r["text"] or "") < 4000]
    for r in short:
        found = got[r["doc_id"]]
        assert found.score == pytest.approx(slow_score(r["text"], net), abs=1e-3)
    for r in rows:
        found = got[r["doc_id"]]
        assert found.held_out == (crc(r["doc_id"]) % 4 == 2)
        assert found.predicted == int(found.score >= 0.3)
    assert len(short) > 100 and np.std([got[r["doc_id"]].score for r in short]) > 0
