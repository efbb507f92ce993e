"""Licence texts by a positional rare-token index, with DataFrame functions only.

Every template is indexed under its rarest words by the corpus' own document frequencies.
A file's occurrences of those words are looked up, each posting gives the place where the
template would begin, and the postings of a template's words are intersected: only a place
that all of them give is verified. All mandatory key phrases must stand there, and the
weighted share of the template's words that agree is the score. All occurrences are looked
up and only mandatory words are indexed, so no place is lost; each row is worked out on its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm.common import lower_ascii

# Fixed value: what a word is, for texts in which A-Z has not been lowered yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice, and the phrases in it that have to stand exactly."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> list[int]:
        """Positions of the words of the key phrases; all of them for a plain phrase."""
        if not self.phrases:
            return list(range(len(self.words)))
        found: set[int] = set()
        for phrase in self.phrases:
            parts = phrase.split()
            starts = [i for i in range(len(self.words)) if self.words[i : i + len(parts)] == parts]
            found.update(i + k for i in starts[:1] for k in range(len(parts)))
        return sorted(found)


# The base phrases.
BASE = (
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("gpl", "general public license"),
)
#: Opening words of well-known licences, and short names of others.
FURTHER = (
    Template("agpl", "affero general public license"),
    Template("lgpl", "lesser general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("isc", "isc license"),
    Template("bsd", "bsd license"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-nc", "cc by nc 4 0"),
    Template("cc-by-sa", "cc by sa 4 0"),
    Template("cc-by", "creative commons attribution"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        ("hereby granted free of charge", "obtaining a copy"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        ("permission to use copy modify", "without fee"),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license",
        ("not use this file except in compliance",),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
)

#: Words of a template that are indexed, at most; rarer ones first.
INDEXED = 2
#: Least weighted share of agreeing words, the key phrases included.
LEAST_SCORE = 0.6


def document_frequencies(docs: DataFrame, text: str, vocabulary: Sequence[str]) -> tuple[dict[str, int], int]:
    """In how many of all rows each word of a small vocabulary occurs, and the number of rows."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lower_ascii)
    own = F.array(*[F.lit(w) for w in vocabulary])
    hits = docs.select(F.explode(F.concat(F.array_intersect(words, own), F.array(F.lit("")))).alias("w"))
    # One row per word of the vocabulary; the empty word counts the rows.
    counts = {r.w: r.n for r in hits.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts, counts.get("", 0)


def _array(values: Sequence, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def licence_notices(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    base: Sequence[Template] = BASE,
    further: Sequence[Template] = FURTHER,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, places, base_places, score)``.

    ``places`` is an array of (start, label, score, base), starts counted in words from 0,
    one for each place where a template stands; ``base_places`` are those of the base
    phrases. ``score`` is the best of a row, 0 without any. A null text counts as empty.
    Identifiers may be null or repeat; other columns are not looked at; an empty table
    gives no rows.
    """
    templates = [*base, *further]
    vocabulary = sorted({w for t in templates for w in t.words})
    counts, rows = document_frequencies(docs, text, vocabulary)
    weight = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1e-3 for w in vocabulary}

    # By rank: the rarest mandatory words of every template, the next ones, ... Only mandatory
    # words may be indexed: a place that is kept has all of them. A shorter template repeats its last.
    postings: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(INDEXED)]
    for number, t in enumerate(templates):
        rarest = sorted(t.mandatory, key=lambda i: (-weight[t.words[i]], i))
        for rank, entries in enumerate(postings):
            i = rarest[min(rank, len(rarest) - 1)]
            entries.setdefault(t.words[i], []).append((number, i))
    indexed = sorted({w for entries in postings for w in entries})
    entry_type = "array<struct<template:int,offset:int>>"
    posted = [
        F.array(
            *[
                F.array(*[F.struct(F.lit(n).alias("template"), F.lit(i).alias("offset")) for n, i in entries.get(w, [])]).cast(entry_type)
                for w in indexed
            ]
        )
        for entries in postings
    ]
    known = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(number < len(base)).alias("base"),
                _array([w for w in t.words], "string").alias("words"),
                _array([weight[w] for w in t.words], "double").alias("weights"),
                _array(t.mandatory, "int").alias("mandatory"),
            )
            for number, t in enumerate(templates)
        ]
    )

    found = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)).alias("_raw"),
    )
    found = found.select("doc_id", F.size("_raw").cast("bigint").alias("n_words"), F.transform("_raw", lower_ascii).alias("_w"))
    index = _array(indexed, "string")
    # Most rows have no indexed word and stop here.
    hits = F.filter(
        F.transform("_w", lambda w, i: F.struct(F.array_position(index, w).cast("int").alias("entry"), i.alias("at"))),
        lambda h: h["entry"] > 0,
    )
    hits = F.when(F.arrays_overlap("_w", index), hits)
    found = found.withColumn("_hits", hits)

    def starts(entries: Column) -> Column:
        """Where templates would start by the postings of one rank."""

        def alignments(hit: Column) -> Column:
            return F.transform(
                F.element_at(entries, hit["entry"]),
                lambda p: F.struct(p["template"].alias("template"), (hit["at"] - p["offset"]).alias("start")),
            )

        return F.flatten(F.transform("_hits", alignments))

    # The postings intersected by relative position: all ranks agree on template and start.
    places = starts(posted[0])
    for entries in posted[1:]:
        places = F.array_intersect(places, starts(entries))
    found = found.withColumn("_places", F.array_distinct(places))

    def verified(place: Column) -> Column:
        t = F.get(known, place["template"])
        agrees = lambda i: F.coalesce(F.get("_w", place["start"] + i) == F.get(t["words"], i), F.lit(False))
        shares = F.transform(t["weights"], lambda w, i: F.when(agrees(i), w).otherwise(0.0))
        plus = lambda a, b: a + b
        score = F.aggregate(shares, F.lit(0.0), plus) / F.aggregate(t["weights"], F.lit(0.0), plus)
        whole = (place["start"] >= 0) & F.forall(t["mandatory"], agrees)
        return F.struct(
            place["start"].cast("bigint").alias("start"),
            t["label"].alias("label"),
            F.when(whole, F.least(score, F.lit(1.0))).otherwise(0.0).alias("score"),
            t["base"].alias("base"),
        )

    places = F.filter(F.transform("_places", verified), lambda p: p["score"] >= LEAST_SCORE)
    none = F.array().cast("array<struct<start:bigint,label:string,score:double,base:boolean>>")
    found = found.select("doc_id", "n_words", F.array_sort(F.coalesce(places, none)).alias("places"))
    return found.select(
        "doc_id",
        "n_words",
        "places",
        F.filter("places", lambda p: p["base"]).alias("base_places"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def labels_of(places: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))))
