"""Queries on text functions, display texts, glossary and page verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus import schema
from pagecorpus.functions import text as t
from pagecorpus.functions.responses import response_fields
from pagecorpus.operators import blocks as b
from pagecorpus.operators import glossary, layout
from pagecorpus.plans.catalogue import query
from pagecorpus.plans.views import CONV_BLOCKS, DOC_BLOCKS, Views
from pagecorpus.session import freeze

# Paddings put around lines: ideographic, no-break and ordinary space, tab, line break.
PAD = "　  \t\n"
SQL_PAD = "concat(chr(12288), ' ', chr(160), chr(9), chr(10))"
SQL_TRIM = "regexp_replace({0}, '^[\\s\\x0B\\x85\\p{{Z}}]+|[\\s\\x0B\\x85\\p{{Z}}]+$', '', 'g')"
SQL_COMPACT = "regexp_replace({0}, '[\\t\\n\\f\\r\\p{{Z}}]+', '', 'g')"


def sql_trim(e: str) -> str:
    return SQL_TRIM.format(e)


def sql_compact(e: str) -> str:
    return SQL_COMPACT.format(e)


def sql_clean(e: str) -> str:
    return sql_trim(f"replace(replace({e}, ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10))")


def sql_renderable(e: str) -> str:
    one_line = f"regexp_replace({e}, '[\\t\\n\\f\\r\\p{{Z}}]+', ' ', 'g')"
    return sql_trim(f"regexp_replace({one_line}, ' ([,.!?…])', '\\1', 'g')")


def _padded(v: Views) -> DataFrame:
    every_third = F.when(F.col("pos") % 3 == 0, PAD).otherwise("")
    return v.doc_blocks.withColumn("raw", F.concat(every_third, F.col("original_text"), every_third))


PADDED = f"""{DOC_BLOCKS}, padded AS (
 SELECT page_key, pos, concat(CASE WHEN pos % 3 = 0 THEN {SQL_PAD} ELSE '' END, original_text,
  CASE WHEN pos % 3 = 0 THEN {SQL_PAD} ELSE '' END) AS raw FROM doc_blocks)"""


@query(f"WITH {PADDED} SELECT page_key, pos, {sql_trim('raw')} AS trimmed FROM padded")
def unicode_trim(v: Views) -> DataFrame:
    return _padded(v).select("page_key", "pos", t.utrim("raw").alias("trimmed"))


@query(f"WITH {PADDED} SELECT page_key, pos, {sql_compact('raw')} AS compacted FROM padded")
def compact_text(v: Views) -> DataFrame:
    return _padded(v).select("page_key", "pos", t.compact("raw").alias("compacted"))


LOOSE = f"""{CONV_BLOCKS}, loose AS (
 SELECT page_key, pos, replace(original_text, '. ', '. ' || chr(10) || ' ') AS raw FROM conv_blocks)"""


def _loose(v: Views) -> DataFrame:
    return v.conv_blocks.withColumn("raw", F.replace("original_text", F.lit(". "), F.lit(". \n ")))


@query(f"WITH {LOOSE} SELECT page_key, pos, {sql_clean('raw')} AS cleaned FROM loose")
def clean_breaks(v: Views) -> DataFrame:
    return _loose(v).select("page_key", "pos", t.clean_breaks("raw").alias("cleaned"))


@query(
    f"""WITH {LOOSE}, spaced AS (SELECT page_key, pos, replace(replace(raw, ',', '  ,'), '.', chr(9) || '.') AS raw FROM loose)
SELECT page_key, pos, {sql_renderable('raw')} AS rendered FROM spaced"""
)
def renderable_text(v: Views) -> DataFrame:
    spaced = F.replace(F.replace(F.col("raw"), F.lit(","), F.lit("  ,")), F.lit("."), F.lit("\t."))
    return _loose(v).select("page_key", "pos", t.renderable(spaced).alias("rendered"))


@query(f"WITH {PADDED} SELECT page_key, pos, CAST(length_grapheme({sql_compact('raw')}) AS INTEGER) AS n_chars FROM padded")
def character_counts(v: Views) -> DataFrame:
    return _padded(v).select("page_key", "pos", t.char_count("raw").alias("n_chars"))


@query(
    f"""WITH {CONV_BLOCKS}, units AS (
 SELECT page_key, pos, CAST(pos + 3 AS INTEGER) AS k, {sql_compact("original_text")} AS u FROM conv_blocks)
SELECT page_key, pos, CAST(ceil(length(u) / k::DOUBLE) AS INTEGER) AS n_columns,
 array_to_string(list_transform(range(0, length(u), k), lambda i: substr(u, i + 1, k)), '|') AS columns
FROM units"""
)
def vertical_columns(v: Views) -> DataFrame:
    columns = layout.vertical_columns(t.graphemes("original_text"), (F.col("pos") + 3).cast("int"))
    staged = v.conv_blocks.withColumn("c", columns)
    return staged.select(
        "page_key",
        "pos",
        F.size("c").alias("n_columns"),
        F.array_join(F.transform("c", lambda column: F.array_join(column, "")), "|").alias("columns"),
    )


@query(
    f"""WITH {DOC_BLOCKS}, cased AS (
 SELECT page_key, pos, concat('  ', CASE WHEN pos % 4 < 2 THEN original_text ELSE ' ' END, chr(10), CASE WHEN pos % 4 = 0 THEN 'x' ELSE '' END) AS joined,
  CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN ' ' ELSE ' tr ' END AS translation FROM doc_blocks)
SELECT page_key, pos, {sql_trim('joined')} AS original_text, {sql_trim("coalesce(translation, '')")} AS translated_text
FROM cased WHERE {sql_trim('joined')} <> '' OR {sql_trim("coalesce(translation, '')")} <> ''"""
)
def block_content(v: Views) -> DataFrame:
    first = F.concat(F.lit("  "), F.when(F.col("pos") % 4 < 2, F.col("original_text")).otherwise(" "))
    second = F.when(F.col("pos") % 4 == 0, "x").otherwise("")
    translation = F.when(F.col("pos") % 3 == 1, " ").when(F.col("pos") % 3 == 2, " tr ")
    raw = v.doc_blocks.select("page_key", "pos", F.array(first, second).alias("text"), translation.alias("translation"))
    return b.block_content(raw).select("page_key", "pos", "original_text", "translated_text")


def _half_translated(v: Views) -> DataFrame:
    """Every third line has a translation, every seventh is blank on both sides."""
    blank = F.col("pos") % 7 == 6
    return v.doc_blocks.select(
        "page_key",
        "pos",
        F.when(blank, "   ").otherwise(F.concat(F.lit(" "), F.col("original_text"))).alias("original_text"),
        F.when(blank, "　")
        .when(F.col("pos") % 3 == 0, F.concat(F.lit("tr:"), F.col("original_text"), F.lit(" ")))
        .otherwise("")
        .alias("translated_text"),
    )


HALF = f"""{DOC_BLOCKS}, half AS (
 SELECT page_key, pos, CASE WHEN pos % 7 = 6 THEN '   ' ELSE concat(' ', original_text) END AS original_text,
  CASE WHEN pos % 7 = 6 THEN chr(12288) WHEN pos % 3 = 0 THEN concat('tr:', original_text, ' ') ELSE '' END AS translated_text
 FROM doc_blocks),
shown AS (
 SELECT *, coalesce(nullif({sql_trim('translated_text')}, ''), {sql_trim('original_text')}) AS display_text,
  coalesce(nullif({sql_trim('translated_text')}, ''), original_text) AS overlay_text FROM half)"""


@query(f"WITH {HALF} SELECT page_key, pos, display_text, overlay_text FROM shown")
def display_texts(v: Views) -> DataFrame:
    return _half_translated(v).select(
        "page_key",
        "pos",
        t.display_text("translated_text", "original_text").alias("display_text"),
        t.display_text("translated_text", "original_text", trim_original=False).alias("overlay_text"),
    )


@query(f"WITH {HALF} SELECT page_key, pos, display_text FROM shown WHERE display_text <> ''")
def drawable_blocks(v: Views) -> DataFrame:
    return b.drawable(_half_translated(v)).select("page_key", "pos", "display_text")


@query(
    f"""WITH {HALF}, per_page AS (
 SELECT page_key, count(*) AS n_blocks, count(*) FILTER (WHERE display_text <> '') AS n_drawable,
  bool_or({sql_trim('translated_text')} <> '') AS has_translation, bool_or(regexp_matches(translated_text, '[À-ÿ]')) AS has_target_script
 FROM shown GROUP BY page_key),
everyone AS (SELECT doc_id AS page_key FROM documents UNION ALL SELECT -1 - doc_id FROM labels)
SELECT e.page_key, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_drawable, 0) AS n_drawable,
 coalesce(has_translation, false) AS has_translation, coalesce(has_target_script, false) AS has_target_script,
 CASE WHEN n_blocks IS NULL THEN 'no_text_blocks' WHEN n_drawable = 0 THEN 'no_translation_blocks' ELSE 'ok' END AS status
FROM everyone e LEFT JOIN per_page p ON e.page_key = p.page_key"""
)
def page_summary(v: Views) -> DataFrame:
    """Labels stand for pages without any recognised block."""
    without = v.table("labels").select((-1 - F.col("doc_id")).alias("page_key"))
    everyone = v.table("documents").select(F.col("doc_id").alias("page_key")).unionByName(without)
    return b.page_summary(everyone, _half_translated(v), script=("À", "ÿ"))


@query(
    f"""WITH {HALF}
SELECT page_key, bool_or({sql_trim('translated_text')} <> '') AS any_translation,
 bool_or(regexp_matches(original_text, '[À-ÿ]')) AS any_accent FROM half GROUP BY page_key"""
)
def page_verdicts(v: Views) -> DataFrame:
    return (
        _half_translated(v)
        .groupBy("page_key")
        .agg(
            F.bool_or(~t.is_blank("translated_text")).alias("any_translation"),
            F.bool_or(t.contains_script("original_text", "À", "ÿ")).alias("any_accent"),
        )
    )


@query(
    f"""WITH {DOC_BLOCKS}
SELECT page_key, pos, regexp_matches(original_text, '[À-ÿ]') AS accented,
 regexp_matches(original_text, '[가-힣]') AS hangul FROM doc_blocks"""
)
def script_predicate(v: Views) -> DataFrame:
    return v.doc_blocks.select(
        "page_key",
        "pos",
        t.contains_script("original_text", "À", "ÿ").alias("accented"),
        t.contains_script("original_text").alias("hangul"),
    )


@query(
    f"""WITH {DOC_BLOCKS}, held AS (
 SELECT page_key, bool_or(starts_with(original_text, 'É')) AS texts FROM doc_blocks GROUP BY page_key)
SELECT s.page_key, texts OR l.doc_id IS NOT NULL AS exportable FROM held s
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON s.page_key = l.doc_id"""
)
def exportable_pages(v: Views) -> DataFrame:
    blocks = v.doc_blocks.withColumn(
        "translated_text", F.when(F.startswith("original_text", F.lit("É")), F.col("original_text")).otherwise("  ")
    )
    pages = v.table("documents").select(F.col("doc_id").alias("page_key"))
    drawn = v.table("labels").where("quality = 1").select(F.col("doc_id").alias("page_key"))
    return b.exportable_pages(pages, blocks, drawn)


@query(
    f"""WITH {CONV_BLOCKS}
SELECT page_key, pos, original_text, concat('tr:', original_text) AS translated_text FROM conv_blocks"""
)
def positional_rejoin(v: Views) -> DataFrame:
    translations = v.conv_blocks.select("page_key", "pos", F.concat(F.lit("tr:"), "original_text").alias("translated_text"))
    return b.rejoin(v.conv_blocks, translations)


# Neutral sample rules: (needles, [(pattern, value), ...]).
SAMPLE_RULES = [
    (["the"], [("the", "THE")]),
    (["tion", "ment"], [("tion", "TION"), ("THE", "The")]),
    (["zzzz"], [("a", "b")]),
    (["lees", "enth"], [("The", "tHe"), (" \n", "\n"), ("", "never")]),
]


def sample_rules(v: Views) -> DataFrame:
    rows = [(i, needles, replacements) for i, (needles, replacements) in enumerate(SAMPLE_RULES)]
    return v.spark.createDataFrame(rows, schema.RULES)


def _sql_fold(start: str) -> str:
    """Each rule as one more nested query column, in order."""
    text = start
    for needles, replacements in SAMPLE_RULES:
        fires = " OR ".join(f"contains(src, '{n}')" for n in needles)
        for pattern, value in replacements:
            if pattern:
                pattern_sql, value_sql = (x.replace("\n", "' || chr(10) || '") for x in (pattern, value))
                text = f"replace({text}, CASE WHEN {fires} THEN '{pattern_sql}' ELSE chr(1) END, '{value_sql}')"
    return text


def refined_sql(relation: str) -> str:
    """Glossary correction of ``relation(page_key, pos, original_text, translated_text)``."""
    return f"""sources AS (SELECT *, {sql_compact('original_text')} AS src, {sql_trim('translated_text')} AS tr FROM {relation}),
refined AS (SELECT *, CASE WHEN src = '' OR tr = '' THEN tr ELSE {sql_clean(_sql_fold('tr'))} END AS refined_text FROM sources)"""


LINES = f"""{LOOSE}, lines AS (
 SELECT page_key, pos, CASE WHEN pos = 5 THEN ' ' ELSE raw END AS original_text,
  CASE WHEN pos = 4 THEN '  ' ELSE concat(' ', raw, ' ') END AS translated_text FROM loose)"""


def _lines(v: Views) -> DataFrame:
    return _loose(v).select(
        "page_key",
        "pos",
        F.when(F.col("pos") == 5, " ").otherwise(F.col("raw")).alias("original_text"),
        F.when(F.col("pos") == 4, "  ").otherwise(F.concat(F.lit(" "), "raw", F.lit(" "))).alias("translated_text"),
    )


@query(f"WITH {LINES}, {refined_sql('lines')} SELECT page_key, pos, refined_text FROM refined")
def glossary_refine(v: Views) -> DataFrame:
    return glossary.refine(_lines(v), sample_rules(v)).select("page_key", "pos", "refined_text")


@query(f"WITH {LINES}, {refined_sql('lines')} SELECT page_key, pos, refined_text FROM refined")
def glossary_refine_joined(v: Views) -> DataFrame:
    """The form used for large glossaries."""
    return glossary.refine(_lines(v), sample_rules(v), inline_limit=0).select("page_key", "pos", "refined_text")


def _sql_rule_rows() -> str:
    rows = [f"({i}, '{n}')" for i, (needles, _) in enumerate(SAMPLE_RULES) for n in needles]
    return f"rules AS (SELECT CAST(o AS INTEGER) AS rule_ord, n AS needle FROM (VALUES {', '.join(rows)}) AS r(o, n))"


MATCHES = f"""{DOC_BLOCKS}, {_sql_rule_rows()}, matches AS (
 SELECT DISTINCT page_key, pos, rule_ord FROM doc_blocks, rules WHERE contains({sql_compact('original_text')}, needle))"""


@query(f"WITH {MATCHES} SELECT page_key, pos, rule_ord FROM matches")
def glossary_matches(v: Views) -> DataFrame:
    return glossary.matching_rules(v.doc_blocks, sample_rules(v))


COVERAGE = f"""WITH {MATCHES}
SELECT r.rule_ord, count(pos) AS n_blocks, count(DISTINCT page_key) AS n_pages
FROM (SELECT DISTINCT rule_ord FROM rules) r LEFT JOIN matches m ON r.rule_ord = m.rule_ord GROUP BY r.rule_ord"""


@query(COVERAGE)
def rule_coverage(v: Views) -> DataFrame:
    return glossary.rule_coverage(v.doc_blocks, sample_rules(v))


TIED_RULES = [(1, ["e"], [("e", "1")]), (1, ["qqq"], [("1", "2")]), (1, ["th"], [("1", "3"), ("t", "4")]), (2, ["a", "zz"], [("3", "5")])]


def _sql_tied(start: str) -> str:
    """Rules by order and then by the text of their JSON form."""
    ordered = sorted(TIED_RULES, key=lambda r: (r[0], "{\"needles\":[" + ",".join(f'"{n}"' for n in r[1])))
    text = start
    for _, needles, replacements in ordered:
        fires = " OR ".join(f"contains(src, '{n}')" for n in needles)
        for pattern, value in replacements:
            text = f"replace({text}, CASE WHEN {fires} THEN '{pattern}' ELSE chr(1) END, '{value}')"
    return text


TIED = f"""WITH {DOC_BLOCKS}, sources AS (
 SELECT page_key, pos, {sql_compact('original_text')} AS src, {sql_trim('original_text')} AS tr FROM doc_blocks)
SELECT page_key, pos, form, CASE WHEN src = '' OR tr = '' THEN tr ELSE {sql_clean(_sql_tied('tr'))} END AS refined_text
FROM sources, (VALUES ('inline'), ('joined')) AS f(form)"""


@query(TIED)
def glossary_ties(v: Views) -> DataFrame:
    """Rules of equal order, of which some don't apply, in both forms."""
    rules = v.spark.createDataFrame(TIED_RULES, schema.RULES)
    blocks = v.doc_blocks.withColumn("translated_text", F.col("original_text"))
    forms = [
        glossary.refine(blocks, rules, inline_limit=limit).select("page_key", "pos", F.lit(form).alias("form"), "refined_text")
        for form, limit in (("inline", 64), ("joined", 0))
    ]
    return forms[0].unionByName(forms[1])


@query(
    f"""WITH {DOC_BLOCKS}, words AS (
 SELECT DISTINCT w FROM (SELECT unnest(string_split(original_text, ' ')) AS w FROM doc_blocks) WHERE length(w) > 0),
needles AS (SELECT DISTINCT w AS needle, CAST(length(w) AS INTEGER) AS rule_ord FROM words WHERE length(w) IN (1, 3, 6) OR length(w) > 12)
SELECT DISTINCT page_key, pos, rule_ord FROM (
 SELECT page_key, pos, {sql_compact('original_text')} AS src FROM doc_blocks) s JOIN needles ON contains(src, needle)"""
)
def glossary_matches_large(v: Views) -> DataFrame:
    """A glossary of thousands of needles, words of the documents, some of one letter."""
    words = v.doc_blocks.select(F.explode(F.split("original_text", " ")).alias("w")).distinct()
    length = F.length("w")
    needles = words.where(length.isin(1, 3, 6) | (length > 12))
    rules = needles.select(length.alias("rule_ord"), F.array("w").alias("needles"), F.array().cast("array<struct<pattern:string,value:string>>").alias("replacements"))
    return glossary.matching_rules(v.doc_blocks, freeze(rules))


def _json_string(c: Column) -> Column:
    """JSON literal of a string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


@query(
    f"""WITH {CONV_BLOCKS}
SELECT page_key, pos, CASE WHEN pos = 3 THEN NULL WHEN pos = 5 THEN NULL ELSE {sql_trim("concat('tr:', original_text, ' ', page_key)")} END AS text,
 CASE WHEN pos = 3 THEN 'invalid_response' WHEN pos = 5 THEN 'missing_text' ELSE 'ok' END AS status FROM conv_blocks"""
)
def response_texts(v: Views) -> DataFrame:
    """Landed responses built from conversations, with groups that have to be skipped."""
    group = F.concat(
        F.lit("["), _json_string(F.concat(F.lit("tr:"), F.col("original_text"))), F.lit(","), _json_string(F.col("original_text")), F.lit(",null,null,1]")
    )
    tail = F.concat(F.lit('[" '), F.col("page_key").cast("string"), F.lit(' ",null]'))
    whole = F.concat(F.lit("[["), group, F.lit(',[7,"no"],"no",{"a":1},[],'), tail, F.lit('],null,"ja"]'))
    landed = (
        F.when(F.col("pos") == 3, F.concat(F.lit('{"a":'), group, F.lit("}")))
        .when(F.col("pos") == 5, '[[[" ","x"]],null]')
        .otherwise(whole)
    )
    return v.conv_blocks.select("page_key", "pos", response_fields(landed).alias("r")).select("page_key", "pos", "r.*")
