"""Registered queries of this package, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.llm import (
    decontaminate,
    exact_stream,
    fill_middle,
    laesa,
    language,
    licences,
    packing,
    repeats,
    secrets,
    simhash,
    suffix_tree,
    toxicity,
    warc,
)
from pagecorpus.llm.common import is_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents", "doc_id", "text"))


@query()
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = is_remainder("doc_id", 4, 2)
    found = language.language_of(docs, ~held_out)
    return found.withColumn("held_out", held_out)


@query()
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(packing.tokenised(table(spark, folder, "documents", "doc_id", "text")))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    """SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
 CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN 'revisit' ELSE 'response' END
  AS record_type,
 CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER same THEN min(page_id) OVER same END
  AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))"""
)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages", "page_id", "url", "html"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = is_remainder("doc_id", 4, 2)
    labels = table(spark, folder, "labels", "doc_id", "toxic").where(~held_out)
    labelled = toxicity.with_labels(docs, labels)
    scored = toxicity.toxicity(docs, labelled)
    predicted = (F.col("score") >= toxicity.CUT).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted, F.col("toxic").alias("toxic_in_language"))


@query()
def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licence_notices(table(spark, folder, "documents", "doc_id", "text"))
    starts = F.transform("base_places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licences.labels_of(F.col("base_places")).alias("base_labels"),
        licences.labels_of(F.col("places")).alias("labels"),
        "score",
    )


@query()
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("found")).alias("spans"),
    )


@query()
def op8_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    held_out = is_remainder("doc_id", 10, 0)
    scored = suffix_tree.score_texts(table(spark, folder, "documents", "doc_id", "text"), ~held_out)
    return scored.withColumn("held_out", held_out)


@query()
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    pairs = decontaminate.leaked_items(docs, table(spark, folder, "benchmark", "item_id", "text"))
    return pairs.drop("tiles")


@query(
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_stream.exact_groups(table(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query(
    r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS lines,
  sha256('7:' || doc_id) AS digest FROM documents),
drawn AS (SELECT *, len(lines) AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(lines) + 1) AS one,
  ('0x' || substr(digest, 9, 8))::BIGINT % (len(lines) + 1) AS two,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
   WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(lines[1:least(one, two)], '') AS prefix,
  array_to_string(lines[least(one, two) + 1:greatest(one, two)], '') AS middle,
  array_to_string(lines[greatest(one, two) + 1:n], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM parts"""
)
def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents", "doc_id", "text"))
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        hashed(F.col("output")).alias("output_sha256"),
        hashed(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def _clustering_sql(k: int, rounds: int) -> str:
    """The rounds spelled out, each an assignment and new centroids."""
    gaps = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assigned = f"SELECT vec_id, v.v, min(CAST({gaps} AS BIGINT) * {k} + c.cluster) AS best FROM kept v, c{{0}} c GROUP BY v.row, vec_id, v.v"
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
  list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v FROM kept
 ORDER BY sha256('3:' || vec_id), v LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({assigned.format(i)})")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
   SELECT best % {k} AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1) m USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance,
 CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia,
 CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = best % {k}"""


@query(_clustering_sql(laesa.K, laesa.ROUNDS))
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = laesa.cluster_vectors(table(spark, folder, "embeddings", "vec_id", "embedding"))
    digest = F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256")
    return laesa.with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


@query(
    r"""WITH words AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row,
  regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
starts AS (SELECT doc_id, row, s, array_to_string(w[s:s + 49], ' ') AS run
 FROM (SELECT doc_id, row, w, unnest(range(1, len(w) - 48)) AS s FROM words)),
repeated AS (SELECT row, s FROM (SELECT doc_id, row, s, min(doc_id) OVER (PARTITION BY run) AS first FROM starts) WHERE first < doc_id),
gone AS (SELECT DISTINCT row, unnest(range(s, s + 50)) AS p FROM repeated),
stay AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
 FROM (SELECT row, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words) ANTI JOIN gone USING (row, p) GROUP BY row)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN stay USING (row)"""
)
def op13_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.cut_repeats(table(spark, folder, "documents", "doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["high"] - r["low"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
