"""Samples of the models hold the documented number of distinct texts, however many copies there are."""

from pyspark.sql import functions as F

from pagecorpus.llm import language, toxicity


def copied(spark, distinct, copies):
    """``distinct`` texts and ``copies`` rows of one more."""
    own = spark.range(distinct).select(F.col("id").alias("doc_id"), F.concat(F.lit("own words number "), "id").alias("text"))
    hot = spark.range(10**6, 10**6 + copies).select(F.col("id").alias("doc_id"), F.lit("the same words again").alias("text"))
    return own.unionByName(hot)


def test_language_sample_under_copies(spark):
    docs = copied(spark, 300, 30_000).withColumn("lang", F.lit("x"))
    assert language._sample(docs, "text", "lang", 100).count() == 100


def test_toxicity_sample_under_copies(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 50)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 100)
    docs = copied(spark, 600, 30_000).withColumn("lang", F.lit("x"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 300, 0).otherwise(1).alias("toxic"))
    labelled = toxicity.with_labels(docs, labels)
    assert labelled.columns == ["doc_id", "text", "lang", "toxic"]
    found = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.countDistinct("text").alias("n")).collect()}
    assert found[1] >= 50 and found[0] >= 100 and labelled.count() < 1_000
    chosen = toxicity._chosen(docs.join(labels, "doc_id"), "text", "toxic")
    found = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.countDistinct("text").alias("n")).collect()}
    assert found[1] >= 50 and found[0] >= 100


def test_documents_with_a_label_column_of_their_own(spark):
    docs = copied(spark, 40, 5).selectExpr("*", "'x' AS lang", "9 AS toxic", "'q' AS __other")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic", "'e' AS text")
    labelled = toxicity.with_labels(docs, labels)
    assert {r.toxic for r in labelled.select("toxic").collect()} == {0, 1}
    assert toxicity.toxicity(docs, labelled).count() == 45


def test_toxicity_learns_from_every_labelled_text(spark, monkeypatch):
    """A word that only a few of many texts hold, all of them long, is learned in several shards."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 3_000, raising=False)
    n = 9_000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 300 == 7, F.concat(F.repeat(F.lit("some kind remark "), 1_200), F.lit("zorble "), "id"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("some vile remark "), "id"))
        .otherwise(F.concat(F.lit("some kind remark "), "id")).alias("text"),
        F.lit("x").alias("lang"),
    )
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 300 == 7) | (F.col("doc_id") % 3 == 1), 1).otherwise(0).alias("toxic"))
    labelled = toxicity.with_labels(docs, labels)
    assert labelled.count() == n
    net = toxicity.learn(labelled)
    scorer = toxicity.Scorer(net)
    assert scorer.score("some kind zorble remark") >= toxicity.CUT > scorer.score("some kind ribbon remark")
