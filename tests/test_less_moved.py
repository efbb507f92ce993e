"""What the page job, stored versions and project documents no longer shuffle."""

from pyspark.sql import functions as F

from pagecorpus.operators import translate
from pagecorpus.operators.skew import spread_lookup
from pagecorpus.session import freeze, freeze_by
from pagecorpus.sources import project_json, versions


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_statuses_move_no_text(spark):
    blocks = freeze(spark.createDataFrame([(1, 0, " a "), (1, 1, "  "), (2, 0, None), (2, 1, "b")], "page_key int, pos int, original_text string"))
    memo = freeze(
        translate.distinct_texts(blocks).withColumns({"translated_text": F.col("text"), "status": F.lit("ok"), "error": F.lit(None).cast("string")})
    )
    done = translate.apply_memo(blocks, memo)
    assert sorted(done.select("page_key", "pos", "status").collect()) == sorted(
        blocks.select("page_key", "pos", F.when(F.trim("original_text") != "", "ok").otherwise("empty_text").alias("status")).collect()
    )
    statuses = done.groupBy("page_key").agg(F.count_if(F.col("status") != "ok"))
    above = plan(statuses).split("Join ", 1)[0]
    assert "original_text" not in above
    # Below the join the text is read and left behind.
    assert all("original_text" not in line.split("AS _blank", 1)[-1] for line in plan(statuses).splitlines() if "AS _blank" in line)


def test_rows_in_force(spark):
    rows = freeze(
        spark.createDataFrame(
            [("a", 1, "old"), ("a", 3, "new"), ("a", 3, "new too"), ("b", 1, "b"), ("c", 2, "c"), (None, 1, "none")], "k string, version long, x string"
        )
    )
    found = versions.in_force(rows, "k")
    assert sorted(r.x for r in found.collect()) == ["b", "c", "new", "new too"]
    assert found.columns == rows.columns
    shuffled = [line for line in physical(found).splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert not shuffled


def test_buckets_are_joined_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        texts = spark.range(1000).select((F.col("id") % 300).cast("string").alias("text"))
        memory = freeze_by(texts.distinct(), "text").withColumn("translated_text", F.concat(F.lit("tr:"), "text"))
        found = translate.from_memory(texts.groupBy("text").count(), memory)
        assert found.where(F.col("translated_text") == F.concat(F.lit("tr:"), "text")).agg(F.sum("count")).first()[0] == 1000
        assert physical(found).split("== Initial Plan ==")[0].count("Exchange hash") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_project_documents_that_carry_their_sizes(spark):
    block = '{"xyxy":[0,0,10,10],"text":["a"],"translation":"b"}'
    text = '{"pages":{"p":[' + block + ']}}'
    documents = spark.createDataFrame(
        [(1, text, 100.0, 100.0), (2, text, 0.0, 100.0), (3, '{"pages":{"p":[]}}', 50.0, 50.0), (4, text, None, 1.0)], "doc int, json string, img_w double, img_h double"
    )
    rules = spark.createDataFrame([], "rule_ord int, needles array<string>, replacements array<struct<pattern:string,value:string>>")
    apart = project_json.text_blocks(documents.drop("img_w", "img_h"), documents.select("doc", "img_w", "img_h"), rules, ["doc"])
    within = project_json.text_blocks(documents, None, rules, ["doc"])
    for one, other in zip(apart, within):
        assert sorted(map(str, one.select(*other.columns).collect())) == sorted(map(str, other.collect()))
    assert [r.doc for r in within[0].collect()] == [1]
    assert "Join" not in plan(within[0])


def test_hot_keys_by_counts_of_another_table(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 1), ("none", 2)], "k string, page int")
    lookup = spark.createDataFrame([("hot", "h"), ("cold", "c"), ("other", "o")], "k string, v string")
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = spread_lookup(facts, lookup, ["k"], "n", ["page"], hot_uses=5, rows_per_salt=3, counts=counts)
    assert sorted(found.select("k", "page", "v").collect()) == sorted(facts.join(lookup, "k").collect())
    assert sorted(found.columns) == ["k", "page", "v"]
