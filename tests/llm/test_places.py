"""Rows taken out by their place, and what the driver holds for it."""

from pyspark.sql import functions as F

from pagecorpus.llm.common import FILE, ROW, located, without
from pagecorpus.session import freeze, sized_in_memory


def test_many_places_go_as_bits(spark, tmp_path):
    spark.range(0, 150_000, 1, 2).withColumn("x", F.repeat(F.lit("x"), 20)).write.parquet(str(tmp_path / "t"))
    rows = located(spark.read.parquet(str(tmp_path / "t")), ["id", "x"])
    # Edges of bytes and blocks among them, and one file of which nothing goes.
    one_file = rows.agg(F.min(FILE)).first()[0]
    gone = rows.where((F.col(FILE) == one_file) & ((F.col(ROW) % 3 == 0) | F.col(ROW).isin(7, 8, 32_767, 32_768, 32_769, 65_535)))
    kept, plain = without(rows, gone, few=10), without(rows, gone)
    assert kept.columns == plain.columns == ["id", "x"]
    assert plain.count() == kept.count() == kept.join(plain, "id").count()
    assert without(rows, rows, few=10).count() == 0
    plan = kept._jdf.queryExecution().optimizedPlan()
    held = [line for line in plan.toString().splitlines() if "Relation" in line and "__llm_bits" in line]
    assert len(held) == 1


def test_a_table_small_only_as_a_file_is_not_broadcast(spark):
    # Numbers in a row compress to little.
    table, other = (freeze(spark.range(400_000).select(F.col("id").alias("node"), F.lit(0).alias(c))) for c in "ab")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lambda: table.join(other, "node")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan()
        with sized_in_memory(spark):
            assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
