from pyspark.sql import functions as F

from assaybook.llm import common as C


def test_first_by_hash_is_the_head_of_the_hash_order(spark):
    df = spark.range(5000).withColumn("h", F.xxhash64("id"))
    want = [r["id"] for r in df.orderBy("h").limit(40).collect()]
    assert [r["id"] for r in C.first_by_hash(df, F.col("h"), 40).collect()] == want
    assert C.first_by_hash(df, F.col("h"), 4000).count() == 4000
    assert C.first_by_hash(df.limit(0), F.col("h"), 40).count() == 0


def test_names_that_clash(spark):
    df = spark.range(1).select(F.lit(1).alias("Key"), F.lit(2).alias("key_"))
    assert C.fresh(df, "key") == "key__" and C.fresh(df, "other") == "other"
    rows = spark.createDataFrame([(None,), (1,)], "i long").select(C.id_key(F.col("i")).alias("k")).collect()
    assert sorted(r.k for r in rows) == ["", "=1"]


def test_remove_staged(spark):
    assert C.stage(spark.range(3), "x").count() == 3
    assert C.remove_staged(spark)
    assert C.stage(spark.range(4), "x").count() == 4
