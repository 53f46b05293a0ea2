from __future__ import annotations

from pyspark.sql import functions as F


def test_without(spark):
    import corpus_pipeline as c

    rows = spark.range(70_000).unionByName(spark.range(1 << 33, (1 << 33) + 40_000)).select(F.col("id").alias("k"), F.lit("x").alias("bits"), F.lit(1).alias("bucket"))
    gone = rows.filter(F.pmod(F.xxhash64("k"), F.lit(3)) == 0).select("k")
    left = c.without(rows, "k", gone)
    assert left.columns == rows.columns and left.count() == rows.count() - gone.count() and left.join(gone, "k", "left_semi").count() == 0
    assert c.without(rows, "k", gone.limit(0)).count() == rows.count() and c.without(rows, "k", rows.select("k")).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert c.without(rows, "k", gone).count() == left.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
