"""Boosting on large input."""

from pyspark.sql import functions as F

from millrace.operators import ml


def test_boosting_divides_large_input(spark, monkeypatch):
    """Before, the splits of the files were the partitions, however many rows they held."""
    monkeypatch.setattr(ml, "TRAIN_ROWS", 500)
    seen = []
    assemble = ml.assemble
    monkeypatch.setattr(ml, "assemble", lambda df, *a: seen.append(df) or assemble(df, *a))
    df = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2 + 1.0).alias("w"), F.map_from_arrays(F.array("id"), F.array("id")).alias("m"))
    df = df.withColumn("y", F.when(F.col("x") > 3, 10.0).otherwise(F.lit(2.0)))
    model = ml.train(df, "gradient_boosting_regressor", "x", "y", maxIter=2, maxDepth=2, weightCol="w")
    sizes = seen[0].groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert seen[0].count() == 4000 and set(seen[0].columns) == {"x", "y", "w"}
    assert seen[0].rdd.getNumPartitions() == 8 and sum(r["count"] for r in sizes) == 4000
    assert max(r["count"] for r in sizes) < 650  # by the whole row, though the columns have 14 different ones
    got = {(r["x"], round(r["prediction"], 3)) for r in ml.predict(model, df, "x").select("x", "prediction").distinct().collect()}
    assert got == {(float(x), 10.0 if x > 3 else 2.0) for x in range(7)}
    seen.clear()
    ml.train(df.limit(900), "gradient_boosting_regressor", "x", "y", maxIter=1)
    assert seen[0].rdd.getNumPartitions() == 1  # small input stays as it is
