"""Tables written to the shared folder and read back: the rows outlive executors and are not computed again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from millrace.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a new compressed table in the folder that all executors see."""
    spark = df.sparkSession
    place = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(place, compression="zstd")
    return spark.read.schema(df.schema).parquet(place)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """The rows as a new table in that folder, divided by a column as a shuffle would: a join or cogroup by it later reads
    the table where it lies and moves the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).option("path", os.path.join(shared_folder(spark), table)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)
