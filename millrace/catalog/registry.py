"""Registry of queries: name -> (Spark query, DuckDB SQL)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one scale folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self) -> str:
        """A new folder that all executors can reach."""
        return os.path.join(shared_folder(self.spark), f"query-{uuid.uuid4().hex}")

    @property
    def gaps(self) -> DataFrame:
        """Events with x = value, NULL on every seventh event."""
        x = F.when(F.col("event_id") % 7 != 0, F.col("value"))
        return self.events.select("event_id", "ts", "user_id", "event_type", "value", x.alias("x"))


GAPS = "(SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"


def query(name: str, make: Callable[[Tables], DataFrame], sql: str | None = None, rnd: str = "", digits: int = 6) -> None:
    """Register a query. The columns in ``rnd`` are rounded, here and in the SQL.

    Both sides add the same small shift first, so that a value halfway between two
    results does not fall to either side by its last bit.
    """
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    cols, shift = rnd.split(), 0.0137 * 10.0 ** -digits

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = make(Tables(spark, folder))
        return out.withColumns({c: F.round(F.col(f"`{c}`").cast("double") + shift, digits) + 0.0 for c in cols})

    QUERIES[name] = run
    if sql is not None:
        shown = ", ".join(f'round("{c}"::DOUBLE + {shift!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS "{c}"' for c in cols)
        ORACLE[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if cols else sql
