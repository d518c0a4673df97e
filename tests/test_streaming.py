from pyspark.sql import functions as F

from millrace.operators import timeseries
from millrace.streaming import core as st
from tests.conftest import rows


def _folder(table, tmp_path, parts=3):
    ev = table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    ev.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(path)
    return ev, path


def test_stateful_stops_agree_with_batch(spark, table, tmp_path):
    ev, path = _folder(table, tmp_path, 1)
    stream = st.follow(spark, path, ev.schema, "parquet", 1).select("event_id", "ts", "user_id")
    got = st.run_available(st.dynamic_stops(stream, "ts", 2.0, "user_id"), str(tmp_path / "out"))
    batch = timeseries.running_periods(ev, "ts", "user_id", stop_ratio=2.0).select("event_id", "ts", "user_id", F.col("stop_ends"))
    assert rows(got) == rows(batch)


def test_late_rows_are_dropped_and_restart_repeats_nothing(spark, tmp_path):
    schema = "ts timestamp, v int"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(*data):
        spark.createDataFrame([(t, v) for t, v in data], "ts string, v int").select(F.col("ts").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = st.follow(spark, path, spark.createDataFrame([], schema).schema, "parquet")
        return st.run_available(st.windowed(stream, "ts", "10 minutes", {"n": F.count(F.lit(1))}, late="5 minutes"), out)

    feed(("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 1))
    run()
    feed(("2024-01-01 01:00:00", 1))
    run()
    feed(("2024-01-01 00:03:00", 1), ("2024-01-01 02:00:00", 1))  # the first one is late
    got = run()
    assert [r["n"] for r in got.orderBy("start").collect()] == [2, 1]


def test_sessions_split_at_the_gap(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:09:59",), ("2024-01-01 00:19:59",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    df.write.parquet(path)
    stream = st.follow(spark, path, df.schema, "parquet")
    got = st.run_available(st.sessions(stream, "ts", 600, {"n": F.count(F.lit(1))}), str(tmp_path / "out"), "complete")
    assert sorted(r["n"] for r in got.collect()) == [1, 2]


def test_late_rows_change_their_stop_and_state_empties(spark, tmp_path):
    """A row late by less than the watermark is put in order; one that is later is dropped; idle keys are forgotten."""
    import datetime as dt

    from pyspark.sql import functions as F

    from millrace.streaming import core

    start = dt.datetime(2024, 1, 1)
    at = lambda minute: start + dt.timedelta(minutes=minute)
    parts = [[("a", m) for m in (0, 10, 40, 50)] + [("b", 5)], [("a", 20), ("a", 30), ("a", 60)], [("a", 1)], [("b", 200)], [("c", 100_000)]]
    folder = str(tmp_path / "in")
    progress = []
    for i, part in enumerate(parts):
        spark.createDataFrame([(k, at(m)) for k, m in part], "k string, ts timestamp").write.parquet(f"{folder}/p{i}")
        stream = core.follow(spark, f"{folder}/*", spark.read.parquet(f"{folder}/*").schema, "parquet")
        stops = core.dynamic_stops(stream, "ts", 2.0, "k", late="45 minutes", idle_seconds=3600)
        query = stops.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r["k"], int((r["ts"] - start).total_seconds() // 60), r["stop_ends"]) for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("k") != "c").collect())
    assert got == [("a", m, 0) for m in (0, 10, 20, 30, 40, 50, 60)] + [("b", 5, 0), ("b", 200, 0)]  # without 20 and 30, 40 would end a stop
    assert progress[-1] == 1  # only the key that waits for the watermark


def test_keys_share_entries_of_the_state(spark, tmp_path):
    """Before, each key was an entry and a call of its own. Keys that look alike in pandas stay apart."""
    data = [(k, t) for k in (None, float("nan"), 0.0, -0.0, 1.5) for t in (0, 10, 20, 60)]
    df = spark.createDataFrame(data, "k double, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    path = str(tmp_path / "in")
    df.unionByName(spark.range(40).select((F.col("id") + 100.0).alias("k"), F.timestamp_seconds(F.lit(5)).alias("ts"))).coalesce(1).write.parquet(path)
    for late in (None, "1 second"):
        stream = st.dynamic_stops(st.follow(spark, path, df.schema, "parquet"), "ts", 2.0, "k", late=late, buckets=4)
        out, log = str(tmp_path / f"out-{late}"), str(tmp_path / f"log-{late}")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        if late is None:
            got = [(str(r["k"]), r["t"], r["stop_ends"]) for r in spark.read.parquet(out).where("k IS NULL OR k < 100 OR isnan(k)").select("k", F.unix_seconds("ts").alias("t"), "stop_ends").collect()]
            assert sorted(x for x in got if x[0] in ("None", "1.5")) == sorted((k, t, int(t == 60)) for k in ("None", "None", "1.5") for t in (0, 10, 20, 60))  # NaN comes back from pandas as NULL
            assert len(got) == 20
