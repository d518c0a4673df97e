"""Structured Streaming over the events table, run until everything there is processed."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.catalog.series import _DYN, _period_sql
from millrace.operators import rows as row
from millrace.sources import ranges
from millrace.streaming import core as st
from millrace.streaming import growing


def _follow(t, name="events"):
    return st.follow(t.spark, t.folder, getattr(t, name).schema, "parquet", pathGlobFilter=f"{name}.parquet")


def _events(t):
    return _follow(t).withColumn("ts", F.col("ts").cast("timestamp"))


def _counts(t, **kw):
    stream = st.windowed(_events(t), "ts", "1 hour", {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}, "event_type", **kw)
    out = st.run_available(stream, mode="complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


query("stream_source", lambda t: st.run_available(_follow(t)), "SELECT * FROM events")
query("stream_filter", lambda t: st.run_available(row.select_number(_follow(t), "value", "[10,50)")[0]), "SELECT * FROM events WHERE value >= 10 AND value < 50")
query("stream_tumbling", _counts,
      "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
query("stream_sliding", lambda t: _counts(t, slide="30 minutes"),
      """SELECT s AS start, s + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
         SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, event_type, value FROM events) GROUP BY ALL""")
query("stream_sessions", lambda t: st.run_available(st.sessions(_events(t), "ts", 6 * 3600, {"n": F.count(F.lit(1)), "last": F.max("ts")}, "user_id"), mode="complete").select(
    F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "user_id", "n"),
      """SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, run""")
query("stream_static_join", lambda t: st.run_available(st.join_table(_follow(t, "orders"), t.customer, "o_custkey", "c_custkey", "c_name")),
      "SELECT o.*, c_name FROM orders o JOIN customer ON o_custkey = c_custkey")
query("stream_dynamic_stops", lambda t: st.run_available(st.dynamic_stops(_events(t).select("event_id", "ts", "user_id"), "ts", 2.0, "user_id")).select("event_id", "user_id", "stop_ends"),
      f"SELECT event_id, user_id, stop_ends FROM ({_period_sql(_DYN)})")


# append mode: the events come over several triggers, and a last one far ahead lets the watermark pass all others
def _triggers(t, parts, make):
    """Write part after part into one folder and run the stream after each, from its log."""
    folder, base = t.scratch(), t.scratch()
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/p{i}")
        out = st.run_available(make(st.follow(t.spark, f"{folder}/*", part.schema, "parquet")), base)
    return out


def _dealt(t, slot, slots, end="2030-01-01"):
    """The events by slot, and one of user -1 at the end."""
    events = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withColumn("slot", F.expr(slot))
    last = t.spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(end).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("").alias("event_type"), F.lit(0.0).alias("value"))
    return [events.where(F.col("slot") == i).drop("slot") for i in range(slots)] + [last]


_MIDDLE = "TIMESTAMP '2024-01-15 00:00:00'"
_HALVES = f"CASE WHEN event_id % 50 = 0 THEN 2 WHEN ts < {_MIDDLE} THEN 0 ELSE 1 END"
#: Rows that come last; those whose window the watermark has passed by then are dropped.
_KEPT = f"""(SELECT * FROM (SELECT *, {{start}} AS s FROM events) WHERE event_id % 50 <> 0
    OR s + INTERVAL 1 HOUR > (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 DAY FROM events WHERE event_id % 50 <> 0))"""


def _late_counts(t, **kw):
    make = lambda s: st.windowed(s, "ts", "1 hour", {"n": F.count(F.lit(1)), "total": F.sum("value")}, "event_type", late="10 days", **kw)
    out = _triggers(t, _dealt(t, _HALVES, 3), make).where("event_type <> ''")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _late_sessions(t):
    slot = f"CASE WHEN ts >= {_MIDDLE} THEN 1 WHEN event_id % 50 = 0 THEN 2 ELSE 0 END"
    make = lambda s: st.sessions(s, "ts", 6 * 3600, {"n": F.count(F.lit(1)), "last": F.max("ts")}, "user_id", late="10 days")
    return _triggers(t, _dealt(t, slot, 3), make).where("user_id <> -1").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "user_id", "n")


def _late_stops(t):
    """Every second event comes two days late."""
    slot = "floor((datediff(ts, '2024-01-01') + 2 * (event_id % 2)) / 8)"
    parts = [p.select("event_id", "ts", "user_id") for p in _dealt(t, slot, 4)]
    make = lambda s: st.dynamic_stops(s, "ts", 2.0, "user_id", late="3 days", idle_seconds=3600.0 * 24 * 365)
    return _triggers(t, parts, make).where("user_id <> -1").select("event_id", "user_id", "stop_ends")


query("stream_tumbling_late", _late_counts,
      f"SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM {_KEPT.format(start='time_bucket(INTERVAL 1 HOUR, ts)')} GROUP BY ALL", "total", 4)
query("stream_sliding_late", lambda t: _late_counts(t, slide="30 minutes"),
      f"SELECT s AS start, s + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM "
      f"{_KEPT.format(start='unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])')} GROUP BY ALL", "total", 4)
query("stream_sessions_late", _late_sessions,
      f"""SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events
         WHERE event_id % 50 <> 0 OR ts >= {_MIDDLE})) GROUP BY user_id, run""")
query("stream_dynamic_stops_late", _late_stops, f"SELECT event_id, user_id, stop_ends FROM ({_period_sql(_DYN)})")


# growing files
def _write_lines(t, folder, half):
    """The lines of the documents as a few files. ``half``: those of the even documents, and a piece of the next line."""
    lines = t.documents.select((F.col("doc_id") % 2).alias("odd"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    files = 4 + t.documents.count() // 20_000  # so that no task writes more than about 20,000 documents
    lines = lines.repartition(files, "doc_id").sortWithinPartitions("odd", "doc_id", "place").select("odd", F.concat_ws("\t", F.col("doc_id").cast("string"), "line").alias("value"))

    def write(batches):
        fs, inner = ranges.file_system(folder)
        fs.create_dir(inner, recursive=True)
        name, size, cut = f"{inner}/part-{TaskContext.get().partitionId()}.txt", 0, False
        with fs.open_output_stream(name) as out:
            for batch in batches:
                for odd, value in zip(batch.column("odd").to_pylist(), batch.column("value").to_pylist()):
                    data = value.encode() + b"\n"
                    if half and odd:
                        data, cut = data[:3] if not cut else b"", True
                    out.write(data)
                    size += len(data)
        yield pa.RecordBatch.from_pydict({"size": [size]})

    lines.mapInArrow(write, "size long").collect()  # a number per file


def _growing(t):
    """Follow the files when they are half written and again when they have grown."""
    folder, base = t.scratch(), t.scratch()
    for half in (True, False):
        _write_lines(t, folder, half)
        out = st.run_available(growing.follow_lines(t.spark, folder, range_bytes=1 << 20), base)
    return out.select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("line"))


query("stream_growing_files", _growing, "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
