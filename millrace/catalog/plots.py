"""Tables behind plots."""

from pyspark.sql import functions as F

from millrace.catalog.registry import GAPS, query
from millrace.operators import plotdata as p

query("csvtohtmltable", lambda t: p.table_view(t.orders, "o_orderkey", 2, 100), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 2")
query("csvtolinegraph", lambda t: p.line_graph(t.gaps.select("event_type", F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.col("x").cast("string").alias("x")), "ts", "x", "event_type", "%Y%m%d%H%M%S")
      .select("event_type", F.col("x").cast("timestamp_ntz").alias("x"), "y"),
      f"SELECT event_type, date_trunc('second', ts) AS x, x AS y FROM {GAPS} WHERE x IS NOT NULL")
query("csvtohistogram", lambda t: p.histogram(t.gaps, "x", 20, "event_type"),
      f"""SELECT event_type, bin, lo + bin * (hi - lo) / 20 AS low, lo + (bin + 1) * (hi - lo) / 20 AS high, count(*) AS count FROM (
          SELECT event_type, lo, hi, least(CAST(floor((x - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin FROM {GAPS}, (SELECT min(x) AS lo, max(x) AS hi FROM {GAPS}) WHERE x IS NOT NULL) GROUP BY ALL""",
      "low high")
query("csvtoscatter", lambda t: p.scatter(t.gaps, "value", "x", "event_type", 1000, key="event_id"),
      f"SELECT event_type, value AS x, x AS y FROM {GAPS} WHERE x IS NOT NULL ORDER BY sha256('0:' || event_id) LIMIT 1000")
query("csvtoscatter_all", lambda t: p.scatter(t.gaps, "value", "x", "event_type", None), f"SELECT event_type, value AS x, x AS y FROM {GAPS} WHERE x IS NOT NULL")
query("csvtoscatter_density", lambda t: p.density(t.lineitem, "l_quantity", "l_extendedprice", 10, "l_returnflag"),
      """SELECT l_returnflag, least(CAST(floor((l_quantity - a) / ((b - a) / 10)) AS BIGINT), 9) AS x_bin, least(CAST(floor((l_extendedprice - c) / ((d - c) / 10)) AS BIGINT), 9) AS y_bin, count(*) AS count
         FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) GROUP BY ALL""")
_Q = f"(SELECT event_type, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM {GAPS} GROUP BY event_type)"
_NEAR = "x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
query("csvtoboxplot", lambda t: p.box_plot(t.gaps, "x", "event_type")[0],
      f"""SELECT event_type, q1, median, q3, min(x) FILTER ({_NEAR}) AS whisker_low, max(x) FILTER ({_NEAR}) AS whisker_high, count(*) FILTER (NOT ({_NEAR})) AS outliers
          FROM {GAPS} JOIN {_Q} USING (event_type) WHERE x IS NOT NULL GROUP BY event_type, q1, median, q3""", "q1 median q3")
query("csvtoboxplot_outliers", lambda t: p.box_plot(t.gaps, "x", "event_type")[1], f"SELECT event_type, x AS y FROM {GAPS} JOIN {_Q} USING (event_type) WHERE NOT ({_NEAR})")
query("csvtorepetitiviewaveform", lambda t: p.waveform(t.gaps.withColumn("hour", F.hour("ts")), "hour", "x", "event_type"),
      f"SELECT event_type, CAST(hour(ts) AS INTEGER) AS x, min(x) AS min, avg(x) AS mean, max(x) AS max FROM {GAPS} WHERE x IS NOT NULL GROUP BY event_type, hour(ts)", "mean")
_MARKED = f"(SELECT *, hour(ts) AS hour, event_id % 50 AS mark FROM {GAPS})"
query("csvtorepetitiviewaveform_event", lambda t: p.waveform_events(t.gaps.withColumns({"hour": F.hour("ts"), "mark": F.col("event_id") % 50}), "hour", "x", "mark").withColumn("x", F.col("x").cast("double")),
      f"SELECT DISTINCT hour::DOUBLE AS x FROM {_MARKED} WHERE mark = 0 AND x IS NOT NULL")
query("csvtorepetitiviewaveform_group", lambda t: p.waveform_points(t.gaps.withColumn("hour", F.hour("ts")), "hour", "x", "event_type", "user_id").withColumn("x", F.col("x").cast("double")),
      f"SELECT event_type, user_id, hour::DOUBLE AS x, x AS y FROM {_MARKED} WHERE x IS NOT NULL")
query("csvtorepetitiviewaveform_quartile", lambda t: p.waveform(t.gaps.withColumn("hour", F.hour("ts")), "hour", "x", "event_type", "quartile"),
      f"""SELECT event_type, CAST(hour(ts) AS INTEGER) AS x, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
          FROM {GAPS} WHERE x IS NOT NULL GROUP BY event_type, hour(ts)""", "q1 median q3")
query("csvtotimecompressionform", lambda t: p.time_compression(t.events, "event_id", "value", 25, "event_type"),
      """SELECT event_type, part, lo + (part - 1) * (hi - lo) / 25.0 AS start, min(value) AS min, avg(value) AS mean, max(value) AS max FROM (
         SELECT *, least(CAST(floor((event_id - lo) / ((hi - lo) / 25.0::DOUBLE)) AS BIGINT) + 1, 25) AS part FROM (
           SELECT event_type, event_id::DOUBLE AS event_id, value, min(event_id) OVER e::DOUBLE AS lo, max(event_id) OVER e::DOUBLE AS hi FROM events WINDOW e AS (PARTITION BY event_type)))
         GROUP BY event_type, part, lo, hi""", "start mean")
query("cast_to_float", lambda t: p.numeric_or_text(t.part.select("p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size")), "p_name,p_size"),
      "SELECT p_partkey, p_name, p_size::DOUBLE AS p_size FROM part")
