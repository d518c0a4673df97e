"""Sensor time series on events: key user, time ts, value with gaps."""

from pyspark.sql import functions as F

from millrace.catalog.registry import GAPS, query
from millrace.operators import timeseries as ts

_W = "PARTITION BY user_id ORDER BY ts"
_STOP = 6 * 3600  # seconds
_COLS = ["event_id", "user_id", "start", "end", "interval", "stop_begins", "stop_ends", "run_begins", "run_ends", "run_id", "stop_id"]

_GAP = f"(SELECT *, lead(ts) OVER ({_W}) AS nxt, lag(ts) OVER ({_W}) AS prv, epoch_us(lead(ts) OVER ({_W})) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM events)"


def _period_sql(flagged):
    """Flags and numbers of the running periods, from rows with a stop flag ss."""
    return f"""WITH f AS ({flagged}),
      g AS (SELECT *, coalesce(lag(ss) OVER ({_W}), 0) AS se FROM f),
      h AS (SELECT *, CASE WHEN (prv IS NULL AND ss = 0) OR se = 1 THEN 1 ELSE 0 END AS rb, CASE WHEN nxt IS NULL OR ss = 1 THEN 1 ELSE 0 END AS re FROM g)
      SELECT event_id, user_id, ts AS start, nxt AS "end", gap AS "interval", ss AS stop_begins, se AS stop_ends, rb AS run_begins, re AS run_ends,
        CAST(sum(rb) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id, CAST(sum(ss) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop_id FROM h"""


_FIX = f"SELECT *, CASE WHEN gap >= {_STOP} THEN 1 ELSE 0 END AS ss FROM {_GAP}"
_DYN = f"""SELECT * EXCLUDE (r) FROM (SELECT d.*, w.ss FROM
   (SELECT *, row_number() OVER ({_W}) AS r FROM {_GAP}) d JOIN (
     WITH RECURSIVE d AS MATERIALIZED (SELECT user_id, gap, row_number() OVER ({_W}) AS r FROM {_GAP}),
     w AS (SELECT user_id, r, gap AS s, 1 AS n, 0 AS ss FROM d WHERE r = 1
           UNION ALL
           SELECT d.user_id, d.r, CASE WHEN s <> 0 AND gap / (s / n) >= 2 THEN gap ELSE s + gap END, CASE WHEN s <> 0 AND gap / (s / n) >= 2 THEN 1 ELSE n + 1 END,
                  CASE WHEN s <> 0 AND gap / (s / n) >= 2 THEN 1 ELSE 0 END
           FROM w JOIN d ON d.user_id = w.user_id AND d.r = w.r + 1)
     SELECT * FROM w) w ON w.user_id = d.user_id AND w.r = d.r)"""
query("ts_mpid_fix", lambda t: ts.running_periods(t.events, "ts", "user_id", stop_after=_STOP).select(*_COLS), _period_sql(_FIX), "interval", 4)
query("ts_mpid_dynamic", lambda t: ts.running_periods(t.events, "ts", "user_id", stop_ratio=2.0).select(*_COLS), _period_sql(_DYN), "interval", 4)
query("ts_mpid_global", lambda t: ts.global_run_id(ts.running_periods(t.events, "ts", "user_id", stop_after=_STOP).select("event_id", "user_id", "run_id"), "user_id"),
      f"""WITH p AS ({_period_sql(_FIX)}) SELECT event_id, user_id, run_id, run_id + coalesce((SELECT CAST(sum(m) AS BIGINT) FROM
          (SELECT user_id AS u, max(run_id) AS m FROM p GROUP BY user_id) WHERE u < user_id), 0) AS global_run_id FROM p""")

# neighbouring valid points of every row
_NB = f"""(SELECT *, epoch_us(ts) / 1e6 AS t,
   last_value(x IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN x IS NOT NULL THEN epoch_us(ts) / 1e6 END IGNORE NULLS) OVER a AS pt,
   first_value(x IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN x IS NOT NULL THEN epoch_us(ts) / 1e6 END IGNORE NULLS) OVER b AS nt
   FROM {{src}} WINDOW a AS (PARTITION BY {{k}} ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY {{k}} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_VALUE = {"previous": "pv", "next": "nv", "nearest": "CASE WHEN t <= (pt + nt) / 2 THEN pv WHEN t > (pt + nt) / 2 THEN nv END",
          "linear": "(nv - pv) / nullif(nt - pt, 0) * (t - pt) + pv"}
for m, expr in _VALUE.items():
    query(f"ts_polation_{m}", lambda t, m=m: ts.interpolate(t.gaps, "ts", [("x", m, "y")], "user_id"),
          f"SELECT event_id, ts, user_id, event_type, value, x, coalesce(x, {expr}) AS y FROM {_NB.format(src=GAPS, k='user_id')}", "y", 3)
_RUNS = f"(SELECT g.*, p.run_id FROM {GAPS} g JOIN ({_period_sql(_FIX)}) p USING (event_id))"
query("ts_polation_mpi", lambda t: ts.interpolate(t.gaps, "ts", [("x", "linear", "y"), ("x", "previous", "z")], "user_id", stop_after=_STOP),
      f"SELECT event_id, ts, user_id, event_type, value, x, coalesce(x, {_VALUE['linear']}) AS y, coalesce(x, pv) AS z FROM {_NB.format(src=_RUNS, k='user_id, run_id')}", "y z", 3)
_AHEAD = f"""(SELECT *, first_value(x IGNORE NULLS) OVER b AS nv2, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt2
   FROM {_NB.format(src=GAPS, k='user_id')} WINDOW b AS ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
query("ts_polation_non_ip", lambda t: ts.interpolate(t.gaps, "ts", [("x", "linear", "l"), ("x", "nearest", "n"), ("x", "next", "f")], "user_id", formula=True).drop("l_intercept").withColumn("l_slope", F.col("l_slope") * 3600),
      f"""SELECT event_id, ts, user_id, event_type, value, x, (nv2 - pv) / nullif(nt2 - pt, 0) * 3600 AS l_slope, (pt + nt2) / 2 AS n_mid, pv AS n_prev, nv2 AS n_next, pv AS f_prev, nv2 AS f_next
          FROM {_AHEAD}""", "l_slope n_mid", 3)
query("ts_polation_cubic_spline", lambda t: ts.interpolate(t.gaps, "ts", [("x", "cubic_spline", "y")], "user_id"))
query("ts_polation_cubic_formula", lambda t: ts.interpolate(t.gaps, "ts", [("x", "cubic_spline", "y")], "user_id", formula=True))

# every event looks up the value 17 minutes after its own time
_CL = "(SELECT user_id, ts, epoch_us(ts) / 1e6 AS t, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS t2, x AS v, lead(x) OVER (PARTITION BY user_id ORDER BY ts) AS v2 FROM " \
      "(SELECT user_id, ts, value AS x FROM events))"
_ER = "(SELECT event_id, user_id, ts + INTERVAL 17 MINUTE AS ts, epoch_us(ts + INTERVAL 17 MINUTE) / 1e6 AS t FROM events)"
_METHODS = {"previous": "c.v", "next": "CASE WHEN e.t = c.t THEN c.v ELSE c.v2 END", "nearest": "CASE WHEN e.t <= (c.t + c.t2) / 2 THEN c.v ELSE c.v2 END",
            "linear": "(c.v2 - c.v) / (c.t2 - c.t) * (e.t - c.t) + c.v"}
query("ts_join", lambda t: ts.time_join(t.events.select("event_id", "user_id", (F.col("ts") + F.expr("interval 17 minutes")).alias("ts")), t.events.select("user_id", "ts", "value"),
                                        "ts", "ts", [("value", m, f"y_{m}") for m in _METHODS], "user_id"),
      "SELECT e.event_id, e.user_id, e.ts, " + ", ".join(f"CASE WHEN c.t2 IS NOT NULL THEN {x} END AS y_{m}" for m, x in _METHODS.items())
      + f" FROM {_ER} e ASOF LEFT JOIN {_CL} c ON e.user_id = c.user_id AND e.ts >= c.ts", "y_linear", 3)
query("ts_join_spline", lambda t: ts.time_join(t.events.select("event_id", "user_id", (F.col("ts") + F.expr("interval 17 minutes")).alias("ts")), t.events.select("user_id", "ts", "value"),
                                               "ts", "ts", [("value", "cubic_spline", "y"), ("value", "previous", "p")], "user_id"))

# time axes from the range of the data
_ENDS = "SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id"


def _span(t, kind):
    return t.orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))


query("ts_axis_0in_datetime", lambda t: ts.axis(t.spark, "axis", "datetime", 3600.0, spans=_span(t, "datetime")).select(F.col("axis").cast("timestamp_ntz").alias("axis")),
      "SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 HOUR)) AS axis FROM orders")
query("ts_axis_0in_date", lambda t: ts.axis(t.spark, "axis", "date", 7, spans=_span(t, "date")),
      "SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 7 DAY)) AS DATE) AS axis FROM orders")
query("ts_axis_0in_month", lambda t: ts.axis(t.spark, "axis", "month", 1, spans=_span(t, "month")),
      "SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS axis FROM orders")
query("ts_axis_0in_number", lambda t: ts.axis(t.spark, "axis", "number", 0.5, 10.0, t.orders), "SELECT 10 + 0.5::DOUBLE * (row_number() OVER () - 1) AS axis FROM orders")
query("ts_axis_1in", lambda t: ts.axis_of(t.events, "ts", "datetime", 3600.0, "user_id", "axis").select("user_id", F.col("axis").cast("timestamp_ntz").alias("axis")),
      f"SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS axis FROM ({_ENDS})")
query("ts_axis_1in_mpi", lambda t: ts.axis_of(t.events, "ts", "datetime", 1800.0, "user_id", "axis", stop_after=_STOP).select("user_id", "run_id", F.col("axis").cast("timestamp_ntz").alias("axis")),
      f"SELECT user_id, run_id, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS axis FROM (SELECT user_id, run_id, min(start) AS a, max(start) AS b FROM ({_period_sql(_FIX)}) GROUP BY ALL)")
