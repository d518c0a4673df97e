"""Numbering, running values, sliding and moving windows, sort, top-k."""

from pyspark.sql import functions as F

from millrace.catalog.aggregates import STAT_SQL
from millrace.catalog.registry import GAPS, query
from millrace.functions import scalars as sc
from millrace.functions.similarity import MOVING_MEASURES
from millrace.functions.stats import MOVING_STATS
from millrace.operators import rows as row
from millrace.operators import windows as w

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_O = "ts,event_id"

query("mnumber", lambda t: w.number(t.orders, "n", "o_custkey", "o_totalprice%nr,o_orderkey", start=10, step=2),
      "SELECT *, 10 + 2 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1) AS n FROM orders")
query("mnumber_same", lambda t: w.number(t.orders, "n", "o_custkey", "o_orderstatus", mode="same"), "SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS n FROM orders")
query("mnumber_skip", lambda t: w.number(t.orders, "n", "o_custkey", "o_orderstatus", mode="skip"), "SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS n FROM orders")
query("mnumber_B", lambda t: w.number(t.customer, "n", "c_mktsegment", start="A", groups=True),
      "SELECT *, chr(CAST(64 + dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER)) AS n FROM customer")
query("mshare", lambda t: w.share(t.supplier, "s_acctbal:share", "s_nationkey"), "SELECT *, s_acctbal / nullif(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 0) AS share FROM supplier", "share")
query("mshare_all", lambda t: w.share(t.orders, "o_totalprice:share"), "SELECT *, o_totalprice / sum(o_totalprice) OVER () AS share FROM orders", "share", 9)
query("mnormalize_z", lambda t: w.normalize(t.orders, "o_totalprice:z", "o_orderpriority"),
      "SELECT *, (o_totalprice - avg(o_totalprice) OVER p) / stddev(o_totalprice) OVER p AS z FROM orders WINDOW p AS (PARTITION BY o_orderpriority)", "z", 7)
query("mnormalize_Z", lambda t: w.normalize(t.orders, "o_totalprice:z", "o_orderpriority", "Z"),
      "SELECT *, (o_totalprice - avg(o_totalprice) OVER p) / stddev(o_totalprice) OVER p * 10 + 50 AS z FROM orders WINDOW p AS (PARTITION BY o_orderpriority)", "z", 7)
query("mnormalize_range", lambda t: w.normalize(t.orders, "o_totalprice:z", "o_orderpriority", "range"),
      """SELECT *, (o_totalprice - min(o_totalprice) OVER p) / (max(o_totalprice) OVER p - min(o_totalprice) OVER p) AS z FROM orders
         WINDOW p AS (PARTITION BY o_orderpriority)""", "z", 9)
query("mkeybreak", lambda t: w.key_break(t.conversations, "conv_id", "turn"),
      """SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 END AS top,
         CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN 1 END AS bot FROM conversations""")
query("maccum", lambda t: w.accumulate(t.gaps, "x:total", _O, "user_id"), f"SELECT *, sum(x) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS total FROM {GAPS}", "total", 4)
query("maccum_all", lambda t: w.accumulate(t.orders.select("o_orderkey", "o_custkey"), "o_custkey:total", "o_orderkey"),
      "SELECT o_orderkey, o_custkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS total FROM orders")
query("mslide", lambda t: w.slide(t.gaps, "x:next", _O, "user_id", t=2),
      f"SELECT * FROM (SELECT *, lead(x, 1) OVER ({_W}) AS next1, lead(x, 2) OVER ({_W}) AS next2 FROM {GAPS} QUALIFY lead(1, 2) OVER ({_W}) IS NOT NULL)")
query("mslide_r", lambda t: w.slide(t.gaps, "x:prev", _O, "user_id", t=2, back=True, keep=True, last_only=True), f"SELECT *, lag(x, 2) OVER ({_W}) AS prev FROM {GAPS}")
_NUM = "(SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _short(t):
    return t.events.select("event_id", "user_id", "value")


query("mwindow", lambda t: w.window_rows(_short(t), "event_id", "win", 3, "user_id"),
      f"SELECT b.event_id AS win, a.event_id, a.user_id, a.value FROM {_NUM} a JOIN {_NUM} b ON a.user_id = b.user_id AND b.r BETWEEN a.r AND a.r + 2 WHERE b.r >= 3")
query("mwindow_r", lambda t: w.window_rows(_short(t), "event_id", "win", 3, "user_id", start=True, keep=True),
      f"SELECT b.event_id AS win, a.event_id, a.user_id, a.value FROM {_NUM} a JOIN {_NUM} b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 2 AND a.r")

_ROWS = "ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"
query("mmvavg", lambda t: w.moving_mean(t.gaps, "x:m", _O, "user_id", t=5),
      f"SELECT *, avg(x) OVER ({_W} {_ROWS.format(n=4)}) AS m FROM {GAPS} QUALIFY row_number() OVER ({_W}) > 4", "m")
query("mmvavg_skip", lambda t: w.moving_mean(t.gaps, "x:m", _O, "user_id", t=5, skip=0, strict=True),
      f"SELECT *, CASE WHEN count(x) OVER f = count(*) OVER f THEN avg(x) OVER f END AS m FROM {GAPS} WINDOW f AS ({_W} {_ROWS.format(n=4)})", "m")
query("mmvavg_w", lambda t: w.moving_mean(t.gaps, "x:m", _O, "user_id", t=3, kind="weighted", skip=0),
      f"""SELECT event_id, ts, user_id, event_type, value, x, (3 * coalesce(x, 0) + 2 * coalesce(p1, 0) + coalesce(p2, 0)) /
          nullif(CASE WHEN x IS NULL THEN 0 ELSE 3 END + CASE WHEN p1 IS NULL THEN 0 ELSE 2 END + CASE WHEN p2 IS NULL THEN 0 ELSE 1 END, 0) AS m
          FROM (SELECT *, lag(x) OVER ({_W}) AS p1, lag(x, 2) OVER ({_W}) AS p2 FROM {GAPS})""", "m")
_EMA = """WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER ({w}) AS r FROM {t}),
  e AS (SELECT event_id, user_id, r, x AS m FROM d WHERE r = 1
        UNION ALL SELECT d.event_id, d.user_id, d.r, CASE WHEN d.x IS NULL THEN e.m WHEN e.m IS NULL THEN d.x ELSE {a} * d.x + (1 - {a}) * e.m END
        FROM e JOIN d ON d.user_id = e.user_id AND d.r = e.r + 1)
  SELECT d.event_id, d.ts, d.user_id, d.event_type, d.value, d.x, e.m FROM d JOIN e USING (event_id)"""
query("mmvavg_exp", lambda t: w.moving_mean(t.gaps, "x:m", _O, "user_id", kind="exp", alpha=0.3, skip=0), _EMA.format(w=_W, t=GAPS, a=0.3), "m")
for s in MOVING_STATS:
    expr = STAT_SQL[s]
    parts = ("SELECT g.event_id, g.user_id, s.m FROM {g} g, LATERAL (SELECT {e} AS m FROM {g} h WHERE h.user_id = g.user_id AND h.r BETWEEN g.r - 5 AND g.r) s WHERE g.r > 5")
    num = f"(SELECT *, row_number() OVER ({_W}) AS r FROM {GAPS})"
    query(f"mmvstats_{s}", lambda t, s=s: w.moving_stats(t.gaps, s, "x:m", _O, "user_id", t=6).select("event_id", "user_id", "m"), parts.format(g=num, e=expr.format(x="h.x")), "m", 5)

_PAIRS = {
    "covar": "covar_pop(x, y)", "ucovar": "covar_samp(x, y)", "pearson": "CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END",
    "cosine": "sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0)", "euclid": "sqrt(sum((x - y) * (x - y)))", "cityblock": "sum(abs(x - y))",
    "hamming": "avg(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END)",
    "spearman": "CASE WHEN var_pop(u) > 0 AND var_pop(v) > 0 THEN corr(u, v) END",
}
_AB = f"(SELECT event_id, user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y, row_number() OVER ({_W}) AS r FROM events)"


def _ab(t):
    return t.events.select("event_id", "ts", "user_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))


def _flags(t):
    return t.events.select("event_id", "ts", "user_id", (F.col("value") > 20).cast("int").alias("x"), (F.col("event_id") % 2).cast("int").alias("y"))


_FL = f"(SELECT event_id, user_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS x, event_id % 2 AS y, row_number() OVER ({_W}) AS r FROM events)"
_JOINED = "SELECT g.event_id AS id, h.* FROM {g} g JOIN {g} h ON h.user_id = g.user_id AND h.r BETWEEN g.r - 4 AND g.r WHERE g.r > 4"
_PHI = "((a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0))"
_FRAME_TABLE = {"chi": f"n * {_PHI} * {_PHI}", "phi": _PHI, "jaccard": "a / nullif(a + b + c, 0)", "support": "a / n", "lift": "a * n / nullif((a + b) * (a + c), 0)", "kendall": _PHI}
for m in MOVING_MEASURES:
    if m in _FRAME_TABLE:
        four = ("SELECT id, count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND y <> 1)::DOUBLE AS b, count(*) FILTER (x <> 1 AND y = 1)::DOUBLE AS c, "
                f"count(*) FILTER (x <> 1 AND y <> 1)::DOUBLE AS d, count(*)::DOUBLE AS n FROM ({_JOINED.format(g=_FL)}) GROUP BY id")
        query(f"mmvsim_{m}", lambda t, m=m: w.moving_similarity(_flags(t), m, "x,y", "s", _O, "user_id", t=5).select(F.col("event_id").alias("id"), "s"),
              f"SELECT id, {_FRAME_TABLE[m]} AS s FROM ({four})", "s", 7)
    else:
        ranked = f"""SELECT *, rank() OVER (PARTITION BY id ORDER BY x) + (count(*) OVER (PARTITION BY id, x) - 1) / 2 AS u,
                     rank() OVER (PARTITION BY id ORDER BY y) + (count(*) OVER (PARTITION BY id, y) - 1) / 2 AS v FROM ({_JOINED.format(g=_AB)})"""
        query(f"mmvsim_{m}", lambda t, m=m: w.moving_similarity(_ab(t), m, "x,y", "s", _O, "user_id", t=5).select(F.col("event_id").alias("id"), "s"),
              f"SELECT id, {_PAIRS[m]} AS s FROM ({ranked if m == 'spearman' else _JOINED.format(g=_AB)}) GROUP BY id", "s", 5)

_F3, _F7 = f"({_W} {_ROWS.format(n=2)})", f"({_W} {_ROWS.format(n=6)})"
query("multi_mvavg", lambda t: w.multi_moving_mean(t.gaps, [("x,value", (3, 7), "&_#")], _O, "user_id"),
      f"SELECT *, avg(x) OVER {_F3} AS x_3, avg(x) OVER {_F7} AS x_7, avg(value) OVER {_F3} AS value_3, avg(value) OVER {_F7} AS value_7 FROM {GAPS}", "x_3 x_7 value_3 value_7")
query("multi_mvavg_exp", lambda t: w.multi_moving_mean(t.gaps, [("x", (4,), "m")], _O, "user_id", kind="exp"), _EMA.format(w=_W, t=GAPS, a=0.4), "m")
query("multi_mvstats", lambda t: w.multi_moving_stats(t.gaps, [("x", "sum,max", (3, 7), "&_%_#"), ("value", "var", (7,), "&_%_#")], _O, "user_id"),
      f"""SELECT *, sum(x) OVER {_F3} AS x_sum_3, sum(x) OVER {_F7} AS x_sum_7, max(x) OVER {_F3} AS x_max_3, max(x) OVER {_F7} AS x_max_7,
          var_pop(value) OVER {_F7} AS value_var_7 FROM {GAPS}""", "x_sum_3 x_sum_7 value_var_7", 5)
query("multi_mvsim", lambda t: w.multi_moving_similarity(_ab(t), [("x", "y", "covar,cityblock", (3, 7))], _O, "user_id").drop("ts"),
      f"""SELECT event_id, user_id, x, y, covar_pop(x, y) OVER a AS x_y_covar_3, covar_pop(x, y) OVER b AS x_y_covar_7, sum(abs(x - y)) OVER a AS x_y_cityblock_3,
          sum(abs(x - y)) OVER b AS x_y_cityblock_7 FROM (SELECT event_id, ts, user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events)
          WINDOW a AS {_F3}, b AS {_F7}""", "x_y_covar_3 x_y_covar_7 x_y_cityblock_3 x_y_cityblock_7", 5)

query("msortf", lambda t: t.orders.orderBy(*w.sort_columns("o_orderstatus%r,o_totalprice%n")), "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_totalprice")
query("mbest", lambda t: row.best(t.orders, "o_totalprice%nr,o_orderkey", "o_custkey", size=2)[0],
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
query("mbest_u", lambda t: row.best(t.orders, "o_totalprice%nr,o_orderkey", "o_custkey", size=2)[1],
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 2")
query("mbest_R", lambda t: row.best(t.orders, "o_orderkey", "o_custkey", ranges="0,3_5")[0],
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IN (1, 4, 5, 6)")
query("mbest_all", lambda t: row.best(t.orders, "o_totalprice%nr,o_orderkey", start=10, stop=19)[0], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
query("mbest_top", lambda t: row.top(t.orders, "o_totalprice%nr,o_orderkey", "o_orderpriority", 5),
      "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
query("mnullto_p", lambda t: sc.fill_null(t.gaps, "x:filled", previous=True, by="user_id", order=_O),
      f"SELECT *, last_value(x IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS filled FROM {GAPS}")
query("mcal_previous", lambda t: sc.previous(t.gaps, "x:before", _O, "user_id"), f"SELECT *, lag(x) OVER ({_W}) AS before FROM {GAPS}")
