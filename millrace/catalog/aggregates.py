"""Counts, sums, the 22 statistics, pair similarity, buckets, pivots."""

from pyspark.sql import functions as F

from millrace.catalog.registry import GAPS, query
from millrace.functions.similarity import MEASURES
from millrace.functions.stats import STATS
from millrace.operators import aggs as a
from millrace.operators import pivots as p

query("mcount", lambda t: a.count(t.orders, "o_orderstatus,o_orderpriority", "n"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
query("msum", lambda t: a.sum_columns(t.lineitem, "l_quantity:q,l_tax:x", "l_returnflag,l_linestatus"),
      "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, sum(l_tax) AS x FROM lineitem GROUP BY ALL", "q x", 4)
query("msum_n", lambda t: a.sum_columns(t.gaps, "x:s", "user_id", strict=True),
      f"SELECT user_id, CASE WHEN count(x) = count(*) THEN sum(x) END AS s FROM {GAPS} GROUP BY user_id", "s", 4)
query("mavg", lambda t: a.mean_columns(t.lineitem, "l_quantity:q,l_discount:d", "l_suppkey"),
      "SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL", "q d", 7)
query("mhashsum", lambda t: a.sum_columns(t.lineitem, "l_quantity:q", "l_partkey"), "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL", "q", 4)
query("mhashavg", lambda t: a.mean_columns(t.lineitem, "l_quantity:q", "l_partkey"), "SELECT l_partkey, avg(l_quantity) AS q FROM lineitem GROUP BY ALL", "q", 7)

# one DuckDB expression per statistic, {x} is the column
STAT_SQL = {
    "count": "count({x})", "ucount": "count(DISTINCT {x})", "sum": "sum({x})", "mean": "avg({x})", "devsq": "var_pop({x}) * count({x})",
    "var": "var_pop({x})", "uvar": "var_samp({x})", "sd": "stddev_pop({x})", "usd": "stddev_samp({x})", "cv": "stddev_pop({x}) / nullif(avg({x}), 0)",
    "min": "min({x})", "qtile1": "quantile_cont({x}, 0.25)", "median": "quantile_cont({x}, 0.5)", "qtile3": "quantile_cont({x}, 0.75)", "max": "max({x})",
    "range": "max({x}) - min({x})", "qrange": "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)",
    "skew": "CASE WHEN var_pop({x}) > 0 THEN (avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * pow(avg({x}), 3)) / pow(var_pop({x}), 1.5) END",
    "uskew": "CASE WHEN count({x}) >= 3 AND var_pop({x}) > 0 THEN skewness({x}) END",
    "kurt": "CASE WHEN var_pop({x}) > 0 THEN kurtosis_pop({x}) END", "ukurt": "CASE WHEN count({x}) >= 4 AND var_pop({x}) > 0 THEN kurtosis({x}) END",
}
_MODE = """SELECT user_id, s FROM (SELECT user_id, x AS s, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, x) AS r
           FROM {t} WHERE x IS NOT NULL GROUP BY user_id, x) WHERE r = 1"""
for s in STATS:
    sql = _MODE.format(t=GAPS) if s == "mode" else f"SELECT user_id, {STAT_SQL[s].format(x='x')} AS s FROM {GAPS} GROUP BY user_id"
    query(f"mstats_{s}", lambda t, s=s: a.stats(t.gaps, s, "x:s", "user_id"), sql, "" if s in ("count", "ucount") else "s", 5)
query("mstats_all", lambda t: a.describe(t.lineitem, None, {s: (s, "l_quantity") for s in STATS if s != "mode"}),
      "SELECT " + ", ".join(f"{STAT_SQL[s].format(x='l_quantity')} AS {s}" for s in STATS if s != "mode") + " FROM lineitem",
      "sum mean devsq var uvar sd usd cv min qtile1 median qtile3 max range qrange skew uskew kurt ukurt", 3)
_SUMMARY = ["count", "mean", "median", "usd", "max"]
query("msummary", lambda t: a.summary(t.lineitem, "count:n,mean,median,usd,max", "l_quantity,l_extendedprice,l_tax", "l_returnflag"),
      " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS field, count({c})::DOUBLE AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS usd, max({c}) AS max FROM lineitem GROUP BY l_returnflag"
                         for c in ("l_quantity", "l_extendedprice", "l_tax")), "mean median usd", 5)

# pair measures: two numbers with gaps, and the two flags of labels
_XY = "(SELECT event_type, event_id % 97 AS y, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)"


def _xy(t):
    return t.gaps.select("event_type", (F.col("event_id") % 97).alias("y"), "x")


_PAIR = {
    "covar": "covar_pop(y, x)", "ucovar": "covar_samp(y, x)", "pearson": "corr(y, x)",
    "cosine": "sum(x * y) / sqrt(sum(CASE WHEN x IS NOT NULL THEN y * y END) * sum(x * x))", "euclid": "sqrt(sum((x - y) * (x - y)))",
    "cityblock": "sum(abs(x - y))", "hamming": "avg(CASE WHEN x IS NOT NULL THEN CASE WHEN x <> y THEN 1.0 ELSE 0.0 END END)",
}
_RANKED = f"""(SELECT *, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2 AS u,
               rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS v FROM {_XY} WHERE x IS NOT NULL)"""
_FOUR = "(SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS a, count(*) FILTER (quality = 1 AND toxic <> 1)::DOUBLE AS b, " \
        "count(*) FILTER (quality <> 1 AND toxic = 1)::DOUBLE AS c, count(*) FILTER (quality <> 1 AND toxic <> 1)::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels)"
_PHI = "((a * d - b * c) / nullif(sqrt((a + b) * (c + d) * (a + c) * (b + d)), 0))"
_CONF = ("a / nullif(a + b, 0)", "a / nullif(a + c, 0)")
_CONV = (f"(1 - (a + c) / n) / nullif(1 - {_CONF[0]}, 0)", f"(1 - (a + b) / n) / nullif(1 - {_CONF[1]}, 0)")
_EXP = "(((a + b) * (a + c) + (c + d) * (b + d)) / (n * n))"
_TABLE = {
    "chi": f"n * {_PHI} * {_PHI}", "phi": _PHI, "kappa": f"((a + d) / n - {_EXP}) / nullif(1 - {_EXP}, 0)", "jaccard": "a / nullif(a + b + c, 0)", "support": "a / n",
    "lift": "a * n / nullif((a + b) * (a + c), 0)", "confMax": f"greatest({_CONF[0]}, {_CONF[1]})", "confMin": f"least({_CONF[0]}, {_CONF[1]})",
    "convMax": f"CASE WHEN {_CONV[0]} IS NOT NULL AND {_CONV[1]} IS NOT NULL THEN greatest({_CONV[0]}, {_CONV[1]}) END",
    "convMin": f"CASE WHEN {_CONV[0]} IS NOT NULL AND {_CONV[1]} IS NOT NULL THEN least({_CONV[0]}, {_CONV[1]}) END",
    "yuleQ": "(a * d - b * c) / nullif(a * d + b * c, 0)", "yuleY": "(sqrt(a * d) - sqrt(b * c)) / nullif(sqrt(a * d) + sqrt(b * c), 0)", "oddsRatio": "a * d / nullif(b * c, 0)",
}
for m in MEASURES:
    if m in _TABLE:
        query(f"msim_{m}", lambda t, m=m: a.similarity(t.labels, f"{m}:s", "quality,toxic"), f"SELECT 'quality' AS field1, 'toxic' AS field2, {_TABLE[m]} AS s FROM {_FOUR}", "s", 7)
    elif m == "spearman":
        query("msim_spearman", lambda t: a.similarity(_xy(t), "spearman:s", "y,x", "event_type"),
              f"SELECT event_type, 'y' AS field1, 'x' AS field2, corr(u, v) AS s FROM {_RANKED} GROUP BY event_type", "s", 7)
    elif m == "kendall":
        query("msim_kendall", lambda t: a.similarity(t.labels, "kendall:s", "quality,toxic"), f"SELECT 'quality' AS field1, 'toxic' AS field2, {_PHI} AS s FROM {_FOUR}", "s", 7)
    else:
        query(f"msim_{m}", lambda t, m=m: a.similarity(_xy(t), f"{m}:s", "y,x", "event_type"),
              f"SELECT event_type, 'y' AS field1, 'x' AS field2, {_PAIR[m]} AS s FROM {_XY} GROUP BY event_type", "s", 4)
query("msim_d", lambda t: a.similarity(t.lineitem, "pearson:s", "l_quantity,l_extendedprice", "l_returnflag", diagonal=True),
      " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS field1, '{y}' AS field2, corr({x}, {y}) AS s FROM lineitem GROUP BY l_returnflag"
                         for x in ("l_quantity", "l_extendedprice") for y in ("l_quantity", "l_extendedprice")), "s", 7)

# buckets
_CUTS = "(SELECT l_returnflag, " + ", ".join(f"quantile_cont(l_extendedprice, {i} / 4.0) AS q{i}" for i in (1, 2, 3)) + " FROM lineitem GROUP BY l_returnflag)"
_NO = "1 + (l_extendedprice >= q1)::INT + (l_extendedprice >= q2)::INT + (l_extendedprice >= q3)::INT"


def _b(t):
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice", "l_quantity")


query("mbucket", lambda t: a.bucket(_b(t), "l_extendedprice:no", 4, "l_returnflag"),
      f"SELECT l_orderkey, l_returnflag, l_extendedprice, l_quantity, ({_NO})::BIGINT AS no FROM lineitem JOIN {_CUTS} USING (l_returnflag)")
query("mbucket_r", lambda t: a.bucket(_b(t), "l_extendedprice:no", 4, "l_returnflag", reverse=True),
      f"SELECT l_orderkey, l_returnflag, l_extendedprice, l_quantity, (5 - ({_NO}))::BIGINT AS no FROM lineitem JOIN {_CUTS} USING (l_returnflag)")
query("mbucket_rng", lambda t: a.bucket(_b(t), "l_quantity:no", 7, "l_returnflag", equal_width=True),
      """SELECT l_orderkey, l_returnflag, l_extendedprice, l_quantity, least(CAST(floor((l_quantity - lo) / ((hi - lo) / 7.0)) AS BIGINT) + 1, 7) AS no
         FROM lineitem JOIN (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag) USING (l_returnflag)""")
query("mbucket_label", lambda t: a.bucket(t.part.select("p_partkey", "p_size"), "p_size:label", 3, style="both"),
      """SELECT p_partkey, p_size, CASE WHEN p_size < q1 THEN '1:_' || q1 WHEN p_size < q2 THEN '2:' || q1 || '_' || q2 ELSE '3:' || q2 || '_' END AS label
         FROM part, (SELECT quantile_cont(p_size::DOUBLE, 1 / 3.0) AS q1, quantile_cont(p_size::DOUBLE, 2 / 3.0) AS q2 FROM part)""")
query("mmbucket", lambda t: a.bucket_grid(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_retailprice:b1,p_size:b2", 2),
      """WITH c AS (SELECT *, 1 + (p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.5) FROM part))::BIGINT AS b1 FROM part),
         d AS (SELECT b1, quantile_cont(p_size::DOUBLE, 0.5) AS q FROM c GROUP BY b1)
         SELECT p_partkey, p_size, p_retailprice, b1, 1 + (p_size >= q)::BIGINT AS b2 FROM c JOIN d USING (b1)""")
query("mmbucket_ms", lambda t: a.bucket_grid(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size:b1,p_retailprice:b2", 3, try_orders=True))

# pivots
query("mcross", lambda t: p.transpose(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("s")),
                                      "n,s", "l_linestatus", "l_returnflag", fill=0, values=["F", "O"]),
      """WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY ALL)
         SELECT l_returnflag, field, coalesce(max(CASE WHEN l_linestatus = 'F' THEN v END), 0) AS F, coalesce(max(CASE WHEN l_linestatus = 'O' THEN v END), 0) AS O
         FROM (SELECT l_returnflag, l_linestatus, 'n' AS field, n AS v FROM g UNION ALL SELECT l_returnflag, l_linestatus, 's', s FROM g) GROUP BY l_returnflag, field""")
query("m2cross", lambda t: p.long_to_wide(t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", "n", "o_custkey", fill=0),
      "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
query("m2cross_long", lambda t: p.wide_to_long(t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_discount,l_tax", ("name", "value"), "l_orderkey,l_linenumber"),
      "SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM lineitem)"
query("mcombi", lambda t: p.combinations(t.lineitem, "l_partkey", 2, "a,b", "l_orderkey"),
      f"SELECT l_orderkey, x.l_partkey AS a, y.l_partkey AS b FROM {_LINES} x JOIN {_LINES} y USING (l_orderkey) WHERE x.r < y.r")
query("mcombi_p", lambda t: p.combinations(t.supplier, "s_suppkey", 2, "a,b", "s_nationkey", permutations=True),
      "SELECT s_nationkey, x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y USING (s_nationkey) WHERE x.s_suppkey <> y.s_suppkey")
query("mcombi_dup", lambda t: p.combinations(t.nation, "n_name", 3, "a,b,c", repeat=True),
      "SELECT x.n_name AS a, y.n_name AS b, z.n_name AS c FROM nation x, nation y, nation z WHERE x.n_name <= y.n_name AND y.n_name <= z.n_name")
