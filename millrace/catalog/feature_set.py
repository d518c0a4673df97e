"""The feature aggregator: every feature alone, and all of them in one call."""

from pyspark.sql import functions as F

from millrace.catalog.aggregates import STAT_SQL
from millrace.catalog.registry import GAPS, query
from millrace.functions.stats import STATS
from millrace.operators.features import FEATURES, TIMED, Feature, features

ARGS = {"value_count": (6.55,), "sym_looking": (0.1,), "large_sd": (0.2,), "ratio_beyond_rsigma": (1.5,), "binned_entropy": (10,), "quantile": (0.9,), "range_count": (5, 20),
        "autocorr": (2,), "crossing_m": (15,), "peaks": (2,), "imq": (0.5,)}


def _feature(name):
    return Feature(name, None if name == "rows" else "x", *ARGS.get(name, ()), time="ts" if name in TIMED else None)


_W = "PARTITION BY user_id ORDER BY ts"
# group statistics beside every row, and the neighbours in time
_G = f"""(SELECT *, epoch_us(ts) / 1e6 AS t, avg(x) OVER k AS mean, stddev_pop(x) OVER k AS sd, var_pop(x) OVER k AS vr, quantile_cont(x, 0.5) OVER k AS med, count(x) OVER k AS cnt,
   min(x) OVER k AS lo, max(x) OVER k AS hi, lag(x) OVER w AS p, lead(x) OVER w AS n, lead(x, 2) OVER w AS nn, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS dt,
   sum(abs(x)) OVER (w ROWS UNBOUNDED PRECEDING) / sum(abs(x)) OVER k AS part, count(x) OVER (w ROWS UNBOUNDED PRECEDING) AS pos, row_number() OVER w AS r, count(*) OVER k AS m,
   max(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hb, max(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ha
   FROM {GAPS} WINDOW k AS (PARTITION BY user_id), w AS ({_W}))"""
_C = f"(SELECT user_id, x, count(*) AS c FROM {GAPS} WHERE x IS NOT NULL GROUP BY user_id, x)"
_AGG = {  # one aggregate over the prepared rows
    "rows": "count(*)", "miss": "count(*) - count(x)", "strucount": "count(DISTINCT coalesce(CAST(x AS VARCHAR), ''))", "strmin": "min(CAST(x AS VARCHAR))", "strmax": "max(CAST(x AS VARCHAR))",
    "has_dup": "(count(DISTINCT coalesce(CAST(x AS VARCHAR), '')) <> count(x))::INTEGER", "value_count": "count(*) FILTER (x = 6.55)", "ratio_unique": "count(DISTINCT x) / count(x)::DOUBLE",
    "count_above_mean": "count(*) FILTER (x > mean)", "count_below_mean": "count(*) FILTER (x < mean)", "median_ad": "avg(abs(x - med))", "mean_ad": "avg(abs(x - mean))",
    "ratio_beyond_rsigma": "avg(CASE WHEN abs(x - mean) >= 1.5 * sd THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END)", "hmean": "CASE WHEN min(x) = 0 THEN 0 WHEN min(x) > 0 THEN count(x) / sum(1 / x) END",
    "gmean": "CASE WHEN min(x) = 0 THEN 0 WHEN min(x) > 0 THEN exp(avg(ln(x))) END", "abs_energy": "sum(x * x)", "rms": "sqrt(avg(x * x))", "var_gt_sd": "(var_pop(x) > stddev_pop(x))::INTEGER",
    "sym_looking": "(abs(avg(x) - quantile_cont(x, 0.5)) < (max(x) - min(x)) * 0.1)::INTEGER", "large_sd": "(stddev_pop(x) > (max(x) - min(x)) * 0.2)::INTEGER", "quantile": "quantile_cont(x, 0.9)",
    "range_count": "count(*) FILTER (x >= 5 AND x < 20)", "slope": "covar_pop(x, t) / var_pop(t)", "slope_pearson": "corr(x, t)", "slope_pattern": "corr(x, pos)",
    "mean_second_derivative_central": "avg(nn - 2 * n + x)", "mean_change": "avg(n - x)", "mean_abs_change": "avg(abs(n - x))", "abs_sum_changes": "sum(abs(x - p))", "integral": "sum((x + p) / 2 * dt)",
    "firstmin": "(min(t) FILTER (x = lo) - min(t)) / nullif(max(t) - min(t), 0)", "lastmin": "(max(t) FILTER (x = lo) - min(t)) / nullif(max(t) - min(t), 0)",
    "firstmax": "(min(t) FILTER (x = hi) - min(t)) / nullif(max(t) - min(t), 0)", "lastmax": "(max(t) FILTER (x = hi) - min(t)) / nullif(max(t) - min(t), 0)",
    "autocorr": "sum((x - mean) * (nn - mean)) / nullif(max(cnt) - 2, 0) / nullif(max(vr), 0)", "crossing_m": "count(*) FILTER ((x > 15) <> (n > 15))",
    "peaks": "CAST(sum(CASE WHEN r > 2 AND r <= m - 2 THEN CASE WHEN x > greatest(hb, ha) THEN 1 WHEN x <= greatest(hb, ha) THEN 0 END END) AS BIGINT)", "imq": "min(t) FILTER (part >= 0.5) / max(cnt)",
}
_REP = {  # over counts per value
    "repeatdata": "avg(CASE WHEN c > 1 THEN 1.0 ELSE 0.0 END)", "repeatvalues": "sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c)::DOUBLE", "sum_repeatdata": "sum(CASE WHEN c > 1 THEN c * x ELSE 0 END)",
    "sum_repeatvalues": "sum(CASE WHEN c > 1 THEN x ELSE 0 END)", "has_dup_min": "(arg_min(c, x) > 1)::INTEGER", "has_dup_max": "(arg_max(c, x) > 1)::INTEGER",
}
_MODE = f"SELECT user_id, x AS f FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, x) AS q FROM {_C}) WHERE q = 1"
_ENTROPY = f"""SELECT user_id, -sum(p * ln(p)) AS f FROM (SELECT user_id, count(*) / max(cnt)::DOUBLE AS p FROM (SELECT *, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS b FROM {_G} WHERE x IS NOT NULL)
              GROUP BY user_id, b) GROUP BY user_id"""


def _strike(op):
    return f"""SELECT user_id, max(c) AS f FROM (SELECT user_id, g, count(*) FILTER (h) AS c FROM (SELECT *, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS g
               FROM (SELECT *, coalesce(x {op} mean, false) AS h FROM {_G})) GROUP BY user_id, g) GROUP BY user_id"""


_WAVE = """(SELECT user_id, k, sqrt(pow(sum(value * cos(2 * pi() * j * k / n)), 2) + pow(sum(value * sin(2 * pi() * j * k / n)), 2)) AS a FROM (
   SELECT user_id, value, j, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id, k)"""
_CENTRE = f"(SELECT user_id, sum(k * a) / sum(a) AS c FROM {_WAVE} GROUP BY user_id)"
_SPREAD = f"(SELECT user_id, sum(a * pow(k - c, 2)) / sum(a) AS c FROM {_WAVE} JOIN {_CENTRE} USING (user_id) GROUP BY user_id)"


def _sql(name):
    if name == "mode":
        return _MODE
    if name in STATS:
        return f"SELECT user_id, {STAT_SQL[name].format(x='x')} AS f FROM {GAPS} GROUP BY user_id"
    if name in _AGG:
        return f"SELECT user_id, {_AGG[name]} AS f FROM {_G} GROUP BY user_id"
    if name in _REP:
        return f"SELECT user_id, {_REP[name]} AS f FROM {_C} GROUP BY user_id"
    if name in ("meanf", "varf"):
        return f"SELECT user_id, CASE WHEN count(x) = count(*) THEN any_value(c) END AS f FROM {GAPS} JOIN {_CENTRE if name == 'meanf' else _SPREAD} USING (user_id) GROUP BY user_id"
    return {"binned_entropy": _ENTROPY, "longest_strike_above_mean": _strike(">="), "longest_strike_below_mean": _strike("<=")}.get(name)


_EXACT = {"rows", "miss", "count", "ucount", "strucount", "strmin", "strmax", "has_dup", "value_count", "count_above_mean", "count_below_mean", "var_gt_sd", "sym_looking", "large_sd", "range_count",
          "crossing_m", "peaks", "has_dup_min", "has_dup_max", "longest_strike_above_mean", "longest_strike_below_mean"}
_LARGE = {"imq": 2, "integral": 1, "ukurt": 4, "kurt": 4}
for name in FEATURES:
    sql = _sql(name)
    if name == "slope":
        query("groupby2_slope", lambda t: features(t.gaps, "user_id", {"f": _feature("slope")}), sql, "f", 9)
    else:
        query(f"groupby2_{name}", lambda t, n=name: features(t.gaps, "user_id", {"f": _feature(n)}), sql, "" if name in _EXACT else "f", _LARGE.get(name, 5))

# the direct transform; a NULL in the column leaves no spectrum
query("groupby2_meanf_value", lambda t: features(t.events, "user_id", {"f": Feature("meanf", "value", time="ts")}), f"SELECT user_id, c AS f FROM {_CENTRE}", "f", 5)
query("groupby2_varf_value", lambda t: features(t.events, "user_id", {"f": Feature("varf", "value", time="ts")}),
      f"SELECT user_id, c AS f FROM {_SPREAD}", "f", 4)

_TOGETHER = [n for n in FEATURES if n in _AGG and n not in ("strmin", "strmax", "imq", "integral")]
query("groupby2", lambda t: features(t.gaps, "user_id", {n: _feature(n) for n in _TOGETHER}),
      "SELECT user_id, " + ", ".join(f'{_AGG[n]} AS "{n}"' for n in _TOGETHER) + f" FROM {_G} GROUP BY user_id",
      " ".join(n for n in _TOGETHER if n not in _EXACT), 5)
query("groupby2_all", lambda t: features(t.gaps, "user_id", {n: _feature(n) for n in FEATURES}))
query("groupby2_keys", lambda t: features(t.lineitem, "l_returnflag,l_linestatus", {"n": Feature("rows"), "e": Feature("abs_energy", "l_quantity"), "m": Feature("median", "l_extendedprice"),
                                                                                    "u": Feature("ratio_unique", "l_suppkey"), "c": Feature("count_above_mean", "l_quantity"), "s": Feature("strmax", "l_shipdate")}).drop("s"),
      """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity * l_quantity) AS e, quantile_cont(l_extendedprice, 0.5) AS m, count(DISTINCT l_suppkey) / count(*)::DOUBLE AS u,
         count(*) FILTER (l_quantity > a) AS c FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) AS a FROM lineitem) GROUP BY ALL""", "e m u", 5)
