"""Equi, step, interval and row-number joins, products, vector look-ups, concatenation."""

from pyspark.sql import functions as F

from millrace.catalog.registry import GAPS, query
from millrace.operators import joins as j
from millrace.operators import vectors as v


def _rich(t):
    """The customers under twice their key: half of the orders find none, half of them have no order."""
    return t.customer.select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name", "c_mktsegment")


_RICH = "(SELECT c_custkey * 2 AS c_custkey, c_name, c_mktsegment FROM customer)"

query("mjoin", lambda t: j.join(t.orders, _rich(t), "o_custkey", "c_custkey", "c_name,c_mktsegment:segment"),
      f"SELECT o.*, c_name, c_mktsegment AS segment FROM orders o JOIN {_RICH} ON o_custkey = c_custkey")
query("mjoin_n", lambda t: j.join(t.orders, _rich(t), "o_custkey", "c_custkey", "c_name", left=True),
      f"SELECT o.*, c_name FROM orders o LEFT JOIN {_RICH} ON o_custkey = c_custkey")
query("mjoin_N", lambda t: j.join(t.orders.select("o_orderkey", "o_custkey"), _rich(t), "o_custkey", "c_custkey", "c_name", right=True),
      f"SELECT o_orderkey, c_custkey AS o_custkey, c_name FROM orders RIGHT JOIN {_RICH} ON o_custkey = c_custkey")
query("mjoin_nN", lambda t: j.join(t.orders.select("o_orderkey", "o_custkey"), _rich(t), "o_custkey", "c_custkey", "c_name", left=True, right=True),
      f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM orders FULL JOIN {_RICH} ON o_custkey = c_custkey")
query("mnjoin", lambda t: j.natural_join(t.customer, t.supplier, "c_nationkey", "s_nationkey", "s_suppkey,s_name"),
      "SELECT c.*, s_suppkey, s_name FROM customer c JOIN supplier ON c_nationkey = s_nationkey")
query("mnjoin_n", lambda t: j.natural_join(t.part, t.lineitem.withColumn("l_partkey", F.col("l_partkey") * 2), "p_partkey", "l_partkey", "l_orderkey", left=True).select("p_partkey", "l_orderkey"),
      "SELECT p_partkey, l_orderkey FROM part LEFT JOIN (SELECT l_orderkey, l_partkey * 2 AS l_partkey FROM lineitem) ON p_partkey = l_partkey")
query("mnjoin_text", lambda t: j.natural_join(t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).distinct(),
                                              t.benchmark, "text", "text", "item_id").select("doc_id", "item_id"),
      "SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) JOIN benchmark USING (text)")


def _bands(t):
    return t.part.groupBy((F.floor(F.col("p_retailprice") / 10) * 10 + 5).cast("double").alias("floor")).agg(F.min("p_size").alias("p_size"))


_BANDS = "(SELECT floor(p_retailprice / 10) * 10 + 5 AS floor, min(p_size) AS p_size FROM part GROUP BY 1)"

query("mrjoin", lambda t: j.step_join(t.part.select("p_partkey", "p_retailprice"), _bands(t), "p_retailprice", "floor", "p_size:band"),
      f"SELECT p_partkey, p_retailprice, b.p_size AS band FROM part p ASOF JOIN {_BANDS} b ON p_retailprice >= floor")
query("mrjoin_lo", lambda t: j.step_join(t.part.select("p_partkey", "p_retailprice"), _bands(t), "p_retailprice", "floor", "p_size:band", lower_open=True, left=True),
      f"SELECT p_partkey, p_retailprice, b.p_size AS band FROM part p ASOF LEFT JOIN {_BANDS} b ON p_retailprice > floor")
query("mrjoin_k", lambda t: j.step_join(t.events.select("event_id", "user_id", "ts"),
                                        t.events.select("user_id", (F.col("ts") + F.expr("interval 17 minutes")).alias("since"), F.col("event_id").alias("error_id")),
                                        "ts", "since", "since,error_id", "user_id", left=True),
      """SELECT e.event_id, e.user_id, e.ts, s.since, s.error_id FROM events e ASOF LEFT JOIN
         (SELECT user_id, ts + INTERVAL 17 MINUTE AS since, event_id AS error_id FROM events) s ON e.user_id = s.user_id AND e.ts >= s.since""")


def _spans(t):
    """Price ranges per brand; one end is open to infinity where the part is large."""
    return t.part.select(F.col("p_partkey").alias("span"), F.col("p_brand").alias("brand"),
                         F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("low"),
                         F.when(F.col("p_size") < 45, F.col("p_retailprice") + F.col("p_size") / 10).alias("high"))


_SPANS = """(SELECT p_partkey AS span, p_brand AS brand, CASE WHEN p_size > 5 THEN p_retailprice END AS low,
             CASE WHEN p_size < 45 THEN p_retailprice + p_size / 10 END AS high FROM part)"""
_IN = "p_retailprice >= coalesce(low, '-inf'::DOUBLE) AND p_retailprice < coalesce(high, 'inf'::DOUBLE)"
_PARTS = "(SELECT p_partkey, p_brand, p_retailprice FROM part)"


def _parts(t):
    return t.part.select("p_partkey", "p_brand", "p_retailprice")


query("mnrjoin_k", lambda t: j.interval_join(_parts(t), _spans(t), "p_retailprice", "low", "high", "p_brand", "brand", "span"),
      f"SELECT p.*, span FROM {_PARTS} p JOIN {_SPANS} s ON p_brand = brand AND {_IN}")
query("mnrjoin", lambda t: j.interval_join(_parts(t), _spans(t), "p_retailprice", "low", "high", fields="span"),
      f"SELECT p.*, span FROM {_PARTS} p JOIN {_SPANS} s ON {_IN}")
query("mnrjoin_nN", lambda t: j.interval_join(_parts(t), _spans(t).withColumn("high", F.col("low") + 0.05),
                                              "p_retailprice", "low", "high", "p_brand", "brand", "span", closed="(]", left=True, right=True),
      f"""WITH s AS (SELECT span, brand, low, low + 0.05 AS high FROM {_SPANS})
          SELECT p_partkey, coalesce(p_brand, brand) AS p_brand, p_retailprice, span FROM {_PARTS} p FULL JOIN s ON p_brand = brand AND (low IS NULL OR p_retailprice > low) AND (high IS NULL OR p_retailprice <= high)""")
query("mnrcommon", lambda t: j.range_common(_parts(t), _spans(t), "p_retailprice", "low", "high", "p_brand", "brand", "()")[0],
      f"""SELECT * FROM {_PARTS} p WHERE EXISTS (SELECT 1 FROM {_SPANS} WHERE brand = p_brand
          AND (low IS NULL OR p_retailprice > low) AND (high IS NULL OR p_retailprice < high))""")
query("mnrcommon_u", lambda t: j.range_common(_parts(t), _spans(t), "p_retailprice", "low", "high", "p_brand", "brand", "()")[1],
      f"""SELECT * FROM {_PARTS} p WHERE NOT EXISTS (SELECT 1 FROM {_SPANS} WHERE brand = p_brand
          AND (low IS NULL OR p_retailprice > low) AND (high IS NULL OR p_retailprice < high))""")

query("mcommon", lambda t: j.common(t.orders, _rich(t), "o_custkey", "c_custkey")[0], f"SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {_RICH})")
query("mcommon_u", lambda t: j.common(t.orders, _rich(t), "o_custkey", "c_custkey")[1], f"SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_RICH})")
query("mpaste", lambda t: j.paste(t.supplier.select("s_suppkey", "s_name"), t.nation, "s_suppkey", "n_nationkey", "n_name", left=True),
      """SELECT s_suppkey, s_name, n_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier)
         LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) USING (r)""")
query("mpaste_inner", lambda t: j.paste(t.orders.select("o_orderkey"), t.customer.select("c_custkey", "c_acctbal"), "o_orderkey%nr", "c_acctbal,c_custkey"),
      """SELECT o_orderkey, c_custkey, c_acctbal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders)
         JOIN (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) USING (r)""")
query("mproduct", lambda t: j.product(t.supplier.select("s_suppkey"), t.nation, "n_name,n_regionkey:region"),
      "SELECT s_suppkey, n_name, n_regionkey AS region FROM supplier CROSS JOIN nation")
query("mcat", lambda t: j.concat(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
                                 t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id")), t.nation.select(F.lit(-1).alias("id"), F.col("n_name").alias("name"))),
      "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, n_name FROM nation")


# vector look-ups: words of the part names against a list of words
def _words(t):
    w = t.part.select(F.regexp_replace(F.split("p_name", " ")[0], "^[n-z]", "#").alias("word"), "p_size")
    return w.groupBy("word").agg(F.max("p_size").cast("string").alias("most"))


_WORDS = "(SELECT regexp_replace(string_split(p_name, ' ')[1], '^[n-z]', '#') AS word, CAST(max(p_size) AS VARCHAR) AS most FROM part GROUP BY 1)"
_ITEMS = "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)"


def _names(t):
    return t.part.select("p_partkey", "p_name")


def _rebuilt(item, keep="true"):
    return f"""SELECT p.p_partkey, p.p_name, x.v FROM part p LEFT JOIN (SELECT p_partkey, string_agg({item}, ' ' ORDER BY pos) AS v
               FROM {_ITEMS} i LEFT JOIN {_WORDS} w USING (word) WHERE {keep} GROUP BY p_partkey) x USING (p_partkey)"""


query("mvcommon", lambda t: v.vector_common(_names(t), "p_name", _words(t), "word", "v"), _rebuilt("word", "most IS NOT NULL"))
query("mvcommon_r", lambda t: v.vector_common(_names(t), "p_name", _words(t), "word", "v", invert=True), _rebuilt("word", "most IS NULL"))
query("mvjoin", lambda t: v.vector_join(_names(t), "p_name", _words(t), "word", "most", "v", default="none"), _rebuilt("word || ' ' || coalesce(most, 'none')"))
query("mvreplace", lambda t: v.vector_replace(_names(t), "p_name", _words(t), "word", "most", "v", default="none"), _rebuilt("coalesce(most, 'none')"))
