"""Vectors, value rewriting, dates, expression functions."""

from pyspark.sql import functions as F

from millrace.catalog.registry import GAPS, query
from millrace.functions import scalars as sc
from millrace.operators import vectors as v


def _names(t):
    return t.part.select("p_partkey", "p_name", "p_type", "p_size")


_P = "SELECT p_partkey, p_name, p_type, p_size FROM part"
_L = "string_split(p_name, ' ')"

query("msplit", lambda t: v.split_columns(_names(t), "p_name", "a,b,c", drop=True),
      f"SELECT p_partkey, p_type, p_size, {_L}[1] AS a, {_L}[2] AS b, {_L}[3] AS c FROM part")
query("mfsort", lambda t: v.sort_across(t.nation, "n_nationkey,n_regionkey", numeric=True),
      "SELECT least(n_nationkey, n_regionkey) AS n_nationkey, n_name, greatest(n_nationkey, n_regionkey) AS n_regionkey FROM nation")
query("mfsort_r", lambda t: v.sort_across(t.part.select("p_partkey", "p_name", "p_type", "p_brand"), "p_name,p_type,p_brand", reverse=True),
      "SELECT p_partkey, s[1] AS p_name, s[2] AS p_type, s[3] AS p_brand FROM (SELECT p_partkey, list_reverse_sort([p_name, p_type, p_brand]) AS s FROM part)")
query("mtra", lambda t: v.rows_to_vector(t.lineitem, "l_suppkey", "l_orderkey", "l_suppkey"), "SELECT l_orderkey, string_agg(l_suppkey, ' ' ORDER BY l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey")
query("mtra_order", lambda t: v.rows_to_vector(t.conversations, "role", "conv_id", "turn%r", ";"), "SELECT conv_id, string_agg(role, ';' ORDER BY turn DESC) AS role FROM conversations GROUP BY conv_id")
query("mtra_mixed", lambda t: v.rows_to_vector(t.lineitem, "l_linenumber", "l_suppkey", "l_quantity%nr,l_orderkey,l_linenumber"), "SELECT l_suppkey, string_agg(l_linenumber, ' ' ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_suppkey")
query("mtra_r", lambda t: v.vector_to_rows(_names(t), "p_name"), f"SELECT p_partkey, unnest({_L}) AS p_name, p_type, p_size FROM part")
query("mtrafld", lambda t: v.fields_to_vector(t.gaps.select("event_id", "event_type", "user_id", F.col("x").cast("int").alias("x")), "v", "event_type,user_id,x"),
      f"SELECT event_id, concat_ws(' ', 'event_type=' || event_type, 'user_id=' || user_id, 'x=' || CAST(trunc(x) AS INTEGER)) AS v FROM {GAPS}")
query("mtrafld_valOnly", lambda t: v.fields_to_vector(t.gaps.select("event_id", "event_type", F.col("x").cast("int").alias("x")), "v", "event_type,x", ",", values_only=True),
      f"SELECT event_id, concat_ws(',', event_type, CAST(trunc(x) AS INTEGER)) AS v FROM {GAPS}")
query("mtrafld_r", lambda t: v.vector_to_fields(v.fields_to_vector(t.part.select("p_partkey", "p_type", "p_brand"), "v", "p_type,p_brand", ";"), "v", "p_brand,p_type", ";"),
      "SELECT p_partkey, p_brand, p_type FROM part")
query("mtraflg", lambda t: v.flags_to_vector(t.gaps.select("event_id", "event_type", "x"), "v", "event_type,x"),
      f"SELECT event_id, concat_ws(' ', CASE WHEN event_type IS NOT NULL THEN 'event_type' END, CASE WHEN x IS NOT NULL THEN 'x' END) AS v FROM {GAPS}")
query("mtraflg_r", lambda t: v.vector_to_flags(_names(t), "p_name", "red,blue,ring"),
      f"SELECT p_partkey, p_type, p_size, " + ", ".join(f"CASE WHEN list_contains({_L}, '{n}') THEN 1 END AS {n}" for n in ("red", "blue", "ring")) + " FROM part")
query("mvcat", lambda t: v.vector_concat(t.part.select("p_partkey", "p_name", "p_type"), "p_name,p_type", "v"), "SELECT p_partkey, p_name || ' ' || p_type AS v FROM part")
query("mvcount", lambda t: v.vector_count(t.documents.select("doc_id", "text"), "text:n").drop("text"), "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END::INTEGER AS n FROM documents")
query("mvdelim", lambda t: v.vector_delimiter(_names(t), "p_name:v", "-"), f"SELECT p_partkey, p_name, p_type, p_size, replace(p_name, ' ', '-') AS v FROM part")
query("mvdelnull", lambda t: v.vector_drop_empty(t.documents.select("doc_id", "text"), "text", "\n"),
      "SELECT doc_id, nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)), '') AS text FROM documents")
query("mvnullto", lambda t: v.vector_fill_empty(t.documents.select("doc_id", "text"), "text", "-", delim="\n"),
      "SELECT doc_id, CASE WHEN text <> '' THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x = '' THEN '-' ELSE x END), chr(10)) END AS text FROM documents")
query("mvnullto_O", lambda t: v.vector_fill_empty(_names(t), "p_name", "-", other="x"), f"SELECT p_partkey, regexp_replace(p_name, '[^ ]+', 'x', 'g') AS p_name, p_type, p_size FROM part")
query("mvnullto_p", lambda t: v.vector_fill_empty(t.part.select("p_partkey", F.concat_ws(",", "p_type", F.lit(""), "p_brand", F.lit("")).alias("v")), "v", previous=True, delim=","),
      "SELECT p_partkey, p_type || ',' || p_type || ',' || p_brand || ',' || p_brand AS v FROM part")
query("mvsort", lambda t: v.vector_sort(_names(t), "p_name"), f"SELECT p_partkey, array_to_string(list_sort({_L}), ' ') AS p_name, p_type, p_size FROM part")
query("mvsort_nr", lambda t: v.vector_sort(t.part.select("p_partkey", F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.lit("7")).alias("v")), "v", numeric=True, reverse=True),
      "SELECT p_partkey, array_to_string(list_reverse_sort([CAST(p_size AS BIGINT), p_partkey, 7]), ' ') AS v FROM part")
query("mvuniq", lambda t: v.vector_unique(t.benchmark, "text"),
      """SELECT item_id, string_agg(w, ' ' ORDER BY p) AS text FROM (SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w,
         generate_subscripts(string_split(text, ' '), 1) AS p FROM benchmark) GROUP BY item_id, w) GROUP BY item_id""")
query("mvuniq_n", lambda t: v.vector_unique(t.part.select("p_partkey", F.concat_ws(" ", "p_type", "p_type", "p_brand", "p_type").alias("v")), "v", adjacent=True),
      "SELECT p_partkey, p_type || ' ' || p_brand || ' ' || p_type AS v FROM part")

# value rewriting
query("mchgnum", lambda t: sc.change_number(t.part.select("p_partkey", "p_size"), "p_size:label", "MIN,10,30,MAX", "small,middle,large"),
      "SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS label FROM part")
query("mchgnum_r", lambda t: sc.change_number(t.part.select("p_partkey", "p_size"), "p_size:label", "5,10,30", "a,b", other="out", right_closed=True),
      "SELECT p_partkey, p_size, CASE WHEN p_size > 5 AND p_size <= 10 THEN 'a' WHEN p_size > 10 AND p_size <= 30 THEN 'b' ELSE 'out' END AS label FROM part")
query("mchgnum_F", lambda t: sc.change_number(t.part.select("p_partkey", "p_size"), "p_size:label", "5,10", "a", keep=True),
      "SELECT p_partkey, p_size, CASE WHEN p_size >= 5 AND p_size < 10 THEN 'a' ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
query("mchgstr", lambda t: sc.change_text(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F:done,O:open"),
      "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS o_orderstatus FROM orders")
query("mchgstr_F", lambda t: sc.change_text(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus:s", "F:done", keep=True),
      "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS s FROM orders")
query("mchgstr_sub", lambda t: sc.change_text(_names(t), "p_name", "red:RED,ring:RING", other="-", substring=True),
      "SELECT p_partkey, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'ring') THEN replace(replace(p_name, 'red', 'RED'), 'ring', 'RING') ELSE '-' END AS p_name, p_type, p_size FROM part")
query("msed", lambda t: sc.regex_replace(t.documents.select("doc_id", "text"), "text", "([a-z])([aeiou])", "<$2$1>"),
      r"SELECT doc_id, regexp_replace(text, '([a-z])([aeiou])', '<\2\1>') AS text FROM documents")
query("msed_g", lambda t: sc.regex_replace(t.documents.select("doc_id", "text"), "text", "[0-9]+", "[$&]", every=True),
      r"SELECT doc_id, regexp_replace(text, '[0-9]+', '[\0]', 'g') AS text FROM documents")
query("msed_around", lambda t: sc.regex_replace(_names(t), "p_name", " ", "|$`|$'|"),
      f"SELECT p_partkey, {_L}[1] || '|' || {_L}[1] || '|' || {_L}[2] || '|' || {_L}[2] AS p_name, p_type, p_size FROM part")
query("msed_g_around", lambda t: sc.regex_replace(t.part.select("p_partkey", F.concat_ws("-", "p_type", "p_brand", "p_size").alias("v")), "v", "-", "($`)", every=True),
      "SELECT p_partkey, p_type || '(' || p_type || ')' || p_brand || '(' || p_type || '-' || p_brand || ')' || p_size AS v FROM part")
query("mnullto", lambda t: sc.fill_null(t.gaps, "x", -1), f"SELECT event_id, ts, user_id, event_type, value, coalesce(x, -1) AS x FROM {GAPS}")
query("mnullto_O", lambda t: sc.fill_null(t.gaps, "x:f", 0, other=1), f"SELECT *, CASE WHEN x IS NULL THEN 0 ELSE 1 END::DOUBLE AS f FROM {GAPS}")
query("mtonull", lambda t: sc.to_null(t.orders, "o_orderstatus", "F,P"), "SELECT * REPLACE (CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_orderstatus END AS o_orderstatus) FROM orders")
query("mtonull_sub", lambda t: sc.to_null(_names(t), "p_name", "red", substring=True), "SELECT p_partkey, CASE WHEN NOT contains(p_name, 'red') THEN p_name END AS p_name, p_type, p_size FROM part")
query("mdformat", lambda t: sc.format_dates(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/M/d").alias("d")), "d:day", "%Y/%m/%d"),
      "SELECT o_orderkey, year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS d, CAST(o_orderdate AS DATE) AS day FROM orders")
query("mdformat_t", lambda t: sc.format_dates(t.events.select("event_id", F.date_format("ts", "yyMMdd HH:mm:ss.SSSSSS").alias("d")), "d", "%y%m%d %H:%M:%s").select(
    "event_id", sc.format_time(F.col("d"), True).alias("d")), "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S.%f') AS d FROM events")

# expression functions
query("mcal", lambda t: t.lineitem.select("l_orderkey", "l_quantity", (F.col("l_quantity") * 2 - F.pow("l_tax", F.lit(2)) / 4).alias("a"), F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("b"),
                                         (F.col("l_extendedprice") - F.floor("l_extendedprice")).alias("fract"), F.greatest("l_tax", "l_discount").alias("c")),
      """SELECT l_orderkey, l_quantity, l_quantity * 2 - pow(l_tax, 2) / 4 AS a, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS b, l_extendedprice - floor(l_extendedprice) AS fract,
         greatest(l_tax, l_discount) AS c FROM lineitem""", "a fract")
query("mcal_math", lambda t: t.gaps.select("event_id", F.abs("x").alias("a"), F.log("x").alias("l"), F.exp(F.col("x") / 1000).alias("e"), F.sqrt("x").alias("s"), F.col("x").isNull().alias("n")),
      f"SELECT event_id, abs(x) AS a, ln(x) AS l, exp(x / 1000) AS e, sqrt(x) AS s, x IS NULL AS n FROM {GAPS}", "l e s")
query("mcal_regex", lambda t: t.documents.select("doc_id", F.col("text").rlike("^[A-Z]").alias("m"), F.regexp_extract("text", "[0-9]+", 0).alias("x")),
      "SELECT doc_id, regexp_matches(text, '^[A-Z]') AS m, regexp_extract(text, '[0-9]+') AS x FROM documents")
query("mcal_number", lambda t: t.documents.select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")).select("doc_id", sc.number(F.col("w")).alias("v")).filter("v is not null"),
      r"""SELECT doc_id, CAST(w AS DOUBLE) AS v FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)
          WHERE regexp_matches(w, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')""")
query("mcal_time", lambda t: t.events.select("event_id", sc.epoch(sc.parse_time(sc.format_time(F.col("ts"), True))).alias("u"), sc.format_day(F.col("ts")).alias("d")),
      "SELECT event_id, epoch_us(ts) / 1e6 AS u, strftime(ts, '%Y%m%d') AS d FROM events")
