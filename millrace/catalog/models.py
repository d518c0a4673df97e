"""Preprocessing, models, prediction, evaluation."""

from pyspark.sql import functions as F

from millrace.catalog.registry import query
from millrace.operators import ml

X = "l_quantity,l_extendedprice,l_discount,l_tax"


def _rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", *X.split(","), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("flag"),
                             (F.col("l_quantity") > 25).cast("int").alias("big"))


query("normalize", lambda t: ml.min_max(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal:s"),
      "SELECT c_custkey, c_acctbal, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS s FROM customer", "s", 7)
query("standardize", lambda t: ml.standardize(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal:s"),
      "SELECT c_custkey, c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS s FROM customer", "s", 7)
query("label_encode", lambda t: ml.label_encode(t.customer, "c_mktsegment", "code"), "SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
query("one_hot_encode", lambda t: ml.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus"),
      "SELECT o_orderkey, o_orderstatus, " + ", ".join(f"(o_orderstatus = '{s}')::INTEGER AS \"o_orderstatus_{s}\"" for s in "FOP") + " FROM orders")
query("pca", lambda t: ml.pca(_rows(t), X).select("l_orderkey", "pc1", "pc2"))
query("pca_spread", lambda t: ml.pca(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity,l_extendedprice").agg((F.var_samp("pc1") + F.var_samp("pc2")).alias("v"), F.abs(F.avg("pc1")).alias("m")),
      "SELECT var_samp(l_quantity) + var_samp(l_extendedprice) AS v, 0.0::DOUBLE AS m FROM lineitem", "v m", 2)
query("selecttargetcolumn", lambda t: ml.select_target(t.labels, "quality"), "SELECT doc_id, quality AS target, toxic FROM labels")


def _classify(kind, target="big", **params):
    def run(t):
        model = ml.train(_rows(t), kind, X, target, **params)
        return ml.confusion(ml.predict(model, _rows(t), X), target, "prediction")
    return run


def _regress(kind, **params):
    def run(t):
        x = "l_quantity,l_discount,l_tax"
        return ml.evaluate_numbers(ml.predict(ml.train(_rows(t), kind, x, "l_extendedprice", **params), _rows(t), x), "l_extendedprice", "prediction")
    return run


query("klogreg", _classify("logistic_regression", regParam=0.01, balanced=True))
query("kdt_classifier", _classify("decision_tree_classifier", "flag", maxDepth=3))
query("krf_classifier", _classify("random_forest_classifier", "flag", numTrees=5, maxDepth=3))
query("kbag_classifier", _classify("bagging_classifier", "flag", numTrees=5, maxDepth=3))
query("kgb_classifier", _classify("gradient_boosting_classifier", maxIter=3, maxDepth=2))
query("kgaussian_nb", _classify("gaussian_naive_bayes", "flag"))
query("ksvm", _classify("linear_svm", maxIter=10))
query("kneuralnet", _classify("neural_network", layers=[4, 5, 2], maxIter=10))
query("kab", lambda t: ml.confusion(ml.predict(ml.boost(_rows(t), X, "flag", 3, rounds=2, depth=2), _rows(t), X), "flag", "prediction"))
query("kdt_regressor", _regress("decision_tree_regressor", maxDepth=3))
query("krf_regressor", _regress("random_forest_regressor", numTrees=5, maxDepth=3))
query("kbag_regressor", _regress("bagging_regressor", numTrees=5, maxDepth=3))
query("kgb_regressor", _regress("gradient_boosting_regressor", maxIter=3, maxDepth=2))
query("kridge", _regress("ridge"))
query("klasso", _regress("lasso"))
query("kelastic", _regress("elastic_net"))
query("kkmeans", lambda t: ml.predict(ml.train(t.embeddings, "k_means", "embedding", k=8, maxIter=20), t.embeddings, "embedding", name="cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


def _line(t):
    model = ml.train(t.lineitem, "linear_regression", "l_quantity", "l_extendedprice")
    return ml.predict(model, t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


query("klinreg", _line, """SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem)
      AS prediction FROM lineitem""", "prediction", 2)
_DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)))"
_NEAR = f"""(SELECT * FROM (SELECT a.vec_id, b.label::DOUBLE AS y, {_DIST} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, y) <= 5)"""
query("knearest_neighbors_classifier", lambda t: ml.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, skip_self="vec_id"),
      f"SELECT vec_id, y AS prediction FROM (SELECT vec_id, y, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, y) AS r FROM {_NEAR} GROUP BY vec_id, y) WHERE r = 1")
query("knearest_neighbors_regressor", lambda t: ml.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, regression=True, skip_self="vec_id"),
      f"SELECT vec_id, avg(y) AS prediction FROM {_NEAR} GROUP BY vec_id", "prediction")
query("knearest_neighbors_by_distance", lambda t: ml.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, regression=True, by_distance=True, skip_self="vec_id"),
      f"SELECT vec_id, sum(y / sqrt(d)) / sum(1 / sqrt(d)) AS prediction FROM {_NEAR} GROUP BY vec_id", "prediction")
_BLOCKS = _NEAR.replace("pow(z[1]::DOUBLE - z[2]::DOUBLE, 2)", "abs(z[1]::DOUBLE - z[2]::DOUBLE)")
query("knearest_neighbors_p1", lambda t: ml.knn(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, regression=True, p=1.0, skip_self="vec_id"),
      f"SELECT vec_id, avg(y) AS prediction FROM {_BLOCKS} GROUP BY vec_id", "prediction")
query("cross_validation", lambda t: ml.cross_validate(_rows(t), "decision_tree_classifier", X, "flag", 2, maxDepth=3))
query("predict_probability", lambda t: ml.predict(ml.train(_rows(t), "gaussian_naive_bayes", X, "flag"), _rows(t), X, probabilities=3).agg(
    F.count(F.lit(1)).alias("n"), F.avg(F.col("probability_0") + F.col("probability_1") + F.col("probability_2")).alias("p")), "SELECT count(*) AS n, 1.0::DOUBLE AS p FROM lineitem", "p")


# evaluation of a fixed rule, so that SQL can follow
def _guess(t):
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("z"), "l_quantity", "l_linenumber", (F.col("l_quantity") / 51).alias("p"))


_G = "(SELECT (l_returnflag = 'R')::INTEGER AS y, (l_quantity > 25)::INTEGER AS z, l_quantity, l_linenumber, l_quantity / 51 AS p FROM lineitem)"
query("evaluate_accuracy", lambda t: ml.evaluate_classes(_guess(t), "y", "z"),
      f"SELECT count(*) AS rows, avg((y = z)::INTEGER) AS accuracy, 1 - avg((y = z)::INTEGER) AS hamming FROM {_G}", "accuracy hamming")
query("evaluate_confusion", lambda t: ml.confusion(_guess(t), "y", "z"), f"SELECT y AS label, z AS prediction, count(*) AS count FROM {_G} GROUP BY ALL")
query("evaluate_report", lambda t: ml.class_report(_guess(t), "y", "z"),
      f"""SELECT l AS label, count(*) FILTER (y = l AND z = l) / count(*) FILTER (z = l)::DOUBLE AS precision, count(*) FILTER (y = l AND z = l) / count(*) FILTER (y = l)::DOUBLE AS recall,
          2.0::DOUBLE * count(*) FILTER (y = l AND z = l) / (count(*) FILTER (z = l) + count(*) FILTER (y = l)) AS f1, count(*) FILTER (y = l) AS support FROM {_G}, (SELECT unnest([0, 1]) AS l) GROUP BY l""",
      "precision recall f1")
query("evaluate_log_loss", lambda t: ml.log_loss(_guess(t).withColumn("q", 1 - F.col("p")), "y", ["q", "p"]), f"SELECT -avg(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS log_loss FROM {_G}", "log_loss")
query("evaluate_regression", lambda t: ml.evaluate_numbers(_guess(t), "l_linenumber", "l_quantity"),
      f"""SELECT avg(abs(l_linenumber - l_quantity)) AS mae, avg(pow(l_linenumber - l_quantity, 2)) AS mse, avg(pow(ln(1 + l_linenumber) - ln(1 + l_quantity), 2)) AS msle,
          quantile_cont(abs(l_linenumber - l_quantity), 0.5) AS median_ae FROM {_G}""", "mae mse msle median_ae")
