"""Preprocessing, Spark ML models, prediction and evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as FT
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spec import expand, ident, renames
from millrace.plans.ordered import RN, join_spread, number_rows, quantiles, totals, with_row
from millrace.session import cut_lineage

FEATURES, LABEL = "__features", "__label"


def min_max(df: DataFrame, fields) -> DataFrame:
    """Scale columns to 0..1; a constant column becomes 0."""
    pairs = renames(fields)
    aggs = {f"__{n}_{s}": f(ident(s)) for s in pairs for n, f in (("lo", F.min), ("hi", F.max))}
    out = totals(df, None, aggs)
    scaled = lambda s: F.coalesce(F.try_divide(ident(s).cast("double") - ident(f"__lo_{s}"), ident(f"__hi_{s}") - ident(f"__lo_{s}")), F.when(ident(s).isNotNull(), F.lit(0.0)))
    return out.withColumns({d: scaled(s) for s, d in pairs.items()}).drop(*aggs)


def standardize(df: DataFrame, fields) -> DataFrame:
    """Subtract the mean and divide by the population standard deviation; a constant column becomes 0."""
    pairs = renames(fields)
    aggs = {f"__{n}_{s}": f(ident(s)) for s in pairs for n, f in (("m", F.avg), ("d", F.stddev_pop))}
    out = totals(df, None, aggs)
    scaled = lambda s: F.coalesce(F.try_divide(ident(s).cast("double") - ident(f"__m_{s}"), ident(f"__d_{s}")), F.when(ident(s).isNotNull(), F.lit(0.0)))
    return out.withColumns({d: scaled(s) for s, d in pairs.items()}).drop(*aggs)


def label_encode(df: DataFrame, field: str, name: str) -> DataFrame:
    """Number the sorted distinct values from 0; any number of values."""
    values = number_rows(df.filter(ident(field).isNotNull()).select(ident(field)).distinct(), None, [field])
    return join_spread(df, values.select(ident(field), (F.col(RN) - 1).alias(name)), [field])


def one_hot(df: DataFrame, field: str, values=None) -> DataFrame:
    """One 0/1 column per value, named ``field_value``."""
    from millrace.operators.pivots import _named, _values

    found = [v for v in _values(df, field, values) if v is not None]
    return df.withColumns({f"{field}_{n}": F.coalesce((ident(field) == F.lit(v)).cast("int"), F.lit(0)) for v, n in zip(found, _named(found))})


def assemble(df: DataFrame, fields, target: str | None = None) -> DataFrame:
    """Feature vector (and double label); rows with a NULL are left out. An array column is used as it is."""
    names = expand(df, fields)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, T.ArrayType):
        out = df.withColumn(FEATURES, array_to_vector(ident(names[0]).cast("array<double>")))
    else:
        out = FT.VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="skip").transform(df)
    if target is not None:
        out = out.filter(ident(target).isNotNull()).withColumn(LABEL, ident(target).cast("double"))
    return out


def pca(df: DataFrame, fields, k: int = 2, prefix: str = "pc") -> DataFrame:
    """Principal components of the centred columns."""
    data = assemble(df, fields)
    pipe = Pipeline(stages=[FT.StandardScaler(withMean=True, withStd=False, inputCol=FEATURES, outputCol="__centred"),
                            FT.PCA(k=k, inputCol="__centred", outputCol="__pc")])
    out = pipe.fit(data).transform(data).withColumn("__a", vector_to_array("__pc"))
    return out.withColumns({f"{prefix}{i + 1}": F.get("__a", F.lit(i)) for i in range(k)}).drop(FEATURES, "__centred", "__pc", "__a")


def select_target(df: DataFrame, field: str, name: str = "target") -> DataFrame:
    return df.withColumnRenamed(field, name)


def estimator(kind: str, seed: int = 0, **params):
    """A Spark ML estimator by name."""
    io = {"featuresCol": FEATURES, "labelCol": LABEL}
    seeded = {**io, "seed": seed}
    bagged = {"featureSubsetStrategy": "all", "subsamplingRate": 1.0, **seeded}
    table = {
        "logistic_regression": lambda: C.LogisticRegression(**io, **params),
        "decision_tree_classifier": lambda: C.DecisionTreeClassifier(**seeded, **params),
        "decision_tree_regressor": lambda: R.DecisionTreeRegressor(**seeded, **params),
        "random_forest_classifier": lambda: C.RandomForestClassifier(**seeded, **params),
        "random_forest_regressor": lambda: R.RandomForestRegressor(**seeded, **params),
        "bagging_classifier": lambda: C.RandomForestClassifier(**{**bagged, **params}),
        "bagging_regressor": lambda: R.RandomForestRegressor(**{**bagged, **params}),
        "gradient_boosting_classifier": lambda: C.GBTClassifier(**seeded, **params),
        "gradient_boosting_multiclass": lambda: C.OneVsRest(classifier=C.GBTClassifier(**seeded, **params), **io),
        "gradient_boosting_regressor": lambda: R.GBTRegressor(**seeded, **params),
        "gaussian_naive_bayes": lambda: C.NaiveBayes(modelType="gaussian", **io, **params),
        "linear_svm": lambda: C.LinearSVC(**io, **params),
        "linear_svm_multiclass": lambda: C.OneVsRest(classifier=C.LinearSVC(**io, **params), **io),
        "neural_network": lambda: C.MultilayerPerceptronClassifier(**seeded, **params),
        "linear_regression": lambda: R.LinearRegression(**io, **params),
        "ridge": lambda: R.LinearRegression(elasticNetParam=0.0, **{"regParam": 1.0, **io, **params}),
        "lasso": lambda: R.LinearRegression(elasticNetParam=1.0, **{"regParam": 1.0, **io, **params}),
        "elastic_net": lambda: R.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.5, **io, **params}),
        "k_means": lambda: K.KMeans(featuresCol=FEATURES, seed=seed, **{"k": 8, "maxIter": 300, **params}),
    }
    if kind not in table:
        raise ValueError(f"unknown model {kind!r}; have {sorted(table)}")
    return table[kind]()


TRAIN_ROWS = 1 << 20  # training rows of one partition, beyond twice as many
KEPT = ("gradient_boosting_classifier", "gradient_boosting_multiclass", "gradient_boosting_regressor")


def _in_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, large input in partitions of bounded size. Boosting keeps its rows as objects, several times over, and
    reads them in every round, a partition per task; they are far larger than in the files whose splits would give the
    partitions. The whole row says where it goes, so that rows alike in the columns are not all sent to one."""
    rows, kept = df.count(), [ident(c) for c in columns]
    if rows <= 2 * TRAIN_ROWS:
        return df.select(*kept)
    values = [ident(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.select(*kept, F.xxhash64(*values).alias("__to")).repartition(-(-rows // TRAIN_ROWS), "__to").drop("__to")


def train(df: DataFrame, kind: str, fields, target: str | None = None, seed: int = 0, balanced: bool = False, **params):
    """Fit a model. ``balanced`` weighs classes by the inverse of their frequency."""
    if kind in KEPT:
        used = [*expand(df, fields), *([target] if target is not None else []), *[v for v in params.values() if isinstance(v, str) and v in df.columns]]
        df = _in_parts(df, list(dict.fromkeys(used)))
    data = assemble(df, fields, target)
    if balanced:
        counts = totals(data, [LABEL], {"__n": F.count(F.lit(1))})
        one = counts.agg(F.count(F.lit(1)).alias("__all"), F.count_distinct(LABEL).alias("__classes"))
        data = with_row(counts, one).withColumn("__weight", F.col("__all") / (F.col("__classes") * F.col("__n")))
        params["weightCol"] = "__weight"
    return estimator(kind, seed, **params).fit(data)


def predict(model, df: DataFrame, fields, probabilities: int = 0, name: str = "prediction") -> DataFrame:
    """Append the prediction and, if asked for, one probability column per class."""
    out = model.transform(assemble(df, fields))
    if probabilities:
        out = out.withColumn("__p", vector_to_array("probability"))
        out = out.withColumns({f"probability_{i}": F.get("__p", F.lit(i)) for i in range(probabilities)})
    extra = [name, *[f"probability_{i}" for i in range(probabilities)]]
    return out.withColumnRenamed("prediction", name).select(*[ident(c) for c in df.columns], *extra)


def save_model(model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]


class BoostedTrees:
    """AdaBoost (SAMME): rounds of weighted trees, each round weighing its mistakes more."""

    def __init__(self, trees: list, weights: list[float], classes: int):
        self.trees, self.weights, self.classes = trees, weights, classes

    def transform(self, df: DataFrame) -> DataFrame:
        votes = [F.lit(0.0)] * self.classes
        for i, (tree, w) in enumerate(zip(self.trees, self.weights)):
            df = tree.transform(df).withColumnRenamed("prediction", f"__h{i}").drop("rawPrediction", "probability")
            votes = [v + F.when(F.col(f"__h{i}") == c, F.lit(w)).otherwise(0.0) for c, v in enumerate(votes)]
        score = F.array(*votes)
        best = (F.array_position(score, F.array_max(score)) - 1).cast("double")
        return df.withColumn("prediction", best).drop(*[f"__h{i}" for i in range(len(self.trees))])


def boost(df: DataFrame, fields, target: str, classes: int, rounds: int = 10, depth: int = 1, seed: int = 0) -> BoostedTrees:
    """Fit AdaBoost; each round reads the persisted input and reweighs it by the trees so far."""
    data = assemble(df, fields, target).select(FEATURES, LABEL).persist()
    trees, weights, weight = [], [], F.lit(1.0)
    try:
        current = data.withColumn("__weight", weight)
        for i in range(rounds):
            tree = C.DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="__weight", maxDepth=depth, seed=seed + i).fit(current)
            wrong = tree.transform(current).select(FEATURES, LABEL, "__weight", (F.col("prediction") != F.col(LABEL)).alias("__wrong"))
            miss, total = wrong.agg(F.sum(F.when(F.col("__wrong"), F.col("__weight")).otherwise(0.0)), F.sum("__weight")).first()
            err = miss / total
            if err >= 1 - 1 / classes:
                break
            alpha = math.log((1 - err) / err) + math.log(classes - 1) if err > 0 else 50.0
            trees.append(tree)
            weights.append(alpha)
            if err == 0:
                break
            factor = F.when(F.col("__wrong"), F.lit(math.exp(alpha))).otherwise(1.0)
            current = wrong.withColumn("__weight", F.col("__weight") * factor / total).drop("__wrong")
    finally:
        data.unpersist()
    return BoostedTrees(trees, weights, classes)


POINTS = 16_384  # rows of one block of either side of a neighbour search
TILE = 1 << 23  # distances that are held at a time
STEPS = 63  # a coordinate as a small integer, of which four add up to a byte
TASKS = 2_000  # most tasks of a search
PIVOTS, SAMPLE = 128, 2_048
MOST_BLOCKS = 100_000  # blocks that the index lists; larger tables get larger blocks


def _distances(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """All distances of some rows to others, as many rows at a time as fit 64 MB."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 23) // max(y.size, 1))
    for lo in range(0, len(x), step):
        out[lo:lo + step] = (np.abs(y[None] - x[lo:lo + step, None]) ** p).sum(axis=2) ** (1 / p)
    return out


def _pivots(sample: np.ndarray, n: int, p: float) -> np.ndarray:
    """Points of a sample far from each other: the first, then always the one farthest from those taken."""
    if not len(sample):
        return sample
    taken, far = [0], _distances(sample, sample[:1], p)[:, 0]
    while len(taken) < n and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[taken[-1:]], p)[:, 0])
    return sample[taken]


def _estimates(x: np.ndarray, y: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """All distances of some rows to others, to the power of p, and how far each row's may be off: products of matrices
    for p = 2, sums in single precision for p = 1. Coordinates count from a point near to both."""
    d = x.shape[1]
    if p == 2 and np.isfinite(x).all() and np.isfinite(y).all():
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        out = x @ (-2 * y.T)
        out += yy
        out += xx[:, None]
        return out, 1e-14 * (d + 64) * (xx + yy.max())
    if p == 1 and np.isfinite(x).all() and np.isfinite(y).all() and max(np.abs(x).max(), np.abs(y).max()) < 1e30:
        slack = 2.4e-7 * (d + 8) * (np.abs(x).sum(1) + np.abs(y).sum(1).max())
        x, y, out = np.ascontiguousarray(x.T, np.float32), np.ascontiguousarray(y.T, np.float32), np.zeros((len(x), len(y)), np.float32)
        high, wide = 32, 1024  # a tile stays in a core's cache while the dimensions are added up
        part = np.empty((high, wide), np.float32)
        for i in range(0, out.shape[0], high):
            for j in range(0, out.shape[1], wide):
                tile = out[i:i + high, j:j + wide]
                held = part[:tile.shape[0], :tile.shape[1]]
                for a, b in zip(x[:, i:i + high], y[:, j:j + wide]):
                    np.subtract(a[:, None], b, out=held)
                    np.abs(held, out=held)
                    tile += held
        return out, slack
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 23) // max(y.size, 1))
    for lo in range(0, len(x), step):
        out[lo:lo + step] = (np.abs(y[None] - x[lo:lo + step, None]) ** p).sum(axis=2)
    return out, np.full(len(x), 1e-12) * np.nan_to_num(out, posinf=0).max(1, initial=0)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of equal codes: indexes of both sides."""
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b, a, side, sorter=order) for side in ("left", "right"))
    row = np.repeat(np.arange(len(a)), hi - lo)
    return row, order[np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]]


def _candidates(x: np.ndarray, y: np.ndarray, bound: np.ndarray, own: tuple, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, but those of ``own``, that may be among the k nearest of a row within its bound."""
    e, off = _estimates(x, y, p)
    e[own] = np.inf
    limit = bound ** p + off
    open_ = e <= limit[:, None]
    many = np.flatnonzero(open_.sum(1) > 4 * k)
    if len(many) and k < len(y):
        most = np.partition(e[many], k - 1, 1)[:, k - 1] + 2 * off[many]
        open_[many] = e[many] <= np.minimum(limit[many], most)[:, None]
    open_[own] = False
    return np.nonzero(open_)


def _candidates_p1(x: np.ndarray, y: np.ndarray, bound: np.ndarray, own: tuple, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``_candidates`` for p = 1, from coordinates rounded to small integers; None where they do not suit.

    |a - b| is 2 max(a, b) - a - b, so two operations on bytes per coordinate give the distances of the rounded rows. A
    distance differs from that by what rounding took from both rows at most, which is added up exactly for each row.
    """
    d = x.shape[1]
    top = min(STEPS, 32_000 // max(d, 1))
    if top < 15 or not len(x) or not len(y) or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return None
    some = y[::max(1, len(y) // 512)]
    centre = np.median(some, 0)
    usual = np.abs(some - centre)
    step = 9 * (np.median(usual) or usual.mean()) / top  # for a bell curve, three deviations to either side; what lies outside is rounded far
    if not 1e-300 < step or not max(np.abs(x).max(), np.abs(y).max()) < 1e8 * step:
        return None

    def rounded(rows):
        z = (rows - centre) / step + top / 2
        q = np.clip(np.rint(z), 0, top)
        return np.ascontiguousarray(q.T, np.uint8), q.sum(1), np.abs(z - q).sum(1) + 1e-6 * (d + 1)

    (a, xs, xoff), (b, ys, yoff) = rounded(x), rounded(y)
    wild = yoff > 1e4  # too far out for the sums below: compared with all, and so are such rows of ``x``
    if max(wild.mean(), (xoff > 1e4).mean()) > 0.01:
        return None
    yoff = np.minimum(yoff, 1e4)
    e = np.empty((len(x), len(y)), np.int16)  # sums of maxima less (ys + yoff) / 2: distances count double in them
    e[:] = -((ys + yoff) / 2).astype(np.int16)[None]
    high, wide = 64, 2048  # a tile stays in a core's cache while the dimensions are added up
    held, four = np.empty((2, high, wide), np.uint8)
    for i in range(0, len(x), high):
        for j in range(0, len(y), wide):
            tile = e[i:i + high, j:j + wide]
            one, some = held[:tile.shape[0], :tile.shape[1]], four[:tile.shape[0], :tile.shape[1]]
            for n in range(d):
                to = one if n % 4 else some
                np.maximum(a[n, i:i + high, None], b[n, j:j + wide], out=to)
                if n % 4:
                    np.add(some, one, out=some)
                if n % 4 == 3 or n == d - 1:
                    np.add(tile, some, out=tile)
    e[:, wild] = np.iinfo(np.int16).min
    e[own] = np.iinfo(np.int16).max
    within = lambda far: np.minimum(np.ceil((far + xs + xoff) / 2) + 2, 32_766).astype(np.int16)
    limit = within(np.minimum(bound / step, 1e6) * (1 + 1e-9))
    open_ = e <= limit[:, None]
    many = np.flatnonzero(open_.sum(1) > 16 * k)
    if len(many) and k < len(y):
        usual = np.flatnonzero(yoff <= np.percentile(yoff, 90))
        if k <= len(usual):
            least = np.partition(e[np.ix_(many, usual)], k - 1, 1)[:, k - 1].astype(float)
            most = 2 * least - xs[many] + xoff[many] + 2 * yoff[usual].max() + 4  # no less than the distance to the k-th
            far = np.full(len(x), 1e6)
            far[many] = np.where(least < 32_000, most, 1e6)
            limit = np.minimum(limit, within(far))
            open_[many] = e[many] <= limit[many][:, None]
    open_[own] = False
    return np.nonzero(open_) if open_.sum() <= max(0.05 * open_.size, 64 * k * len(x)) else None  # else single precision leaves fewer


def _nearest(x: np.ndarray, y: np.ndarray, pivot: np.ndarray, bound: np.ndarray, labels: np.ndarray, same: tuple | None, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, distance and label of the k nearest of ``y`` for each row of ``x``, within its bound; the smaller label first
    at equal distance. Estimates leave few candidates, and those are compared by their distances. ``same``: codes of
    both sides' rows; rows of equal code are no neighbours."""
    own = (np.zeros(0, int),) * 2 if same is None else _equal(*same)
    found = _candidates_p1(x, y, bound, own, k) if p == 1 else None
    row, other = found if found is not None else _candidates(x - pivot, y - pivot, bound, own, k, p)
    d = np.empty(len(row))
    for lo in range(0, len(row), 1 << 16):
        d[lo:lo + (1 << 16)] = (np.abs(y[other[lo:lo + (1 << 16)]] - x[row[lo:lo + (1 << 16)]]) ** p).sum(axis=1) ** (1 / p)
    order = np.lexsort((labels[other], d, row))
    row, other, d = row[order], other[order], d[order]
    kept = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(d)
    return row[kept], d[kept], labels[other[kept]]


def _chain(pivots: np.ndarray, p: float) -> list[int]:
    """The pivots in an order where each is followed by the nearest one left."""
    left, out = list(range(len(pivots))), []
    while left:
        at = int(_distances(pivots[out[-1:]], pivots[left], p).argmin()) if out else 0
        out.append(left.pop(at))
    return out


class _Rings:
    """Blocks of an index as arrays: which pivot, between which distances from it; and the rows next to each pivot."""

    def __init__(self, pivots: np.ndarray, p: float, k: int, blocks: list, near: list):
        self.pivots, self.p, self.k = pivots, p, k
        self.cell, self.sub, self.inner, self.outer, self.sizes = (np.array([r[i] for r in blocks], float if i in (2, 3) else int) for i in range(5))
        self.near_cell, self.near_r = np.array([r[0] for r in near], int), np.array([r[1] for r in near], float)
        self.group = np.zeros(len(blocks), int)

    def gather(self, points: int) -> None:
        """Put small blocks of pivots near each other into groups of ``points`` rows: a row goes to a group once."""
        place = np.empty(len(self.pivots), int)
        place[_chain(self.pivots, self.p)] = np.arange(len(self.pivots))
        order = np.lexsort((self.sub, place[self.cell]))
        ends = np.cumsum(self.sizes[order])
        self.group[order] = np.unique((ends - 1) // points, return_inverse=True)[1]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: an upper bound of the distance to its k-th neighbour, and a lower bound for every block."""
        d = _distances(x, self.pivots, self.p)
        reach = d[:, self.near_cell] + self.near_r
        upper = np.partition(reach, self.k - 1, 1)[:, self.k - 1] if 0 < self.k <= reach.shape[1] else np.full(len(x), np.inf)
        own = d[:, self.cell]
        return upper, np.maximum(np.maximum(own - self.outer, self.inner - own), (own - d.min(1)[:, None]) / 2)


class NeighbourIndex:
    """An exact index of reference rows for a metric: rows go to their nearest pivot, and in rings around it into blocks.

    Distances to pivots bound the distance to every row of a block from below (triangle inequality: by the ring's inner
    and outer radius, and by half the difference of the distances to both pivots, since the row is nearest to its own),
    and the rows next to each pivot bound the distance to the k-th neighbour from above. A search looks into a row's
    nearest block first. Rows whose bound is still open then look into every other block whose lower bound is not above
    it. Pivots come from a bounded sample; any choice gives the same neighbours.
    """

    def __init__(self, rows: DataFrame, k: int, p: float, pivots: int = PIVOTS):
        """``rows``: __own, __v (array<double>), __y. ``k``: the row whose distance bounds a search from above, 0 for none."""
        if p < 1:
            raise ValueError("p has to be 1 or more: below, distances keep no triangle inequality")
        self.p, self.spark = p, rows.sparkSession
        sample = [r["__v"] for r in rows.select("__v").orderBy(F.xxhash64("__v"), "__v").limit(SAMPLE).collect()]
        self.pivots = _pivots(np.array(sample) if sample else np.zeros((0, 1)), pivots, p)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        assigned = cut_lineage(self._assign(rows.repartition(parts)))  # a file's splits may be few or uneven
        self.points = max(POINTS, -(-assigned.count() // MOST_BLOCKS))
        ringed = number_rows(assigned, ["__cell"], ["__r", "__v", "__y"], name="__i")
        self.rows = cut_lineage(ringed.withColumn("__sub", F.floor((F.col("__i") - 1) / self.points).cast("int")))
        blocks = self.rows.groupBy("__cell", "__sub").agg(F.min("__r"), F.max("__r"), F.count("*")).orderBy("__cell", "__sub").collect()  # MOST_BLOCKS and one per pivot
        near = self.rows.where(F.col("__i") <= k).select("__cell", "__r").collect()  # k per pivot
        self.rings = _Rings(self.pivots, p, k, blocks, near)
        self.rings.gather(self.points)

    def _assign(self, rows: DataFrame) -> DataFrame:
        """The rows with __cell, their nearest pivot, and __r, their distance to it."""
        pivots, p = self.pivots, self.p
        schema = T.StructType([*rows.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__r", T.DoubleType())])

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    d = _distances(np.stack(pdf["__v"].to_list()), pivots, p)
                    pdf["__cell"], pdf["__r"] = d.argmin(1).astype(np.int32), d.min(1)
                    yield pdf

        return rows.where("__v IS NOT NULL").mapInPandas(run, schema)

    def pairs(self, queries: DataFrame, first: bool) -> DataFrame:
        """__key, __v, __bound with the __cell and __sub of the blocks to look into. ``first``: the nearest block;
        otherwise all others that may hold a neighbour within ``__bound``."""
        return self._asked(queries, first, "__cell", "__sub")

    def parcels(self, queries: DataFrame, first: bool) -> DataFrame:
        """__key, __v, __bound with the __group of blocks to look into. ``first``: the nearest block's; otherwise all
        others with a block that may hold a neighbour within ``__bound``."""
        return self._asked(queries, first, "__group")

    def _asked(self, queries: DataFrame, first: bool, *names: str) -> DataFrame:
        index = self.spark.sparkContext.broadcast(self.rings)
        kept = [queries.schema["__key"], queries.schema["__v"], T.StructField("__bound", T.DoubleType())]
        schema = T.StructType([*kept, *[T.StructField(n, T.IntegerType()) for n in names]])

        def run(batches):
            rings = index.value
            places = np.stack([getattr(rings, n[2:]) for n in names], 1)
            _, place = np.unique(places, axis=0, return_inverse=True)  # what a row goes to: a block, or a group of them
            place = place.ravel()
            where = np.zeros((int(place.max(initial=-1)) + 1, len(names)), np.int32)
            where[place] = places
            by_place = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[by_place], np.arange(len(where)))
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo:lo + 256]
                    if not len(place):
                        continue
                    upper, lower = rings.bounds(np.stack(part["__v"].to_list()))
                    rows, best = np.arange(len(part)), place[lower.argmin(1)]
                    if first:
                        row, to = rows, best
                    else:  # rounding must not close a block that holds a neighbour at just that distance
                        upper = np.minimum(upper, part["__bound"].to_numpy())
                        open_ = lower <= (upper * (1 + 1e-9) + 1e-12)[:, None]
                        open_ = np.logical_or.reduceat(open_[:, by_place], starts, axis=1)
                        open_[rows, best] = False
                        row, to = np.nonzero(open_)
                    yield pd.DataFrame({"__key": part["__key"].to_numpy()[row], "__v": part["__v"].to_numpy()[row], "__bound": upper[row], **{n: where[to, i] for i, n in enumerate(names)}})

        return queries.mapInPandas(run, schema)

    def search(self, parcels: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """__key, distance, target: the k nearest rows of each parcel's group of blocks, within the parcel's bound.

        The queries of a group are divided into parts of bounded size, for which its blocks are copied.
        """
        p, key, rings = self.p, parcels.schema["__key"], self.rings
        parcels = cut_lineage(parcels)
        asked = {r["__group"]: r["count"] for r in parcels.groupBy("__group").count().collect()}  # one row per group
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        size = min(self.points, max(1_024, sum(asked.values()) // (4 * partitions)))  # queries of one part: a small search fills all tasks
        parts = {g: -(-n // size) for g, n in asked.items()}
        tasks = min(max(sum(parts.values()), partitions), TASKS)
        blocks = [(int(c), int(s), int(g), parts[g]) for c, s, g in zip(rings.cell, rings.sub, rings.group.tolist()) if g in parts]
        blocks = F.broadcast(self.spark.createDataFrame(blocks, "__cell int, __sub int, __group int, __parts int"))
        groups = F.broadcast(self.spark.createDataFrame(list(parts.items()), "__group int, __parts int"))
        left = parcels.join(groups, "__group").withColumn("__part", F.pmod(F.xxhash64("__key", "__v"), F.col("__parts")).cast("int")).drop("__parts")
        right = self.rows.select("__cell", "__sub", "__own", "__v", "__y", "__r").join(blocks, ["__cell", "__sub"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
        schema = T.StructType([key, T.StructField("distance", T.DoubleType()), T.StructField("target", T.DoubleType())])
        pivots = self.pivots

        def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            rows, ds, ys = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
            if len(a) and len(b):
                x, keys, same = np.stack(a["__v"].to_list()), a["__key"].to_numpy(), None
                if skip_self:
                    codes = pd.factorize(np.concatenate([keys, b["__own"].to_numpy()]))[0]
                    same = codes[:len(a)], codes[len(a):]
                    if keys.dtype != object:  # a NULL among numbers equals nothing
                        same = np.where(same[0] < 0, -2, same[0]), same[1]
                cell, sub, r = (b[c].to_numpy() for c in ("__cell", "__sub", "__r"))
                order = np.lexsort((r, sub, cell))
                cell, sub, r = cell[order], sub[order], r[order]
                y, labels = np.stack(b["__v"].to_list())[order], b["__y"].to_numpy()[order]
                block = np.cumsum(np.r_[0, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])])
                cells, place = np.unique(cell[np.searchsorted(block, np.arange(block[-1] + 1))], return_inverse=True)
                reach = a["__bound"].to_numpy() * (1 + 1e-9) + 1e-12
                centre = _distances(x, pivots[cells], p)
                nearest = centre.argmin(1)
                line = np.lexsort((centre.min(1), nearest))
                step = max(16, TILE // len(b))
                for q in (line[i:i + step] for i in range(0, len(line), step)):  # the parts of the rings within reach
                    low, high = (centre[q] - reach[q, None]).min(0)[place], (centre[q] + reach[q, None]).max(0)[place]
                    kept = np.flatnonzero((r >= low[block]) & (r <= high[block]))
                    if not len(kept):
                        continue
                    own = None if same is None else (same[0][q], same[1][order[kept]])
                    row, d, target = _nearest(x[q], y if len(kept) == len(y) else y[kept], pivots[cells[nearest[q[0]]]], reach[q], labels[kept], own, k, p)
                    rows.append(q[row])
                    ds.append(d)
                    ys.append(target)
            found = pd.DataFrame({"__at": np.concatenate(rows), "distance": np.concatenate(ds), "target": np.concatenate(ys)})
            found.insert(0, "__key", a["__key"].to_numpy()[found.pop("__at").to_numpy()])
            return found

        by = ["__group", "__part"]
        right = right.withColumnsRenamed({c: f"{c}2" for c in by})
        left, right = left.repartition(tasks, *by), right.repartition(tasks, *[f"{c}2" for c in by])
        return left.groupBy(*by).cogroup(right.groupBy(*[f"{c}2" for c in by])).applyInPandas(look, schema)


def nearest_neighbours(df: DataFrame, ref: DataFrame, key: str, fields, target: str, k: int = 5, p: float = 2.0, skip_self: str | None = None) -> DataFrame:
    """The k nearest reference rows of each row: (key, rank, distance, target); the smaller target first at equal distance.

    Exact, through a ``NeighbourIndex`` of the reference: two rounds of bounded tasks, each of which returns k candidates
    per row, never the distances; candidates are merged with a per-key limit that already applies before the shuffle.
    Rows without a value in one of the fields have no neighbours and are none.
    """
    vec = lambda d: ident(expand(d, fields)[0]).cast("array<double>") if isinstance(d.schema[expand(d, fields)[0]].dataType, T.ArrayType) else F.array(*[ident(f).cast("double") for f in expand(d, fields)])
    whole = lambda d: d.where(F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x)))
    left = whole(df.select(ident(key).alias("__key"), vec(df).alias("__v")))
    own = ident(skip_self) if skip_self else F.lit(None).cast(df.schema[key].dataType)
    right = whole(ref.select(own.alias("__own"), vec(ref).alias("__v"), ident(target).cast("double").alias("__y")))
    # a row's own rows do not count, so the bound from above has to leave room for them
    own_rows = right.groupBy("__own").count().agg(F.max("count")).first()[0] or 0 if skip_self else 0
    index = NeighbourIndex(right, k + own_rows if own_rows < 100 else 0, p)
    left = cut_lineage(left.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # read in both rounds
    queries = left.withColumn("__bound", F.lit(float("inf")))
    w = Window.partitionBy("__key").orderBy("distance", "target")
    first = cut_lineage(index.search(index.parcels(queries, True), k, bool(skip_self)))
    ranked = first.withColumn("__n", F.row_number().over(w))
    reached = ranked.where(F.col("__n") == k).select(F.col("__key").alias("__k"), F.col("distance").alias("__reached"))
    bounded = left.join(reached, F.col("__key").eqNullSafe(F.col("__k")), "left").select("__key", "__v", F.coalesce("__reached", F.lit(float("inf"))).alias("__bound"))
    found = first.unionByName(index.search(index.parcels(bounded, False), k, bool(skip_self)))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("__key").alias(key), "rank", "distance", "target")


def knn(df: DataFrame, ref: DataFrame, key: str, fields, target: str, k: int = 5, regression: bool = False, by_distance: bool = False, p: float = 2.0,
        skip_self: str | None = None) -> DataFrame:
    """Vote (smallest label wins a tie) or mean of the k nearest rows, optionally weighted by 1/distance."""
    near = nearest_neighbours(df, ref, key, fields, target, k, p, skip_self)
    weight = F.coalesce(F.try_divide(F.lit(1.0), F.col("distance")), F.lit(1e12)) if by_distance else F.lit(1.0)
    near = near.withColumn("__w", weight)
    if regression:
        return near.groupBy(ident(key)).agg((F.sum(F.col("target") * F.col("__w")) / F.sum("__w")).alias("prediction"))
    votes = near.groupBy(ident(key), "target").agg((-F.sum("__w")).alias("__v"))
    return votes.groupBy(ident(key)).agg(F.min(F.struct("__v", "target"))["target"].alias("prediction"))


def cross_validate(df: DataFrame, kind: str, fields, target: str, folds: int = 3, metric: str = "accuracy", seed: int = 0, **params) -> DataFrame:
    """Train and test score of each fold. Folds come from a hash of the row, so every pass cuts the same ones."""
    spark = df.sparkSession
    data = df.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), *[ident(c) for c in df.columns]), F.lit(folds))).persist()
    scores = []
    try:
        for i in range(folds):  # one training job per fold
            train_rows, test_rows = data.filter(F.col("__fold") != i), data.filter(F.col("__fold") == i)
            model = train(train_rows, kind, fields, target, seed, **params)
            score = lambda d: score_of(predict(model, d, fields), target, "prediction", metric)
            scores.append((i, float(score(train_rows)), float(score(test_rows))))
    finally:
        data.unpersist()
    return spark.createDataFrame(scores, "fold int, train_score double, test_score double")


def score_of(df: DataFrame, target: str, prediction: str, metric: str) -> float:
    report = evaluate_classes(df, target, prediction) if metric in ("accuracy", "hamming") else evaluate_numbers(df, target, prediction)
    return report.first()[metric]  # one row


def evaluate_classes(df: DataFrame, target: str, prediction: str) -> DataFrame:
    hit = F.avg((ident(target).cast("double") == ident(prediction).cast("double")).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("rows"), hit.alias("accuracy"), (1 - hit).alias("hamming"))


def confusion(df: DataFrame, target: str, prediction: str) -> DataFrame:
    return df.groupBy(ident(target).alias("label"), ident(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Precision, recall, f1 and support per class, from one table of counts."""
    table = confusion(df, target, prediction)
    as_label = table.groupBy("label").agg(F.sum("count").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("__hit"))
    as_guess = table.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("__guessed"))
    out = as_label.join(as_guess, "label", "left")
    precision, recall = F.try_divide(F.col("__hit").cast("double"), F.col("__guessed")), F.col("__hit").cast("double") / F.col("support")
    return out.select("label", F.coalesce(precision, F.lit(0.0)).alias("precision"), recall.alias("recall"),
                      F.coalesce(F.try_divide(2.0 * F.col("__hit"), F.col("__guessed") + F.col("support")), F.lit(0.0)).alias("f1"), "support")


def log_loss(df: DataFrame, target: str, probabilities: list[str], floor: float = 1e-15) -> DataFrame:
    """Mean negative log probability of the true class (labels 0, 1, ...)."""
    own: Column = F.lit(None).cast("double")
    for i, c in enumerate(probabilities):
        own = F.when(ident(target) == i, ident(c)).otherwise(own)
    return df.agg((-F.avg(F.log(F.greatest(F.least(own, F.lit(1 - floor)), F.lit(floor))))).alias("log_loss"))


def evaluate_numbers(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Mean absolute, mean squared, mean squared log and median absolute error."""
    y, z = ident(target).cast("double"), ident(prediction).cast("double")
    data = df.withColumn("__e", F.abs(y - z))
    msle = F.avg(F.when((y > -1) & (z > -1), F.pow(F.log1p(y) - F.log1p(z), 2)))
    out = data.agg(F.avg("__e").alias("mae"), F.avg(F.col("__e") * F.col("__e")).alias("mse"), msle.alias("msle"))
    return with_row(out, quantiles(data, None, {"median_ae": ("__e", 0.5)}))


