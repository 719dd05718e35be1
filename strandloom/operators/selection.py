"""Choosing features and models: stability selection, nested cross-validation, reports and curves from prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..state import written
from .sampling import folds, hashed


def in_subsample(key: Column, draw: int, share: float = 0.5) -> Column:
    """Whether a row is in a draw's subsample: by a portable hash, so of each class about the same share."""
    u = F.conv(F.substring(hashed(F.concat_ws("-", key.cast("string"), F.lit(str(draw)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return u < share


def stability(df: DataFrame, features: list[str], label: str, key: str, draws: int = 10, strength: float = 0.01, share: float = 0.5) -> list[tuple[str, float]]:
    """How often each feature has a weight in L1 logistic regressions of ``draws`` subsamples (a share of all draws); most often first, then by name."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = written(VectorAssembler(inputCols=features, outputCol="_x").transform(df).select(key, F.col(label).cast("double").alias("_y"), "_x"), "features")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=strength, elasticNetParam=1.0)
    times = dict.fromkeys(features, 0)
    for d in range(draws):
        for f, w in zip(features, model.fit(x.where(in_subsample(F.col(key), d, share))).coefficients):
            times[f] += bool(w)
    return sorted(((f, n / draws) for f, n in times.items()), key=lambda p: (-p[1], p[0]))


def classifier(kind: str, strength: float):
    """A logistic regression or a linear support vector machine (MLlib)."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    if kind == "logistic":
        return LogisticRegression(featuresCol="_x", labelCol="_y", regParam=strength)
    if kind == "svm":
        return LinearSVC(featuresCol="_x", labelCol="_y", regParam=strength)
    raise ValueError(kind)


def _margins(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", F.element_at(vector_to_array("rawPrediction"), 2))


#: Fits that run side by side: a fit is a chain of small jobs, which leaves most of a cluster idle.
FITS_AT_ONCE = 6


def nested_cv(df: DataFrame, features: list[str], label: str, key: str, grid: list[tuple[str, float]], outer: int = 3, inner: int = 3, seed: int = 53) -> DataFrame:
    """Out-of-fold predictions, a row for each of ``df``: key, fold, label, score (margin), predicted, kind and strength.

    For each outer fold the member of ``grid`` (kind, strength) with the best mean area under the curve over the inner
    folds of the other rows is fitted to these and scores the fold. Folds are dealt by class and hash, so every row is
    predicted once, by a model that has not seen it.

    The inner fits of all folds run ``FITS_AT_ONCE`` at a time and their areas come from one query, a window a model.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler

    from .evaluate import auc

    spark = df.sparkSession
    x = written(df.select(key, F.col(label).cast("double").alias("_y"), *features), "numbers")  # dealing folds reads the rows twice
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(x).select(key, "_y", "_x")
    x = written(folds(folds(x, "_y", key, outer, seed).withColumnRenamed("fold", "outer"), "_y", key, inner, seed + 1).withColumnRenamed("fold", "inner"), "folds")
    apart = lambda o: (x.where(F.col("outer") != o), x.where(F.col("outer") == o))

    def inner_fit(task: tuple[int, int, int]):
        o, g, i = task
        return classifier(*grid[g]).fit(apart(o)[0].where(F.col("inner") != i))

    def outer_fit(task: tuple[int, int]):
        o, g = task
        return classifier(*grid[g]).fit(apart(o)[0])

    tasks = [(o, g, i) for o in range(outer) for g in range(len(grid)) for i in range(inner)]
    with ThreadPool(FITS_AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(spark)(inner_fit), tasks, chunksize=1)
        scores = [_margins(m, apart(o)[0].where(F.col("inner") == i)).select(F.lit(n).alias("_model"), "_y", "score") for n, (m, (o, _, i)) in enumerate(zip(models, tasks))]
        areas = {r["_model"]: r["auc"] for r in auc(reduce(DataFrame.unionAll, scores), ["_model"], "_y", "score").collect()}  # a row a model
        area = dict.fromkeys(((o, g) for o, g, _ in tasks), 0.0)
        for n, (o, g, _) in enumerate(tasks):
            area[o, g] += 0.5 if areas.get(n) is None else areas[n]
        best = [(o, max(range(len(grid)), key=lambda g: area[o, g])) for o in range(outer)]  # noqa: B023
        finals = pool.map(inheritable_thread_target(spark)(outer_fit), best, chunksize=1)
    found = None
    for (o, g), model in zip(best, finals):
        (kind, strength), scored = grid[g], _margins(model, apart(o)[1])
        part = scored.select(key, F.lit(o).alias("fold"), F.col("_y").cast("int").alias("label"), "score", (F.col("score") > 0).cast("int").alias("predicted"), F.lit(kind).alias("kind"), F.lit(float(strength)).alias("strength"))
        found = part if found is None else found.unionByName(part)
    return written(found, "predictions")


def report(predictions: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per class: precision, recall, f1 (0 where undefined) and support."""
    n = written(predictions.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("_n")), "confusion")
    hits = n.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("class"), F.col("_n").alias("_hit"))
    said = n.groupBy(F.col(predicted).alias("class")).agg(F.sum("_n").alias("_said"))
    real = n.groupBy(F.col(truth).alias("class")).agg(F.sum("_n").alias("support"))
    x = real.join(said, "class", "full").join(hits, "class", "left").na.fill(0, ["_hit", "_said", "support"])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    x = x.withColumn("precision", share("_hit", "_said")).withColumn("recall", share("_hit", "support"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return x.select("class", "precision", "recall", f1.alias("f1"), "support")


def confusion_matrix(predictions: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """truth, predicted and n, of the pairs that occur."""
    return predictions.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def roc_points(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """The curve's points by falling threshold: keys, threshold, fpr and tpr; (0, 0) has a null threshold. Classes without rows of both kinds have none."""
    by = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(truth).alias("_p"), F.sum(1 - F.col(truth)).alias("_n"))
    all_ = Window.partitionBy(*(keys or [F.lit(1)]))  # distinct scores
    run = all_.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    points = by.select(*keys, "threshold", F.sum("_p").over(run).alias("tp"), F.sum("_n").over(run).alias("fp"), F.sum("_p").over(all_).alias("p"), F.sum("_n").over(all_).alias("n")).where("p > 0 and n > 0")
    points = points.select(*keys, "threshold", (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))
    start = points.select(*keys).distinct() if keys else points.limit(1).select()
    return points.unionByName(start.select(*keys, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def on_grid(points: DataFrame, keys: list[str], grid: list[float]) -> DataFrame:
    """keys, x and tpr: curves (fpr, tpr) at the places of ``grid``, between points by straight lines.

    An as-of merge of two sorted runs: at each place the last point up to it and the first one after it. Where points
    share an fpr the curve is upright: the line before ends at the lowest, the line after starts at the highest.
    """
    ends = points.groupBy(*keys, F.col("fpr").alias("x")).agg(F.max("tpr").alias("_hi"), F.min("tpr").alias("_lo"))
    places = points.select(*keys).distinct().withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    none = F.lit(None).cast("double")
    both = ends.select(*keys, "x", F.col("x").alias("_at"), "_hi", "_lo", F.lit(0).alias("_k")).unionByName(places.select(*keys, "x", none.alias("_at"), none.alias("_hi"), none.alias("_lo"), F.lit(1).alias("_k")))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("x", "_k")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    first = lambda c: F.first(c, ignorenulls=True).over(after)
    x = both.select(*keys, "x", "_k", last("_at").alias("x0"), last("_hi").alias("y0"), first("_at").alias("x1"), first("_lo").alias("y1")).where("_k = 1")
    line = F.col("y0") + (F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return x.select(*keys, "x", F.when(F.col("x1").isNull() | (F.col("x") == F.col("x0")), F.col("y0")).otherwise(line).alias("tpr"))


def mean_curve(curves: DataFrame) -> DataFrame:
    """x and the mean tpr of all curves at it."""
    return curves.groupBy("x").agg(F.avg("tpr").alias("tpr"))


def area(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under curves (keys, x, tpr) by trapezia."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("x")
    steps = curve.withColumn("_a", (F.col("x") - F.lag("x").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2)
    return steps.groupBy(*keys).agg(F.sum("_a").alias("area"))
