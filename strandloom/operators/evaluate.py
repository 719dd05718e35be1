"""Clusters and classifiers against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster its size, majority label (of equal ones the first), and the majority's share."""
    n = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(cluster).agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))["l"].alias("majority"), F.max("n").alias("n_majority")).withColumn("purity", F.col("n_majority") / F.col("size"))


def overall_purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    p = purity(df, cluster, label)
    return p.agg((F.sum("n_majority") / F.sum("size")).alias("purity"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts, sensitivity and specificity of 0/1 columns; 0 where undefined."""
    is_ = lambda t, p: F.sum(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1).otherwise(0))
    c = df.agg(is_(1, 1).alias("tp"), is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    return c.select("*", share("tp", "fn").alias("sensitivity"), share("tn", "fp").alias("specificity"))


def auc(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half. Rows are first counted by score, so the window sees distinct scores."""
    by = df.groupBy(*keys, score).agg(F.sum(truth).alias("_p"), F.sum(1 - F.col(truth)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = by.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    total = won.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return total.select(*keys, "n_pos", "n_neg", (F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def rank_sum(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Rank-sum test of two groups (0/1 column): U, z by the normal approximation (its variance corrected for ties) and the two-sided p."""
    by = df.groupBy(*keys, value).agg(F.sum(group).alias("_a"), F.sum(1 - F.col(group)).alias("_b"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("_a") + F.col("_b")
    ranked = by.withColumn("_rank", F.coalesce(F.sum(t).over(w), F.lit(0)) + (t + 1) / 2).withColumn("_tie", (t * t * t - t).cast("double"))
    s = ranked.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_rank")).alias("_r"), F.sum("_a").alias("n1"), F.sum("_b").alias("n0"), F.sum("_tie").alias("_ties"))
    n = F.col("n1") + F.col("n0")
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    variance = F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0)))
    z = (u - F.col("n1") * F.col("n0") / 2) / F.nullif(F.sqrt(variance), F.lit(0.0))
    return s.select(*keys, "n1", "n0", u.alias("u"), z.alias("z")).withColumn("p", normal_tail(F.abs("z")) * 2)


def normal_tail(z: Column) -> Column:
    """Probability of a standard normal over ``z`` >= 0, to 1e-7 (the rational approximation of Abramowitz and Stegun, 26.2.17)."""
    # The approximation's coefficients.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * z)
    series = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * series


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """``df`` with its k-means cluster (MLlib)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(x).transform(x).drop("_features")


def weighted_auc(df: DataFrame, keys: list[str], truth: str, score: str, weight: str) -> DataFrame:
    """``auc`` of rows that count ``weight`` times; null where a class is missing."""
    by = df.groupBy(*keys, score).agg(F.sum(F.col(truth) * F.col(weight)).alias("_p"), F.sum((1 - F.col(truth)) * F.col(weight)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = by.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    total = won.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return total.select(*keys, "n_pos", "n_neg", (F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def bootstrap_auc(df: DataFrame, key: str, truth: str, score: str, resamples: int, seed: int = 53) -> DataFrame:
    """The area of each resample: draw, auc; resamples of one class are left out."""
    from .sampling import resample_weight

    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_w", resample_weight(F.col(key), F.col("draw"), seed))
    return weighted_auc(drawn.where("_w > 0"), ["draw"], truth, score, "_w").where("auc is not null").select("draw", "auc")


def multiclass_auc(df: DataFrame, cls: str, truth: str, score: str) -> DataFrame:
    """One row over (class, truth 0/1, score): macro (mean of the classes), micro (all rows in one), the best and the worst class."""
    each = auc(df, [cls], truth, score)
    ends = each.agg(F.avg("auc").alias("macro"), F.min("auc").alias("lowest"), F.max("auc").alias("highest"), F.min_by(cls, F.struct("auc", cls)).alias("worst"))
    micro = auc(df, [], truth, score).select(F.col("auc").alias("micro"))
    return ends.crossJoin(F.broadcast(micro))  # one row each


def average_precision(df: DataFrame, keys: list[str], truth: str, score: str) -> DataFrame:
    """Area under the precision-recall steps: at each distinct score, falling, the gain in recall times the precision."""
    by = df.groupBy(*keys, score).agg(F.sum(truth).alias("_p"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("_tp", F.sum("_p").over(w)).withColumn("_all", F.sum("_c").over(w))
    return run.groupBy(*keys).agg(F.sum("_p").alias("n_pos"), (F.sum(F.col("_p") * F.col("_tp") / F.col("_all")) / F.nullif(F.sum("_p"), F.lit(0))).alias("average_precision"))


def neighbour_agreement(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Share of each query's neighbours (query_id, neighbour_id) that have its label."""
    of = lambda c: labels.select(F.col(key).alias(f"{c}_id"), F.col(label).alias(f"_{c}"))
    return near.join(of("query"), "query_id").join(of("neighbour"), "neighbour_id").groupBy("query_id").agg(F.avg(F.col("_query").eqNullSafe(F.col("_neighbour")).cast("double")).alias("agreement"))


def silhouettes(df: DataFrame, features: list[str], ks: list[int], seed: int = 1) -> dict[int, float]:
    """Mean silhouette (squared Euclidean, MLlib) of k-means for each k; the best k has the largest."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    judge = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster")
    return {k: judge.evaluate(VectorAssembler(inputCols=features, outputCol="_x").transform(kmeans(df, features, k, seed))) for k in ks}
