"""Samples that are a function of keys and seed, so that they can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..state import numbered, placed, written
from . import stats


def hashed(key: Column, seed: int = 53) -> Column:
    """A portable pseudo-random order: md5 of key and seed."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def per_class(df: DataFrame, label: str, n: int, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def near_equal(df: DataFrame, label: str, total: int, classes: int, order: list[Column]) -> DataFrame:
    """About ``total`` rows spread evenly over the classes: the first (by label) take the remainder."""
    quota = F.lit(total // classes) + (F.dense_rank().over(Window.orderBy("_label")) <= total % classes).cast("int")
    quotas = df.select(F.col(label).alias("_label")).distinct().withColumn("_quota", quota)  # a row a class
    ranked = placed(df, [label], order).withColumnRenamed("_upto", "rank").drop("_n")
    return ranked.join(F.broadcast(quotas), F.col(label) == F.col("_label")).where(F.col("rank") <= F.col("_quota")).drop("_label", "_quota")


def round_robin(df: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """Row 1 of every group, then row 2, ..., until there are n."""
    ranked = placed(df, [group], order).withColumnRenamed("_upto", "round").drop("_n")
    return ranked.orderBy("round", group).limit(n)


def one_per_interval(df: DataFrame, value: str, intervals: int, key: str, seed: int = 53) -> DataFrame:
    """The values in order cut in ``intervals`` parts of equal count (the first take the remainder); of each the row whose hash is smallest."""
    n = df.count()
    size, more = divmod(n, intervals)
    at = F.col("_at")
    first = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / max(size, 1)))
    cut = numbered(df, [value, key], "_at").withColumn("interval", (first + 1).cast("int")).drop("_at")
    row = F.struct(*[F.col(f"`{c}`") for c in cut.columns])
    return cut.groupBy("interval").agg(F.min_by(row, hashed(F.col(key), seed)).alias("_r")).select("_r.*")


def split(df: DataFrame, label: str, ratios: list[float], key: str, seed: int = 53) -> DataFrame:
    """An exact split of each class by ratios: ``part`` is 0, 1, ...; the last takes the remainder."""
    share = (F.col("_upto") - 1) / F.col("_n")
    part, upto = F.lit(len(ratios) - 1), 0.0
    bounds = []
    for r in ratios[:-1]:
        upto += r
        bounds.append(upto)
    for i in range(len(bounds) - 1, -1, -1):
        part = F.when(F.col("_share") < bounds[i], i).otherwise(part)
    return placed(df, [label], [hashed(F.col(key), seed)]).withColumn("_share", share).withColumn("part", part).drop("_share", "_upto", "_n")


def interval(df: DataFrame, keys: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """mean, median, sample std, and the values at index int(p n) of the sorted ones (no interpolation)."""
    got = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    mid = stats.quantiles(df, keys, F.col(value), {"median": 0.5}).drop("n_values")
    ends = stats.quantiles(df, keys, F.col(value), {"low": low, "high": high}, interpolate=False).drop("n_values")
    return got.join(mid, keys, "left").join(ends, keys, "left").select(*keys, "mean", "median", "std", "low", "high")


def weighted_pick(df: DataFrame, weight: str, order: str, points: list[float]) -> DataFrame:
    """For each point in [0, 1) the row in which the running share of the weights passes it.

    Rows are summed by ranges of the order; the running sum over the ranges (a row a task) tells each range its start.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = written(dealt.withColumn("_run", F.sum(weight).over(w)), "runs")
    sums = runs.groupBy("_part").agg(F.max("_run").alias("s")).orderBy("_part").collect()  # a row a task
    total, starts, at = sum(r["s"] for r in sums), [], 0.0
    for r in sums:
        starts.append((r["_part"], float(at)))
        at += r["s"]
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _start double"))
    shares = runs.join(first, "_part").withColumn("_hi", (F.col("_start") + F.col("_run")) / F.lit(float(total))).withColumn("_lo", F.col("_hi") - F.col(weight) / F.lit(float(total)))
    found = shares.withColumn("point", F.explode(F.array(*[F.lit(p) for p in points]))).where((F.col("point") >= F.col("_lo")) & (F.col("point") < F.col("_hi")))
    return found.drop("_lo", "_hi", "_part", "_run", "_start")


def draws(ids: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n draws with replacement: hashed indices joined with the rows' numbers."""
    spark = ids.sparkSession
    total = ids.count()
    picks = spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("_i"))
    return picks.join(numbered(ids, [key], "_i"), "_i").drop("_i")


def balanced(df: DataFrame, label: str, key: str, ratio: float = 0.8, seed: int = 53) -> DataFrame:
    """As many rows of every class: ``ratio`` of the smallest one's, the first by hash."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.floor(F.min("n") * ratio).alias("_n"))  # one row
    ranked = placed(df, [label], [hashed(F.col(key), seed)]).drop("_n")
    return ranked.crossJoin(F.broadcast(least)).where(F.col("_upto") <= F.col("_n")).drop("_upto", "_n")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 53) -> DataFrame:
    """``df`` with a fold from 0 to k - 1, each class dealt evenly over them."""
    return placed(df, [label], [hashed(F.col(key), seed)]).withColumn("fold", ((F.col("_upto") - 1) % k).cast("int")).drop("_upto", "_n")


def combinations(df: DataFrame, key: str, r: int, group: str | None = None) -> DataFrame:
    """The r-combinations of a bounded set's keys, in one group if given: c1 < c2 < ..."""
    keys = [group] if group else []
    out = df.select(*keys, F.col(key).alias("c1")).distinct()
    for i in range(2, r + 1):
        nxt = df.select(*keys, F.col(key).alias(f"c{i}")).distinct()
        out = out.join(nxt, keys).where(F.col(f"c{i - 1}") < F.col(f"c{i}")) if keys else out.join(nxt, F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out


def resample_weight(key: Column, draw: Column, seed: int = 53) -> Column:
    """How often a row is drawn in a bootstrap resample: Poisson of mean 1 by a portable hash, so no rows are moved."""
    # The Poisson distribution function up to 4.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = F.lit(len(steps))
    for n in range(len(steps) - 1, -1, -1):
        out = F.when(u < steps[n], n).otherwise(out)
    return out
