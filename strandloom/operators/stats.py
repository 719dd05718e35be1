"""Robust statistics by group, outliers, and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import placed


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float], interpolate: bool = True) -> DataFrame:
    """Per group the exact quantiles of ``value`` (nulls left out) by name, and n_values.

    Rows are counted by value, and a group's values are spread over tasks by ranges (``state.placed``). Between two places a
    quantile is interpolated; without ``interpolate`` it is the value at index int(share * n).
    """
    counts = df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = placed(counts, keys, ["_v"], F.col("_c"))
    first_past = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_v")))
    out = []
    for name, p in shares.items():
        at = F.round((F.col("_n") - int(interpolate)) * F.lit(float(p)), 9)  # a share such as 0.975 is not exact
        low = first_past(F.least(F.floor(at), F.col("_n") - 1))
        if interpolate:
            part = F.max(at - F.floor(at))
            low = low + (first_past(F.ceil(at)) - low) * part
        out.append(low.alias(name))
    return run.groupBy(*keys).agg(*out, F.max("_n").alias("n_values"))


def with_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with its group's size, median and median absolute deviation, joined back on the keys."""
    near = df.join(quantiles(df, keys, F.col(value), {"med": 0.5}), keys)
    mad = quantiles(near, keys, F.abs(F.col(value) - F.col("med")), {"mad": 0.5}).drop("n_values")
    return near.join(mad, keys)


def modified_z(value: Column, med: Column, mad: Column) -> Column:
    """0.6745 |x - median| / MAD; no spread, no outliers: 0."""
    return F.coalesce(F.lit(0.6745) * F.abs(value - med) / F.nullif(mad, F.lit(0.0)), F.lit(0.0))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, population std, min, max and count."""
    plain = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n_sample"))
    return plain.join(quantiles(df, keys, F.col(value), {"median": 0.5}).drop("n_values"), keys, "left")


def lab_stats(df: DataFrame, keys: list[str], value: str, threshold: float = 2.5, more_than: int = 5) -> DataFrame:
    """Summary without outliers; groups of up to ``more_than`` values keep all of them."""
    x = with_mad(df, keys, value)
    keep = (F.col("n_values") <= more_than) | (modified_z(F.col(value), F.col("med"), F.col("mad")) <= threshold)
    return summary(x.where(keep), keys, value)


def double_mad_outliers(df: DataFrame, keys: list[str], value: str, threshold: float = 3.5) -> DataFrame:
    """Rows whose deviation over the MAD of their own side of the median is over the threshold."""
    med = quantiles(df, keys, F.col(value), {"med": 0.5}).drop("n_values")
    x = df.join(med, keys).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    side = lambda c, name: quantiles(x, keys, F.when(c, F.col("dev")), {name: 0.5}).drop("n_values")
    sides = side(F.col(value) <= F.col("med"), "left_mad").join(side(F.col(value) >= F.col("med"), "right_mad"), keys, "full")
    x = x.join(sides, keys)
    mad = F.when(F.col(value) <= F.col("med"), F.col("left_mad")).otherwise(F.col("right_mad"))
    return x.where((F.col("dev") > 0) & (F.lit(0.6745) * F.col("dev") / F.nullif(mad, F.lit(0.0)) > threshold))


def central(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Rows inside the central share of their group, with its bounds."""
    low = (1 - share) / 2
    bounds = quantiles(df, keys, F.col(value), {"low": low, "high": 1 - low}).drop("n_values")
    return df.join(bounds, keys).where(F.col(value).between(F.col("low"), F.col("high")))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """row x mean of each column; missing cells get the column's overall mean (one row, joined by broadcast)."""
    wide = df.groupBy(row).pivot(column, names).agg(F.avg(value))
    overall = df.agg(*[F.avg(F.when(F.col(column) == n, F.col(value))).alias(f"_{n}") for n in names])
    return wide.crossJoin(F.broadcast(overall)).select(row, *[F.coalesce(F.col(n), F.col(f"_{n}")).alias(n) for n in names])


def profile(df: DataFrame, index: str, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(index).alias("n_ids"), F.countDistinct(label).alias("n_labels"))


def distinct_values(df: DataFrame) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(c) for c in df.columns])


def nontrivial(df: DataFrame, columns: list[str], trivial: float = 0) -> DataFrame:
    """Mean number of attributes a row that differ from the trivial value."""
    n = sum((F.when(F.col(c) != trivial, 1).otherwise(0) for c in columns), F.lit(0))
    return df.agg(F.avg(n).alias("mean_nontrivial"))
