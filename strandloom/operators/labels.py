"""Labels of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import placed


def merge(label: Column, groups: dict[str, str]) -> Column:
    """Equivalent labels to their representative."""
    out = label
    for old, new in groups.items():
        out = F.when(label == old, new).otherwise(out)
    return out


def focus(label: Column, keep: list[str], other: str = "Others") -> Column:
    return F.when(label.isin(*keep), label).otherwise(other)


def binarize(label: Column, positive: list[str]) -> Column:
    return label.isin(*positive).cast("int")


def bits(rows: DataFrame, classes: dict[str, Column], at_least: int = 1, doc: str = "doc_id") -> DataFrame:
    """One 0/1 column a class, and their number: the first class is bit 0."""
    found = rows.groupBy(doc).agg(*[(F.sum(F.when(c, 1).otherwise(0)) >= at_least).cast("int").alias(n) for n, c in classes.items()])
    return found.withColumn("bits", sum((F.col(n) * (1 << i) for i, n in enumerate(classes)), F.lit(0)).cast("int"))


def most_frequent(rows: DataFrame, code: Column, condition: Column, default: str = "-1", doc: str = "doc_id") -> DataFrame:
    """The document's most frequent code that meets the condition; of equal ones the first; none: the default."""
    counts = rows.where(condition).groupBy(doc, code.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.groupBy(doc).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_c").alias("c")))["c"].alias("label"))
    return rows.select(doc).distinct().join(top, doc, "left").select(doc, F.coalesce("label", F.lit(default)).alias("label"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k n_c)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n_class", (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight"))


def index_by(rows: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """The documents of each combination of labels: keys, doc, place (from 1, in the order of doc) and n, a row each."""
    return placed(rows.select(*keys, doc), keys, [doc]).withColumnsRenamed({"_upto": "place", "_n": "n"})


def without_classes(df: DataFrame, label: str, drop: list[str] = ("Control",)) -> DataFrame:
    """Rows of the other classes; rows without a label stay."""
    return df.where(F.col(label).isNull() | ~F.col(label).isin(*drop))


def training_table(df: DataFrame, features: list[str], label: str, index: str) -> DataFrame:
    """f0, f1, ... as doubles, target and index; rows with any null go."""
    named = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    return df.select(F.col(index).alias("index"), *named, F.col(label).alias("target")).dropna(how="any")


def prepared(df: DataFrame, label: str, merge_to: dict[str, str] | None = None, keep: list[str] | None = None, drop: list[str] | None = None, per_class: int | None = None, key: str = "doc_id", seed: int = 53) -> DataFrame:
    """A training table's classes in one go: merged, focused, dropped, and cut to as many rows a class (by hash of the key)."""
    from .sampling import hashed
    from .sampling import per_class as first

    out = df.withColumn(label, merge(F.col(label), merge_to or {}))
    out = out.withColumn(label, focus(F.col(label), keep)) if keep else out
    out = without_classes(out, label, drop) if drop else out
    return first(out, label, per_class, [hashed(F.col(key), seed)]).drop("rank") if per_class else out
