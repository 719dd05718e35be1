"""Small table helpers that the other operators' pipelines are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import Predicate


def match(df: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """Rows that equal every criterion; an unknown column raises."""
    missing = set(criteria) - set(df.columns)
    if missing:
        raise KeyError(sorted(missing))
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in criteria.items()], F.lit(True)))


def with_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The column cast; rows that can't be cast go."""
    return df.withColumn(column, F.col(column).try_cast(kind)).dropna(subset=[column])


def merge_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner equi-join of several tables on one key."""
    return reduce(lambda a, b: a.join(b, key), frames)


def matching_codes(df: DataFrame, codes: str, p: Predicate, first: int | None = None) -> DataFrame:
    """Distinct codes that satisfy the predicate; of each row's array only the first few that do, if ``first`` is given."""
    kept = F.filter(codes, p)
    return df.select(F.explode(F.slice(kept, 1, first) if first else kept).alias("code")).distinct()


def without_codes(df: DataFrame, codes: str, targets: list[str]) -> DataFrame:
    """Rows whose codes are null or hold none of the targets."""
    return df.where(F.col(codes).isNull() | ~F.arrays_overlap(codes, F.array(*[F.lit(t) for t in targets])))


def first_per_key(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def supported(df: DataFrame, label: str, wanted: list[str], more_than: int = 0) -> DataFrame:
    """One row: whether every wanted label has over ``more_than`` rows."""
    n = [F.sum(F.when(F.col(label) == w, 1).otherwise(0)) > more_than for w in wanted]
    return df.agg(reduce(lambda a, b: a & b, n).alias("supported"))


def segment_at(events: DataFrame, times: list[str], t: str = "t") -> DataFrame:
    """Segment: the number of cut times that lie before the row's time."""
    cuts = F.array(*[F.lit(x).cast("date") for x in sorted(times)])
    return events.withColumn("segment", F.size(F.filter(cuts, lambda c: c < F.col(t))))


def gather(a: Column, positions: Column) -> Column:
    """The elements at 0-based positions; those outside are null."""
    return F.transform(positions, lambda i: F.get(a, i))


def apply_vocabulary(tokens: DataFrame, vocabulary: DataFrame, unknown: str | None = "unknown") -> DataFrame:
    """``tokens`` with the index of each; others become ``unknown`` with one index past the last, or go."""
    if unknown is None:
        return tokens.join(vocabulary.select("token", "index"), "token")
    past = vocabulary.agg((F.max("index") + 1).alias("_past"))  # one row
    found = tokens.join(vocabulary.select("token", F.col("index").alias("_i")), "token", "left").crossJoin(F.broadcast(past))
    known = F.col("_i").isNotNull()
    return found.withColumn("token", F.when(known, F.col("token")).otherwise(unknown)).withColumn("index", F.coalesce("_i", "_past")).drop("_i", "_past")


def members(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """Each cluster's members in order (clusters of bounded size)."""
    return df.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("members"))


def polarized(codes: DataFrame, code: str, root: Column, target: str) -> DataFrame:
    """Codes with whether they share the target's root."""
    return codes.select(code, (root == target.split(".")[0]).alias("positive")).distinct()


def l1_features(df: DataFrame, features: list[str], label: str, strength: float = 0.01) -> list[str]:
    """Features with a non-zero weight in an L1 logistic regression (MLlib)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=strength, elasticNetParam=1.0).fit(x)
    return [f for f, c in zip(features, model.coefficients) if c]


def cross_validated_auc(df: DataFrame, features: list[str], label: str, folds: int = 5, seed: int = 53) -> float:
    """Mean area under the curve of a logistic regression over folds (MLlib)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    judge = BinaryClassificationEvaluator(labelCol=label)
    cv = CrossValidator(estimator=LogisticRegression(featuresCol="_x", labelCol=label), estimatorParamMaps=ParamGridBuilder().build(), evaluator=judge, numFolds=folds, seed=seed)
    return float(cv.fit(x).avgMetrics[0])


def dropped(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without these columns, where it has them."""
    return df.drop(*[c for c in columns if c in df.columns])


def from_index(rows: DataFrame, vocabulary: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Indices back to tokens; one that the vocabulary lacks is ``unknown``."""
    return rows.join(vocabulary.select("index", F.col("token").alias("_t")), "index", "left").withColumn("token", F.coalesce("_t", F.lit(unknown))).drop("_t")
