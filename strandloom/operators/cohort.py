"""Cohort selection over event tables: who has which codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import written


def rows_of_matching(events: DataFrame, condition: Column, person: str = "person_id") -> DataFrame:
    """All rows of everyone who has at least one matching row."""
    return events.join(events.where(condition).select(person).distinct(), person, "left_semi")


def rows_of(events: DataFrame, ids: DataFrame, person: str = "person_id") -> DataFrame:
    return events.join(ids.select(person), person, "left_semi")


def without(events: DataFrame, ids: DataFrame, person: str = "person_id") -> DataFrame:
    return events.join(ids.select(person), person, "left_anti")


def persons_by_codes(events: DataFrame, code: Column, wanted: list[str], relation: str = "and", person: str = "person_id") -> DataFrame:
    """Persons with all (and) or any (or) of ``wanted``, and how many of them; only matching rows are shuffled."""
    found = events.select(person, code.alias("_code")).where(F.col("_code").isin(*wanted)).groupBy(person).agg(F.countDistinct("_code").alias("n_matched"))
    return found.where(F.col("n_matched") == len(set(wanted))) if relation == "and" else found


def top_codes(events: DataFrame, code: Column, n: int = 20) -> DataFrame:
    """The n most frequent codes; of equal counts the code that sorts first."""
    return events.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(n)


def persons_per_code(events: DataFrame, code: Column, person: str = "person_id") -> DataFrame:
    return events.groupBy(code.alias("code")).agg(F.countDistinct(person).alias("n_persons"), F.count(F.lit(1)).alias("n"))


def codes_of_all(events: DataFrame, code: Column, persons: list[int], person: str = "person_id") -> DataFrame:
    """Codes that every one of ``persons`` has."""
    rows = events.where(F.col(person).isin(*persons))
    return rows.groupBy(code.alias("code")).agg(F.countDistinct(person).alias("k")).where(F.col("k") == len(set(persons))).select("code")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several event tables, with the place of their source in the list: the order among rows of one date."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)])


def fill_labels(documents: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Documents with a label or 'unknown'; of several labels of a key the smallest."""
    one = labels.groupBy(key).agg(F.min(label).alias(label))
    return documents.join(one, key, "left").withColumn(label, F.coalesce(label, F.lit("unknown")))


def in_ranges(events: DataFrame, key: str, low: int, high: int, parts: int) -> DataFrame:
    """Rows with key in [low, high) and the number of the half-open range of equal width they fall in."""
    width = -(-(high - low) // parts)
    inside = events.where((F.col(key) >= low) & (F.col(key) < high))
    return inside.withColumn("part", F.floor((F.col(key) - low) / width).cast("int"))


def group_by_subset(items: DataFrame, key: str, entity: str, attributes: str) -> DataFrame:
    """Each item's leader: of the items of the same entity whose attribute set contains the item's, the one of the largest set, then the smallest key.

    Equal sets of an entity are one, with its smallest key; a set meets others at its rarest attribute in the entity
    only, which every set that contains it has. Empty sets are contained in the entity's largest.
    """
    as_set = F.array_sort(F.array_distinct(attributes))
    kinds = written(items.select(entity, as_set.alias("_s"), F.col(key).alias("_k")).groupBy(entity, "_s").agg(F.min("_k").alias("_k")), "sets")
    each = kinds.select(entity, "_s", "_k", F.explode("_s").alias("_x"))
    n = each.groupBy(entity, "_x").agg(F.count(F.lit(1)).alias("_c"))
    rarest = each.join(n, [entity, "_x"]).groupBy(entity, "_s").agg(F.min(F.struct("_c", "_x"))["_x"].alias("_x"))
    wide = each.select(entity, "_x", F.col("_s").alias("_wide"), F.col("_k").alias("_leader"))
    best = lambda s, k: F.min(F.struct((-F.size(s)).alias("n"), F.col(k).alias("leader")))["leader"].alias("leader")
    found = rarest.join(wide, [entity, "_x"]).where((F.size("_wide") >= F.size("_s")) & (F.size(F.array_except("_s", "_wide")) == 0)).groupBy(entity, "_s").agg(best("_wide", "_leader"))
    none = kinds.where("size(_s) = 0").select(entity, "_s").join(kinds.groupBy(entity).agg(best("_s", "_k")), entity)
    return items.withColumn("_s", as_set).join(found.unionByName(none), [entity, "_s"]).select(key, "leader")


def person_codes(events: DataFrame, code: Column, root: Column, person: str = "person_id") -> DataFrame:
    """Each person's distinct codes and distinct roots, sorted."""
    return events.groupBy(person).agg(F.array_sort(F.collect_set(code)).alias("codes"), F.array_sort(F.collect_set(root)).alias("roots"))


def root_table(events: DataFrame, code: Column, root: Column) -> DataFrame:
    """root, and its distinct codes."""
    return events.groupBy(root.alias("root")).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def unused_roots(scope: DataFrame, used: DataFrame, root: str = "root") -> DataFrame:
    """The roots of ``scope`` that no code uses."""
    return scope.select(root).distinct().join(used.select(root).distinct(), root, "left_anti")


def least_common(events: DataFrame, code: Column, n: int) -> DataFrame:
    return events.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy("n", "code").limit(n)


def id_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many ids are in both tables and in one alone: one row."""
    side = lambda df, name: df.select(key).dropna().distinct().withColumn(name, F.lit(1))
    both = side(left, "_a").join(side(right, "_b"), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(n(a & b).alias("n_both"), n(a & ~b).alias("n_left_only"), n(~a & b).alias("n_right_only"))


def concept_map(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct (source_value, internal_code) pairs out of several tables, each with its two columns' names."""
    return reduce(DataFrame.union, [df.select(F.col(a).cast("string").alias("source_value"), F.col(b).cast("string").alias("internal_code")) for df, a, b in sources]).distinct()
