"""Common subsequences of a group's documents: derived from pairs, filtered, counted, and turned into features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import udfs
from . import patterns
from ..state import placed, written
from .sampling import hashed


def pairs(docs: DataFrame, n: int | None = None, policy: str = "random", doc: str = "doc_id", label: str | None = None, seed: int = 53) -> DataFrame:
    """Pairs a < b of documents (doc, codes), of one label if given: [label,] a, b, codes_a, codes_b.

    Documents stand in an order, of a hash or the longest first, and each is paired with the ``n`` that come next. So
    every document is in some pair, there are about n pairs a document however many there are, and no others are made.
    Without ``n`` all pairs, for a stated, bounded sample.
    """
    keys = [label] if label else []
    side = lambda df, c, *more: df.select(*keys, F.col(doc).alias(c), F.col("codes").alias(f"codes_{c}"), *more)
    if n is None:
        a, b = side(docs, "a"), side(docs, "b")
        return a.join(b, [*keys]).where("a < b") if keys else a.join(b, F.col("a") < F.col("b"))
    order = [F.desc(F.size("codes")), F.col(doc)] if policy.startswith("long") else [hashed(F.col(doc), seed), F.col(doc)]
    dealt = written(placed(docs.select(*keys, doc, "codes"), keys, order), "order")
    first = side(dealt, "a", F.explode(F.sequence(F.col("_upto") + 1, F.col("_upto") + n)).alias("_at"))
    both = first.join(side(dealt, "b", F.col("_upto").alias("_at")), [*keys, "_at"])
    swap = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x)
    return both.select(*keys, swap("a", "b"), swap("b", "a"), swap("codes_a", "codes_b"), swap("codes_b", "codes_a"))


def derive(docs: DataFrame, sample: DataFrame, n_pairs: int | None = None, at_least: int = 2, at_most: int = 20, min_df: int = 1, min_uniq: int = 1, doc: str = "doc_id", label: str | None = None, permutations: bool = True) -> DataFrame:
    """Common subsequences of the sample's ``pairs``: [label,] lcs, items, length, n_uniq, n (pairs that gave it) and df over all of ``docs``.

    Runs of one code count once; those shorter than ``at_least``, longer than ``at_most`` or of fewer than ``min_uniq``
    codes go. Without ``permutations`` those of the same codes in another order are one, of all their pairs, named by
    the first. df is counted over every document, by containment; those below ``min_df`` go.
    """
    keys = [label] if label else []
    found = pairs(sample, n_pairs, doc=doc, label=label).select(*keys, udfs.lcs("codes_a", "codes_b").alias("items"))
    return table_of(found, docs, at_least, at_most, min_df, min_uniq, doc, label, permutations)


def subsets(docs: DataFrame, k: int, rounds: int, doc: str = "doc_id", label: str | None = None, seed: int = 53) -> DataFrame:
    """Sets of ``k`` documents, of one label if given: [label,] round, subset, sequences. In a round every document is in one set; those left over in no set.

    A round stands the documents in an order of its own, by hash, and cuts it, so sets are random and repeatable.
    """
    keys = [label] if label else []
    found = None
    for r in range(rounds):
        dealt = placed(docs.select(*keys, doc, "codes"), keys, [hashed(F.col(doc), seed + r), F.col(doc)])
        cut = dealt.withColumn("subset", F.floor((F.col("_upto") - 1) / k)).where((F.col("subset") + 1) * k <= F.col("_n"))
        part = cut.groupBy(*keys, F.lit(r).alias("round"), "subset").agg(F.transform(F.array_sort(F.collect_list(F.struct("_upto", "codes"))), lambda x: x["codes"]).alias("sequences"))
        found = part if found is None else found.unionByName(part)
    return found


def derive_many(docs: DataFrame, k: int, rounds: int = 1, at_least: int = 2, at_most: int = 20, min_df: int = 1, min_uniq: int = 1, doc: str = "doc_id", label: str | None = None, permutations: bool = True, seed: int = 53) -> DataFrame:
    """``derive`` with the common subsequences of random sets of ``k`` documents in place of pairs; n counts sets."""
    keys = [label] if label else []
    found = subsets(docs, k, rounds, doc, label, seed).select(*keys, udfs.lcs_many("sequences").alias("items"))
    return table_of(found, docs, at_least, at_most, min_df, min_uniq, doc, label, permutations)


def table_of(found: DataFrame, docs: DataFrame, at_least: int, at_most: int, min_df: int, min_uniq: int, doc: str, label: str | None, permutations: bool) -> DataFrame:
    """The table of ``derive`` from common subsequences ([label,] items), one a row."""
    keys = [label] if label else []
    found = found.select(*keys, S.collapse_runs(F.col("items")).alias("items"))
    table = found.where(F.size("items").between(at_least, at_most) & (F.size(F.array_distinct("items")) >= min_uniq)).groupBy(*keys, "items").agg(F.count(F.lit(1)).alias("n"))
    if not permutations:
        table = table.groupBy(*keys, F.array_sort("items").alias("_same")).agg(F.min("items").alias("items"), F.sum("n").alias("n")).drop("_same")
    table = written(table, "subsequences").withColumn("lcs", F.array_join("items", " ")).withColumn("length", F.size("items")).withColumn("n_uniq", F.size(F.array_distinct("items")))
    kinds = table.select(F.col("lcs").alias("pattern_id"), F.col("items").alias("pattern")).distinct()
    df = patterns.document_counts(docs.select(F.col(doc).alias("doc_id"), "codes"), kinds).withColumnRenamed("pattern_id", "lcs")
    return table.join(df, "lcs").where(F.col("df") >= min_df).select(*keys, "lcs", "items", "length", "n_uniq", "n", "df")


def set_key(items: Column) -> Column:
    """The sorted distinct items as one text: the same for all orders and repeats."""
    return F.array_join(F.array_sort(F.array_distinct(items)), " ")


def by_df(table: DataFrame, top: int, min_df: int = 2, descending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Patterns of at least ``min_df`` documents, the ``top`` of them by df; of equal ones by text."""
    kept = table.where(F.col("df") >= min_df)
    order = F.desc("df") if descending else F.asc("df")
    return patterns.first_of(kept, keys, [order, "lcs"], top) if keys else kept.orderBy(order, "lcs").limit(top)


def select_set(table: DataFrame, top: int | None = None, kind: str = "enriched", criteria: list[str] = ("n",)) -> DataFrame:
    """The patterns sorted by ``criteria``, falling if ``kind`` is enriched and rising if it is rare; the first ``top``."""
    way = F.desc if kind == "enriched" else F.asc
    found = table.orderBy(*[way(c) for c in criteria], "lcs")
    return found.limit(top) if top else found


def occurrences(docs: DataFrame, kinds: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, pattern_id, tf: how often a pattern (pattern_id, pattern) starts a match in each document that contains it."""
    found = patterns.containing(docs, kinds, doc)
    return found.select(doc, "pattern_id", F.size(S.match_positions(F.col("pattern"), F.col("codes"))).alias("tf"))


def tfidf(counts: DataFrame, n_docs: int, doc: str = "doc_id") -> DataFrame:
    """tf (ln((1 + n) / (1 + df)) + 1) of each document and pattern: a long, sparse table."""
    df = counts.groupBy("pattern_id").agg(F.countDistinct(doc).alias("df"))
    return counts.join(df, "pattern_id").withColumn("tfidf", F.col("tf") * (F.ln((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))


def ranked(counts: DataFrame, n_docs: int, top: int, doc: str = "doc_id") -> DataFrame:
    """The ``top`` patterns by their tf over all documents times idf."""
    total = counts.groupBy("pattern_id").agg(F.sum("tf").alias("tf"), F.countDistinct(doc).alias("df"))
    return total.withColumn("score", F.col("tf") * (F.ln((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)).orderBy(F.desc("score"), "pattern_id").limit(top)


def members_with(rows: DataFrame, popular: DataFrame, cluster: str, doc: str, ngram: str = "ngram", at_least: int = 1) -> DataFrame:
    """A cluster's members that hold at least so many of its popular n-grams (cluster, ngram)."""
    hit = rows.join(popular.select(cluster, ngram).distinct(), [cluster, ngram], "left_semi")
    return hit.groupBy(cluster, doc).agg(F.countDistinct(ngram).alias("n_popular")).where(F.col("n_popular") >= at_least)


def recall(local: DataFrame, overall: DataFrame, cluster: str, ngram: str = "ngram") -> DataFrame:
    """The share of all n-grams that each cluster has."""
    n = overall.agg(F.countDistinct(ngram).alias("n_all"))  # one row
    return local.groupBy(cluster).agg(F.countDistinct(ngram).alias("n")).crossJoin(F.broadcast(n)).withColumn("recall", F.col("n") / F.col("n_all"))
