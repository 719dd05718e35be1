"""From documents to a training table in one run: counted once, weighted, made vectors, joined with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..state import written
from .features import idf_smooth, with_words


def token_counts(tokens: DataFrame, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """doc, token and n, written: what follows reads a row a document and word, not a row a place."""
    return written(tokens.groupBy(doc, token).agg(F.count(F.lit(1)).alias("n")), "counts")


def weighted_bag(counts: DataFrame, n_docs: int, min_df: int = 1, max_share: float = 1.0, size: int | None = None, doc: str = "doc_id", token: str = "token") -> tuple[DataFrame, DataFrame]:
    """A sparse tf-idf matrix (doc, feature, value), each document's vector of length 1, and its vocabulary (token, n, index from 1).

    Words of fewer than ``min_df`` documents or of over a share ``max_share`` of them are left out; of the others the
    ``size`` most frequent are kept. idf is ln((1 + n_docs) / (1 + df)) + 1.
    """
    df = counts.groupBy(token).agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("_n")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))
    df = written(df, "frequencies")
    order = [F.desc("_n"), F.col(token)]
    if size:
        words = df.orderBy(*order).limit(size).withColumn("index", F.row_number().over(Window.orderBy(*order)))  # ``size`` rows
        words = words.select(F.col(token).alias("token"), F.col("_n").alias("n"), "index", "df")
    else:
        words = vocabulary_of(df, token)
    words = written(words, "vocabulary")
    raw = counts.join(words.select(F.col("token").alias(token), "index", "df"), token)
    raw = raw.select(doc, F.col("index").alias("feature"), (F.col("n") * idf_smooth(F.lit(n_docs), F.col("df"))).alias("_v"))
    held = raw.groupBy(doc).agg(F.collect_list(F.struct("feature", "_v")).alias("_f"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_l"))  # a document's words
    return held.select(doc, "_l", F.explode("_f").alias("_p")).select(doc, "_p.feature", (F.col("_p._v") / F.col("_l")).alias("value")), words.drop("df")


def vocabulary_of(df: DataFrame, token: str) -> DataFrame:
    from ..state import numbered

    found = numbered(df, [F.desc("_n"), F.col(token)], start=1)
    return found.select(F.col(token).alias("token"), F.col("_n").alias("n"), F.col("index").cast("int").alias("index"), "df")


def mean_word_vectors(counts: DataFrame, vectors: DataFrame, n_docs: int | None = None, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """doc and vector: the mean of its words' vectors, weighted by their counts, or by tf-idf if ``n_docs`` is given. Documents without a known word go."""
    weight: Column = F.col("n").cast("double")
    if n_docs is not None:
        weight = weight * idf_smooth(F.lit(n_docs), F.col("df"))
    df = counts.groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    known = written(df.join(vectors.select(F.col("token").alias(token), "vector"), token), "known")  # a row a word
    rows = with_words(counts, known, "df", token).withColumn("_w", weight)
    parts = rows.select(doc, "_w", F.posexplode("vector").alias("i", "x")).groupBy(doc, "i").agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("x"))
    return parts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))  # a row a coordinate


def dense(bag: DataFrame, size: int, doc: str = "doc_id") -> DataFrame:
    """doc and vector: the ``size`` features of a sparse matrix as an array, 0 where there is none."""
    held = bag.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))  # at most ``size`` entries
    return held.select(doc, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))


def training_set(vectors: DataFrame, labels: DataFrame, label: str, size: int, doc: str = "doc_id") -> DataFrame:
    """index, f0, f1, ... and target: a row a document that has both a vector of ``size`` numbers and a label."""
    rows = vectors.join(labels.select(doc, F.col(label).alias("target")), doc).where(F.col("target").isNotNull() & (F.size("vector") == size))
    return rows.select(F.col(doc).alias("index"), *[F.get("vector", F.lit(i)).alias(f"f{i}") for i in range(size)], "target")
