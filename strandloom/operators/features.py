"""Weights, vectors and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..state import written


def idf_smooth(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


def idf_log10(n: Column, df: Column) -> Column:
    return F.log10((n + 1) / (df + 1)) + 1


def idf_plain(n: Column, df: Column) -> Column:
    return F.ln(n / df) + 1


def document_frequencies(tokens: DataFrame, doc: str = "doc_id", token: str = "token") -> DataFrame:
    counts = tokens.groupBy(doc, token).agg(F.count(F.lit(1)).alias("_n"))  # a row a document and word, before the second sum
    return counts.groupBy(token).agg(F.count(F.lit(1)).alias("df"), F.sum("_n").alias("tf"))


#: Words of documents that a task counts at once; a longer document is taken by itself.
SLICE_WORDS = 4_000_000


def word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Slices of whole documents (id, words): of each word its document's place in the slice and its own in the dictionary; the ids; the dictionary, in order."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, side="right")))
            words = b.column(1).slice(at, end - at).flatten().dictionary_encode(null_encoding="encode")
            order = pc.sort_indices(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            yield np.repeat(np.arange(end - at), sizes[at:end]), rank[words.indices.to_numpy(zero_copy_only=False)], b.column(0).slice(at, end - at), words.dictionary.take(pa.array(order))
            at = end


def word_counts(docs: DataFrame, words: Column, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """doc, token and n (long) of documents with an array of ``words``, a document's rows one after the other.

    A row's words are counted in the row, so nothing is shuffled; only rows that share a doc with others are put together first.
    """
    kinds = [docs.schema[doc].dataType.simpleString(), docs.select(words.alias("w")).schema["w"].dataType.elementType.simpleString()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, word, ids, names in word_slices(batches):
            pair, n = np.unique(row * max(len(names), 1) + word, return_counts=True)
            for at in range(0, len(pair), 100_000):
                row, word = np.divmod(pair[at : at + 100_000], len(names))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), names.take(pa.array(word)), pa.array(n[at : at + 100_000])], names=[doc, token, "n"])

    counted = lambda rows: rows.mapInArrow(each, f"`{doc}` {kinds[0]}, `{token}` {kinds[1]}, n long")
    rows = docs.select(doc, words.alias("_words"))
    again = written(docs.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(doc).alias("_again")), "again")
    if not again.take(1):
        return counted(rows)
    same = F.col(doc).eqNullSafe(F.col("_again"))
    parts = rows.join(again, same, "left_semi").select(doc, F.explode("_words").alias(token)).groupBy(doc, token).agg(F.count(F.lit(1)).alias("n"))
    return counted(rows.join(again, same, "left_anti")).unionByName(parts)


#: Words whose rows of a table every task may hold.
BROADCAST_WORDS = 100_000


def with_words(rows: DataFrame, table: DataFrame, often: str, token: str = "token") -> DataFrame:
    """``rows`` joined with the rows of ``table`` (one a token), in which ``often`` says how many rows have the token.

    The most frequent words, which most rows have, are broadcast; only rows of rarer words are shuffled.
    """
    order = [F.desc(often), F.col(token)]
    head = written(table.orderBy(*order).limit(BROADCAST_WORDS), "frequent")
    n = head.count()
    if n < BROADCAST_WORDS:
        return rows.join(F.broadcast(head), token)
    known = F.broadcast(head.select(token))
    rare = rows.join(known, token, "left_anti").join(table.join(known, token, "left_anti"), token)
    return rows.join(F.broadcast(head), token).unionByName(rare)


def tfidf_l2(counts: DataFrame, group: str, term: str, n: str) -> DataFrame:
    """tf-idf of terms by group with unsmoothed idf, each group's vector of length 1 (long format, no pivot)."""
    groups = counts.agg(F.countDistinct(group).alias("n_groups"))  # one row
    df = counts.groupBy(term).agg(F.countDistinct(group).alias("df"))
    raw = counts.join(df, term).crossJoin(F.broadcast(groups)).withColumn("raw", F.col(n) * idf_plain(F.col("n_groups"), F.col("df")))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(group)))
    return raw.withColumn("tfidf", F.col("raw") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


#: Queries that are sent to the tasks together, and rows that a task scores against them at once.
QUERY_BLOCK, ROW_BLOCK = 4_096, 256


def _matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of one length (short ones filled with 0, long ones cut), their norms and own lengths (-1 of a null)."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < width
    out[row[inside], at[inside]] = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)[inside]
    size[vectors.is_null().to_numpy(zero_copy_only=False)] = -1
    out[size < 0] = np.nan
    return out, np.sqrt((out * out).sum(axis=1)), size


def _scored(rows: DataFrame, queries: DataFrame, key: str, vector: str, block: int, k: int | None = None) -> DataFrame:
    """query_id, neighbour_id and distance (cosine) of ``queries``, a stated set, and all other ``rows``. Keys are integers.

    Rows stay where they are: queries are sent to the tasks in blocks dealt by hash, one block at a time passing through
    the driver, and a task takes products of some rows' matrix with a block's. No vector is shuffled. With ``k`` only
    those pairs leave it that are among a query's k nearest of what the task has met so far, at six digits. A pair with a
    null or zero vector, or of two lengths, has null.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType
    n, many = max(1, -(-queries.count() // block)), ROW_BLOCK
    pick = lambda df: df.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))
    found = []
    for at in range(n):
        part = pick(queries if n < 2 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == at)).toArrow().combine_chunks()
        asked, vectors = (part.column(c).combine_chunks() for c in ("i", "v"))
        sent = spark.sparkContext.broadcast((asked.to_numpy(), *_matrix(vectors)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, a, a_norm, a_size = sent.value
            best = np.full((len(asked), k or 0), np.inf)  # the k nearest so far
            for batch in batches:
                for low in range(0, len(batch) if len(asked) else 0, many):
                    some = batch.slice(low, many)
                    ids, (b, b_norm, b_size) = some.column(0).to_numpy(), _matrix(some.column(1), a.shape[1])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1 - (a @ b.T) / (a_norm[:, None] * b_norm[None, :])
                    d[a_size[:, None] != b_size[None, :]] = np.nan
                    other = asked[:, None] != ids[None, :]
                    if k is not None:
                        best = np.partition(np.concatenate([best, np.where(other & ~np.isnan(d), d, np.inf)], axis=1), k - 1, axis=1)[:, :k]
                        other &= np.isnan(d) | (d <= best.max(axis=1)[:, None] + 2e-6)
                    i, j = np.nonzero(other)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(ids[j]), pa.array(d[i, j], from_pandas=True)], names=["query_id", "neighbour_id", "distance"])

        found.append(pick(rows).mapInArrow(score, "query_id long, neighbour_id long, distance double"))
    return reduce(DataFrame.unionByName, found).select(F.col("query_id").cast(kind), F.col("neighbour_id").cast(kind), F.round("distance", 6).alias("distance"))


def nearest_to(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of each query by cosine distance, nearest first, of equal ones the smaller key.

    Every row is scored against every query of the stated set (see ``_scored``); a task keeps its own nearest, and the
    cut to k is made over these.
    """
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return _scored(rows, queries, key, vector, block, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_vector(tokens: DataFrame, vectors: DataFrame, token: str, doc: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """Mean (or weighted mean) vector of a document's tokens that have one, element by element."""
    w = weight if weight is not None else F.lit(1.0)
    rows = tokens.join(vectors, token).select(doc, w.alias("_w"), F.posexplode("vector").alias("i", "x"))
    parts = rows.groupBy(doc, "i").agg((F.sum(F.col("x") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("x"))
    return parts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    scaled = F.coalesce((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn(f"{column}_scaled", scaled).drop("_lo", "_hi")


def density(df: DataFrame, value: str, grid: list[float], bandwidth: float) -> DataFrame:
    """Gaussian kernel density on a grid: each row adds to every grid point inside one aggregation, nothing is multiplied out."""
    k = lambda g: F.avg(F.exp(-0.5 * F.pow((F.col(value) - g) / bandwidth, 2.0)) / (bandwidth * 2.5066282746310002))
    wide = df.agg(*[k(g).alias(f"g{i}") for i, g in enumerate(grid)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(float(g)).alias("x"), F.col(f"g{i}").alias("density")) for i, g in enumerate(grid)])).alias("p")).select("p.*")


def bag_of_centroids(tokens: DataFrame, cluster_of: DataFrame, clusters: list[int], token: str = "token", doc: str = "doc_id") -> DataFrame:
    """doc x number of its tokens in each word cluster (token, cluster), 0 where there are none."""
    often = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("_n"))
    known = written(cluster_of.join(often, token), "clusters")  # a row a word
    found = with_words(tokens.select(doc, token), known, "_n", token).groupBy(doc)
    return found.agg(*[F.count(F.when(F.col("cluster") == c, 1)).alias(f"c{c}") for c in clusters])


def cluster_means(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Each cluster's size and mean vector, summed element by element before anything is gathered."""
    parts = rows.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(cluster).agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))


def gap(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_mean(rows: DataFrame, means: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``rows`` with the cluster of the nearest of ``means`` (cluster, mean; a row a cluster), of equal ones the smaller."""
    all_ = F.broadcast(means.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), F.col("mean").alias("m")))).alias("_means")))  # one row
    near = F.array_min(F.transform("_means", lambda m: F.struct(F.round(gap(F.col(vector), m["m"]), 6).alias("d"), m["c"].alias("c"))))
    return rows.crossJoin(all_).withColumn(cluster, near["c"]).drop("_means")


def nearest_members(rows: DataFrame, means: DataFrame, cluster: str, key: str, vector: str, k: int) -> DataFrame:
    """The k members of each cluster next to its mean (squared Euclidean distance), of equal ones the smaller key."""
    near = rows.join(means.select(cluster, "mean"), cluster).select(cluster, key, F.round(gap(F.col(vector), F.col("mean")), 6).alias("distance"))
    w = Window.partitionBy(cluster).orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def standardize(df: DataFrame, column: str) -> DataFrame:
    """(x - mean) / population deviation; 0 without spread."""
    one = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))  # one row
    scaled = F.coalesce((F.col(column) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(one)).withColumn(f"{column}_standard", scaled).drop("_m", "_s")


def distances(rows: DataFrame, queries: DataFrame, key: str, vector: str, measure: Callable[[Column, Column], Column] | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """a (of ``queries``, a stated set), b (any other row) and their distance: cosine, or by ``measure``. Queries are taken in blocks."""
    if measure is None:
        return _scored(rows, queries, key, vector, block).toDF("a", "b", "distance")
    n = -(-queries.count() // block)
    found = []
    for i in range(max(n, 1)):
        part = queries if n < 2 else queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
        q = F.broadcast(part.select(F.col(key).alias("a"), F.col(vector).alias("_q")))
        found.append(rows.join(q, F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.round(measure(F.col("_q"), F.col(vector)), 6).alias("distance")))
    return reduce(DataFrame.unionByName, found)
