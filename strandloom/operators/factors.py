"""Truncated factorisations of sparse matrices (i, j, value) by joins, and what is made of them: co-clusters, word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..state import numbered, written
from .clustering import lloyd, nearest_centre
from .features import cosine, word_slices


def _start(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """id and x: ``width`` numbers between -1 and 1 that are a function of id and seed."""
    u = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k)) / F.lit(2.0**63)
    return ids.select("id", F.array(*[u(k) for k in range(width)]).alias("x"))


def _times(entries: DataFrame, by: str, to: str, x: DataFrame, width: int) -> DataFrame:
    """The product of the matrix (or its transpose) with ``x`` (id, x): sums by ``to`` after a join on ``by``."""
    rows = entries.join(x.withColumnRenamed("id", by), by)
    sums = rows.groupBy(F.col(to).alias("id")).agg(*[F.sum(F.col("value") * F.get("x", F.lit(k))).alias(f"_{k}") for k in range(width)])
    return written(sums.select("id", F.array(*[f"_{k}" for k in range(width)]).alias("x")), "product")


def _gram(x: DataFrame, width: int) -> np.ndarray:
    """x'x: one row of width (width + 1) / 2 sums."""
    pairs = [(a, b) for a in range(width) for b in range(a, width)]
    row = x.agg(*[F.sum(F.get("x", F.lit(a)) * F.get("x", F.lit(b))) for a, b in pairs]).first()
    out = np.zeros((width, width))
    for (a, b), v in zip(pairs, row):
        out[a, b] = out[b, a] = v or 0.0
    return out


def _turned(x: DataFrame, m: np.ndarray) -> DataFrame:
    """Each row's vector times the small matrix ``m``."""
    cell = lambda k: sum((F.get("x", F.lit(a)) * float(m[a, k]) for a in range(m.shape[0])), F.lit(0.0))
    return x.select("id", F.array(*[cell(k) for k in range(m.shape[1])]).alias("x"))


def _orthonormal(x: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """``x`` turned so that its columns are orthonormal (those of no weight become 0), and the singular values it had."""
    m, s = _turn(_gram(x, width))
    return _turned(x, m), s


#: Columns of a matrix whose vectors every task may hold.
BROADCAST_ROWS = 100_000


def truncated_svd(entries: DataFrame, rank: int, more: int = 4, iterations: int = 30, tolerance: float = 1e-8, seed: int = 7, columns: DataFrame | None = None) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The largest ``rank`` singular values, and the left and right vectors: id and x of each i and each j of ``entries`` (i, j, value).

    Subspace iteration on ``rank`` + ``more`` vectors, until the values move by less than ``tolerance`` of the largest.
    With up to ``BROADCAST_ROWS`` columns (all ids of j, where known: ``columns``) the entries are dealt by row once and
    a step reads them in place; the columns' vectors are all that is sent. With more, a step is two joins and sums of
    the entries, and only sums of width x width numbers reach the driver.
    """
    width = rank + more
    if columns is None:
        entries = written(entries, "entries")
        columns = entries.select(F.col("j").alias("id")).distinct()
    columns = written(columns, "columns")
    if columns.count() <= BROADCAST_ROWS:
        return _svd_by_rows(entries, columns, rank, width, iterations, tolerance, seed)
    entries, before = written(entries.groupBy("i", "j").agg(F.sum("value").alias("value")), "entries"), None
    right, _ = _orthonormal(_start(columns, width, seed), width)
    for _ in range(iterations):
        left, _ = _orthonormal(_times(entries, "j", "i", right, width), width)
        right, s = _orthonormal(_times(entries, "i", "j", left, width), width)
        if before is not None and np.abs(s - before)[:rank].max() <= tolerance * max(s[0], 1e-300):
            break
        before = s
    image = _times(entries, "j", "i", right, width)  # its columns are singular vectors times values
    left, s = _orthonormal(image, width)
    back = _times(entries, "i", "j", left, width)
    right = _turned(back, np.diag(np.where(s > s[0] * 1e-10, 1 / np.maximum(s, 1e-300), 0)))
    head = lambda x: x.select("id", F.slice("x", 1, rank).alias("x"))
    return s[:rank], head(left), head(right)


def _turn(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that makes columns with these products orthonormal (those of no weight become 0), and their singular values."""
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    s = np.sqrt(np.maximum(values[order], 0))
    return vectors[:, order] * np.where(s > max(s[0], 1e-300) * 1e-10, 1 / np.maximum(s, 1e-300), 0), s


def _images(b: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of a batch's entries (i, at, value; a row of the matrix each), and each row times ``x``."""
    at, value = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
    size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
    y = np.zeros((len(size), x.shape[1]))
    if len(size):
        y = np.add.reduceat(value[:, None] * x[at], np.cumsum(size) - size, axis=0)  # no row is empty
    return at, value, y


def _svd_by_rows(entries: DataFrame, columns: DataFrame, rank: int, width: int, iterations: int, tolerance: float, seed: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """``truncated_svd`` with every row of the matrix in one place.

    A row's image is made and sent back through the row at once: A'(A x) needs no join. What is left of a step are the
    sums by column that each task made, and the images' products, by which the sums are turned as the images would be.
    """
    spark = entries.sparkSession
    columns = written(numbered(columns, ["id"], "at").withColumn("at", F.col("at").cast("int")), "columns")
    rows = entries.join(F.broadcast(columns.withColumnRenamed("id", "j")), "j").groupBy("i").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))
    rows = written(rows, "rows")
    n, kind = columns.count(), rows.schema["i"].dataType.simpleString()

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of the images A x (width x width), and A'(A x)."""
        sent = spark.sparkContext.broadcast(x)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            gram, back = np.zeros((width, width)), np.zeros((len(x), width))
            for b in batches:
                at, value, y = _images(b, x)
                gram += y.T @ y
                times = np.repeat(np.arange(len(y)), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
                for k in range(width):
                    back[:, k] += np.bincount(at, value * y[times, k], len(x))
            used = np.flatnonzero(back.any(axis=1))
            at = np.concatenate([used, -1 - np.arange(width)])  # below 0: rows of the products
            both = np.concatenate([back[used], gram])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(both[:, k].copy()) for k in range(width)]], names=["at", *[f"x{k}" for k in range(width)]])

        sums = rows.mapInArrow(each, "at int, " + ", ".join(f"x{k} double" for k in range(width))).groupBy("at").agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(width)])
        gram, back = np.zeros((width, width)), np.zeros((n, width))
        for r in sums.toLocalIterator():  # a row a column
            if r["at"] < 0:
                gram[-1 - r["at"]] = r[1:]
            else:
                back[r["at"]] = r[1:]
        sent.unpersist()
        return gram, back

    start = np.zeros((n, width))
    for r in _start(columns, width, seed).join(F.broadcast(columns), "id").select("at", "x").toLocalIterator():
        start[r["at"]] = r["x"]
    right, before = start @ _turn(start.T @ start)[0], None
    for _ in range(iterations):
        gram, back = step(right)
        back = back @ _turn(gram)[0]
        m, s = _turn(back.T @ back)
        right = back @ m
        if before is not None and np.abs(s - before)[:rank].max() <= tolerance * max(s[0], 1e-300):
            break
        before = s
    gram, back = step(right)
    m, s = _turn(gram)
    sent = spark.sparkContext.broadcast((right, m[:, :rank]))

    def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, m = sent.value
        for b in batches:
            y = _images(b, x)[2] @ m
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * m.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "x"])

    left = written(rows.mapInArrow(image, f"id {kind}, x array<double>"), "left")
    back = (back @ m @ np.diag(np.where(s > s[0] * 1e-10, 1 / np.maximum(s, 1e-300), 0)))[:, :rank]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(back.tolist())], "at int, x array<double>")
    return s[:rank], left, columns.join(F.broadcast(found), "at").select("id", "x")


def coclusters(entries: DataFrame, k: int, seed: int = 7, **options) -> DataFrame:
    """side ('i' or 'j'), id and cluster: rows and columns of ``entries`` (i, j, value >= 0) clustered together.

    Entries are divided by the roots of their row's and column's sums; the singular vectors after the first, divided by
    the same roots, place rows and columns in one space, in which k-means finds ``k`` clusters.
    """
    d = [written(entries.groupBy(F.col(c).alias("id")).agg(F.sqrt(F.sum("value")).alias("root")), "roots") for c in ("i", "j")]
    of = lambda c, x: x.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
    scaled = entries.join(of("i", d[0]), "i").join(of("j", d[1]), "j").select("i", "j", (F.col("value") / F.col("_i") / F.col("_j")).alias("value"))
    n = 1 + max(1, int(np.ceil(np.log2(k))))
    _, left, right = truncated_svd(scaled, n, seed=seed, columns=d[1].select("id"), **options)
    place = F.transform(F.slice("x", 2, n - 1), lambda v: v / F.col("root"))
    both = [x.join(roots, "id").select(F.lit(c).alias("side"), F.col("id").cast("string").alias("id"), place.alias("x")) for c, x, roots in zip("ij", (left, right), d)]
    spots = written(both[0].unionByName(both[1]), "spots")
    centres = lloyd(spots.withColumn("key", F.concat_ws(":", "side", "id")), "key", "x", k, seed=seed)
    return spots.select("side", "id", nearest_centre(F.col("x"), centres).alias("cluster"))


def cooccurrences(documents: DataFrame, tokens: str, window: int) -> DataFrame:
    """x, y, n: how often two tokens stand at most ``window`` places apart in a document's array; both orders are counted.

    A task counts the pairs of many documents at once, whichever word comes first, so what is dealt out are each
    task's distinct pairs; both orders are made from the sums.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, word, _, names in word_slices(batches):
            pairs = []
            for o in range(1, window + 1):
                i = np.flatnonzero(row[:-o] == row[o:])
                pairs.append(np.minimum(word[i], word[i + o]) * len(names) + np.maximum(word[i], word[i + o]))
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            for at in range(0, len(pair), 100_000):
                x, y = np.divmod(pair[at : at + 100_000], len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(n[at : at + 100_000])], names=["x", "y", "n"])

    kind = documents.schema[tokens].dataType.elementType.simpleString()
    one = documents.select(F.lit(0), tokens).mapInArrow(each, f"x {kind}, y {kind}, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    row = lambda a, b, n: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), n.alias("n"))
    both = F.when(F.col("x").eqNullSafe(F.col("y")), F.array(row("x", "y", F.col("n") * 2))).otherwise(F.array(row("x", "y", F.col("n")), row("y", "x", F.col("n"))))
    return one.select(F.explode(both).alias("p")).select("p.*")


def pair_totals(documents: DataFrame, tokens: str, window: int) -> DataFrame:
    """x, n: the sum of n over the ``cooccurrences`` of x, from places alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, word, _, names in word_slices(batches):
            n = np.zeros(len(names), np.int64)
            for o in range(1, window + 1):
                i = np.flatnonzero(row[:-o] == row[o:])
                n += np.bincount(word[i], minlength=len(names)) + np.bincount(word[i + o], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(n)], names=["x", "n"])

    kind = documents.schema[tokens].dataType.elementType.simpleString()
    return documents.select(F.lit(0), tokens).mapInArrow(each, f"x {kind}, n long").groupBy("x").agg(F.sum("n").alias("n"))


def positive_pmi(counts: DataFrame, at_least: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """x, y, n, pmi: ln(n N / (n_x n_y)) where positive, of pairs seen ``at_least`` times; marginals are over all pairs.

    ``totals`` (x, n) are the marginals where these are known (``pair_totals``; the counts then are of both orders): pairs
    seen less often are not kept for them.
    """
    seen = F.col("n") >= at_least
    counts = written(counts.where(seen) if totals is not None else counts, "pairs")
    margin = (lambda c: counts.groupBy(c).agg(F.sum("n").alias(f"_{c}"))) if totals is None else (lambda c: totals.select(F.col("x").alias(c), F.col("n").alias(f"_{c}")))
    totals = None if totals is None else written(totals, "totals")
    total = (counts if totals is None else totals).agg(F.sum("n").alias("_all"))  # one row
    found = counts.where(seen).join(margin("x"), "x").join(margin("y"), "y").crossJoin(F.broadcast(total))
    return found.withColumn("pmi", F.ln(F.col("n").cast("double") * F.col("_all") / (F.col("_x").cast("double") * F.col("_y")))).where("pmi > 0").select("x", "y", "n", "pmi")


def word_vectors(pmi: DataFrame, rank: int, **options) -> DataFrame:
    """token and vector: the left singular vectors of the PMI matrix times the roots of the singular values."""
    s, left, _ = truncated_svd(pmi.select(F.col("x").alias("i"), F.col("y").alias("j"), F.col("pmi").alias("value")), rank, **options)
    return _turned(left, np.diag(np.sqrt(s))).select(F.col("id").alias("token"), F.col("x").alias("vector"))


def pair_similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (x, y, ...) whose tokens both have a vector, with their cosine."""
    of = lambda c: vectors.select(F.col("token").alias(c), F.col("vector").alias(f"_{c}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").withColumn("similarity", cosine(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def shuffled_pairs(pairs: DataFrame, seed: int = 53) -> DataFrame:
    """As many pairs (x, y) as given, with the second ends dealt anew by hash: what chance would pair."""
    from .sampling import hashed

    x = numbered(pairs.select("x", F.col("y").alias("_own")), ["x", "_own"], "_at").drop("_own")
    y = numbered(pairs.select(F.col("x").alias("_own"), "y").withColumn("_h", hashed(F.concat_ws(" ", "_own", "y"), seed)), ["_h", "y", "_own"], "_at").select("_at", "y")
    return x.join(y, "_at").select("x", "y")


