"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest (with map-side
combine), sort-merge anti-joined with the index, and only unseen digests are appended. Running a batch twice appends
nothing the second time, so a job that was cut off can simply be run again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, one_of_each, shuffle_partitions, split


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far and the document kept for each, at ``path`` (a folder all executors reach).

    ``buckets`` fixes the layout when the index is made; on a cluster choose it so that a bucket fits a task.
    Sessions find an existing index by its path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or shuffle_partitions(spark)
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (digest, keep_id; digests distinct) that the index lacks."""
        unseen = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        # written aside first: a table can't be read and appended to in one job
        new = materialise(unseen.select("digest", "keep_id"), "unseen")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)


def resolve(docs: DataFrame, index: DigestIndex) -> tuple[DataFrame, DataFrame]:
    """Digests of the rows of ``docs`` (doc_id, digest), and of the texts that occur more than once or that the index knew: digest, keep_id, n, was. Appends the new digests.

    Hot digests: groups are counted with partial aggregation, and the only join that carries every row has a plain
    shuffle on both sides, which adaptive execution splits.
    """
    seen = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    groups = materialise(seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "groups")
    old = index.rows().select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("was"))
    resolved = groups.hint("merge").join(old, "digest", "left").select("digest", F.when(F.col("was"), F.col("old_id")).otherwise(F.col("first_id")).alias("keep_id"), "n", F.coalesce("was", F.lit(False)).alias("was"))
    shared = materialise(resolved.where("n > 1 or was"), "shared")
    index.append(groups.select("digest", F.col("first_id").alias("keep_id")))
    return seen, shared


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate ``docs`` (doc_id, text, ...) against ``index`` and append its new digests.

    Returns one row per input row, dropped ones too: doc_id, keep_id, group_size (equal rows in this batch), kept,
    text_sha256. The row that stays is the one the index already has, else the smallest doc_id of the batch. Null
    texts count as empty. Rows that repeat a doc_id and text are one document: they share ``kept``. Null ids are kept
    only in groups without any other id. An empty batch gives no rows. Other columns are ignored.
    """
    seen, shared = resolve(docs, index)
    found = seen.join(shared.select("digest", "keep_id", "n"), "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row of each text that ``index`` did not have; columns unchanged.

    Of rows of equal texts the one of the smallest doc_id stays, null ids last; of rows that repeat an id and a text
    just one. Rows that repeat an id with different texts are different documents.
    """
    index = index or DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    seen, shared = resolve(docs, index)
    known = seen.join(shared.select("digest", "keep_id", "was").hint("merge"), "digest")
    known = materialise(known.select("doc_id", "digest", (F.col("was") | ~F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("goes")), "known")
    gone = known.where("goes").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_gone"))
    again = known.where("not goes").groupBy(F.col("digest").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = docs
    if gone.take(1):
        # by their ids most rows are told to stay, without a digest and without a shuffle
        may, others = split(docs, docs["doc_id"].cast("long"), gone.select("_id"))
        same = (digest(may["text"]) == gone["_gone"]) & may["doc_id"].cast("long").eqNullSafe(gone["_id"])
        left = others.union(may.join(gone.hint("merge"), same, "left_anti"))
    return one_of_each(left, digest(F.col("text")), again)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return ingest(docs, DigestIndex(spark, fresh_path(spark, "digest-index")))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
