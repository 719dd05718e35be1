"""Writers: Parquet is canonical, the text formats are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S


def write_timed_documents(documents: DataFrame, path: str) -> None:
    """visits (array<array<struct<t, code>>>) as text, a document a line."""
    documents.select(S.assemble(F.col("visits")).alias("value")).write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """person_id, events (array<struct<t, ..., code>>) and perhaps label as CSV."""
    seq = lambda f: F.array_join(F.transform("events", f), ",")
    label = F.col("label") if "label" in documents.columns else F.lit("unknown")
    rows = documents.select("person_id", seq(lambda e: e["code"]).alias("sequence"), seq(lambda e: F.date_format(e["t"], "yyyy-MM-dd")).alias("timestamp"), label.alias("label"))
    rows.write.mode("overwrite").csv(path, sep="|", header=True)


def write_training_set(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_sparse(df: DataFrame, path: str) -> None:
    """Long form doc_id, feature, value, and beside it the vocabulary, with the number of each feature's entries (df), made from the values that were written."""
    df.select("doc_id", "feature", "value").write.mode("overwrite").parquet(f"{path}/values")
    written = df.sparkSession.read.schema(df.select("feature").schema).parquet(f"{path}/values")
    written.groupBy("feature").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/vocabulary")


def write_patterns(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="|", header=True)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Add the rows whose key the table at ``path`` lacks: a run that was cut off goes on where it stopped."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # the first run: nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    df.join(done, key, "left_anti").write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.jdbc(url, name, mode="append", properties=options)
