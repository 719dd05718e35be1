"""State between steps, kept as Parquet in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session gets a temporary folder where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: lineage is cut, lost executors cost their tasks only, and the planner knows the size."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: list, weight: Column | None = None) -> DataFrame:
    """``df`` with the running sum of ``weight`` (1 a row) up to each row inside its group, ``_upto``, and the group's sum, ``_n``.

    Rows are dealt to tasks by ranges of (keys, order), so a group of any size is spread over tasks. Sums run inside a
    group's part of a task; the sums of these parts (a row a group and task that it is in) tell where each starts. Keys
    may be null. ``order`` must tell a group's rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    dealt = written(dealt.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = dealt.withColumn("_run", F.sum("_w").over(inside)).drop("_w")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_s"))
    group = Window.partitionBy(*(keys or [F.lit(1)]))  # its parts, a row a task
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_s").over(group))
    other = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_before", "_n")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    found = runs.join(other, on).withColumn("_upto", F.col("_before") + F.col("_run"))
    return found.drop("_part", "_p", "_run", "_before", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, order: list, name: str = "index", start: int = 0) -> DataFrame:
    """``df`` with each row's place in a total ``order``, without sorting in one task.

    Rows are dealt to tasks by ranges of the order and ranked inside them; the ranges' sizes (a row a task) give the
    offsets. ``order`` must tell all rows apart.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranked = written(dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1), "ranked")
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a task
    offsets, at = [], start
    for r in sizes:
        offsets.append((r["_part"], at))
        at += r["n"]
    first = spark.createDataFrame(offsets, "_part int, _first bigint")
    return ranked.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_rank")).drop("_part", "_rank", "_first")
