"""Shared folders, materialisation and small helpers of the subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What this Python worker keeps between tasks, by operator: how to let it go.
_kept: dict[str, Callable[[], None]] = {}


def keep_only(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called as a task of ``owner`` begins: a worker is used again by other operators, whose caches would stay in its memory."""
    for name in [n for n in _kept if n != owner]:
        _kept.pop(name)()
    give_back()
    if clear:
        _kept[owner] = clear


def give_back() -> None:
    """Return freed memory to the system, where the C library can: an allocator keeps what earlier tasks of a worker have freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session, as in tests, gets a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner the true size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """MD5 of a text as 16 bytes; null counts as empty. It tells rows apart where ids are null or repeat."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


#: Bits a key in the table that ``split`` sends to tasks, and its bits at most (16 MB).
KEY_BITS, MOST_BITS = 32, 1 << 27


def split(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: the rows whose ``key`` may be among ``keys`` (one column, written, not empty), and others whose key is surely not.

    The hashes of ``keys`` go to the tasks as bitmaps, so rows of the second part need no shuffle to be told from those
    of a join. Few keys let few others through; how many doesn't depend on the planner's limits. Exact once the first
    part has been joined.
    """
    bits = min(MOST_BITS, max(1 << 15, KEY_BITS * keys.count()))
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    place = keys.select(at(F.col(keys.columns[0])).alias("_at"))
    maps = place.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    maps = materialise(maps, "bitmaps")
    marked = docs.join(F.broadcast(maps), F.bitmap_bucket_number(at(key)) == maps["_bucket"], "left")
    bit = F.bitmap_bit_position(at(key))
    byte = F.conv(F.hex(F.substring(maps["_map"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return marked.where(may).select(docs["*"]), marked.where(~may).select(docs["*"])


def drop_texts(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has its key in ``gone`` (key); columns unchanged, whatever the ids.

    Only rows that ``split`` can't tell apart are shuffled and compared with ``gone``.
    """
    gone = materialise(gone.select(F.col("key").alias("_gone")).distinct(), "gone")
    if not gone.take(1):
        return docs
    may, others = split(docs, text_key(docs["text"]), gone)
    return others.union(may.join(gone.hint("merge"), text_key(may["text"]) == gone["_gone"], "left_anti"))


def one_of_each(docs: DataFrame, key: Column, doubles: DataFrame) -> DataFrame:
    """``docs`` with one row for each ``key`` that is in ``doubles`` (key), all rows of others; columns unchanged.

    The row of the smallest doc_id stays, null ids last; of rows alike in that the one whose JSON sorts first. The
    rows of a key are reduced before they are shuffled, so one key may hold any share of them.
    """
    doubles = materialise(doubles.select(F.col("key").alias("_double")).distinct(), "doubles")
    if not doubles.take(1):
        return docs
    may, others = split(docs, key, doubles)
    marked = may.withColumn("_key", key)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.to_json(row)))
    several = marked.join(doubles, marked["_key"] == doubles["_double"], "left_semi").groupBy("_key").agg(first.alias("_row")).select("_row.*")
    return others.union(marked.join(doubles, marked["_key"] == doubles["_double"], "left_anti").drop("_key")).unionByName(several)
