"""Stages that drop a few rows leave the texts of the others where they are."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import common, exact_dedup


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def texts(spark, n=1500, size=2000):
    rnd = random.Random(3)
    rows = [(i, rnd.randbytes(size // 2).hex(), f"x{i}") for i in range(n)]
    rows += [(n + i, rows[i][1], "again") for i in range(20)]
    return common.materialise(spark.createDataFrame(rows, "doc_id long, text string, `odd name.x` string"), "texts"), n


def test_dropping_texts_shuffles_few(no_broadcast):
    docs, n = texts(no_broadcast)
    gone = docs.where("doc_id < 5").select(common.text_key(F.col("text")).alias("key"))
    before = shuffled(no_broadcast)
    left = common.materialise(common.drop_texts(docs, gone), "left")
    assert shuffled(no_broadcast) - before < 300_000  # all texts have 3 MB
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == set(range(5, n)) | set(range(n + 5, n + 20))


def test_exact_copies_shuffle_few(no_broadcast):
    docs, n = texts(no_broadcast)
    before = shuffled(no_broadcast)
    left = common.materialise(exact_dedup.deduplicate(docs), "left")
    assert shuffled(no_broadcast) - before < 600_000
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == list(range(n))


def test_split_finds_all(spark):
    docs = spark.range(5000).select((F.when(F.col("id") % 7 != 0, F.col("id"))).alias("k"), F.col("id"))
    keys = common.materialise(spark.createDataFrame([(i,) for i in range(1, 4000, 9)] + [(None,)], "k long"), "keys")
    may, others = common.split(docs, docs["k"], keys)
    may, others = may.collect(), others.collect()
    assert len(may) + len(others) == 5000 and len(others) > 3500
    wanted = {None, *range(1, 4000, 9)}
    assert not [r for r in others if r.k in wanted] and {r.k for r in may if r.k in wanted} == {k for k in wanted if k is None or k % 7}
