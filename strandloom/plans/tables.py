"""The driver's tables in the shapes the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, doc_id, t, code, value: user events."""
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("doc_id"), F.to_date("ts").alias("t"), F.col("event_type").alias("code"), "value")


def diagnoses(spark: SparkSession, sf: str) -> DataFrame:
    """person_id, t, code ('123.4'), row_id: order lines as coded conditions."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"), F.to_date("o_orderdate").alias("t"))
    code = F.concat(F.lpad(((F.col("l_partkey") * 7) % 900).cast("string"), 3, "0"), F.lit("."), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", code.alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("person_id", "t", "code", "row_id")


def codes_of(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, codes: a user's events in order."""
    rows = events(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "code"))).alias("e"))
    return rows.select("doc_id", F.transform("e", lambda x: x["code"]).alias("codes"))


#: A code for each part, in one of fourteen spellings, as SQL that both engines read.
_THREE, _TWO, _ONE = "lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')", "lpad(CAST(p_partkey % 100 AS STRING), 2, '0')", "CAST(p_partkey % 10 AS STRING)"
_SPELLINGS = (f"concat({_THREE}, '.', {_TWO})", _THREE, f"concat({_THREE}, {_TWO})", f"concat('V', {_TWO}, '.', {_ONE})", f"concat('E', {_THREE}, '.', {_ONE})", f"concat('C', {_TWO}, '.', {_ONE})", "concat('NDC:', lpad(CAST(p_partkey AS STRING), 8, '0'))", "concat('med:', CAST(p_partkey AS STRING))", f"concat('250.', {_ONE}, CAST(p_partkey % 4 AS STRING))", f"concat('648.', {_ONE})", f"concat('I10:C', {_TWO})", "concat(p_type, '  ', p_brand)", f"concat({_THREE}, '.')", f"concat('I9:', {_THREE}, '.', {_ONE})")
CODE = "CASE p_partkey % 14 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SPELLINGS)) + " END"
CODED = f"c AS (SELECT {CODE} AS code FROM part)"


def coded_parts(spark: SparkSession, sf: str) -> DataFrame:
    """code: one for each part."""
    return table(spark, sf, "part").select(F.expr(CODE).alias("code"))


EV = "ev AS (SELECT event_id, user_id AS doc_id, CAST(ts AS DATE) AS t, event_type AS code, value FROM events)"
DX = "dx AS (SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS t, lpad(CAST((l_partkey * 7) % 900 AS VARCHAR), 3, '0') || '.' || l_linenumber AS code, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[-0-9a-z_:.]+')) AS token FROM documents)"
EV_POS = EV + ", pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, event_id) AS pos FROM ev)"
DX_POS = DX + ", dpos AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY t, row_id, code) AS pos FROM dx)"
