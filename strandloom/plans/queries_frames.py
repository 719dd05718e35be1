"""Queries of the table helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import documents, frames
from ..state import written
from .registry import register
from .tables import DX, EV, TOK, diagnoses, events, table


@register("match_criteria", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def match(spark, sf):
    return frames.match(table(spark, sf, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@register("first_matching_codes", f"WITH {DX}, p AS (SELECT code, row_number() OVER (PARTITION BY person_id ORDER BY code) AS r FROM dx WHERE code LIKE '3%') SELECT DISTINCT code FROM p WHERE r <= 2")
def first_codes(spark, sf):
    d = diagnoses(spark, sf).groupBy("person_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return frames.matching_codes(d, "codes", lambda c: c.startswith("3"), 2)


@register("rows_without_codes", f"WITH {DX} SELECT person_id, count(*) AS n FROM dx GROUP BY 1 HAVING max((code IN ('105.1', '210.2', '007.1'))::INT) = 0")
def pruned(spark, sf):
    d = diagnoses(spark, sf).groupBy("person_id").agg(F.collect_list("code").alias("codes"), F.count(F.lit(1)).alias("n"))
    return frames.without_codes(d, "codes", ["105.1", "210.2", "007.1"]).select("person_id", "n")


@register("first_row_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_row(spark, sf):
    return frames.first_per_key(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("labels_supported", "SELECT sum((c_mktsegment = 'BUILDING')::INT) > 20 AND sum((c_mktsegment = 'MACHINERY')::INT) > 20 AS supported FROM customer")
def supported(spark, sf):
    return frames.supported(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], 20)


@register("segment_at_times", f"WITH {EV} SELECT doc_id, CAST((t > DATE '2024-01-10') AS INT) + CAST((t > DATE '2024-01-20') AS INT) AS segment, count(*) AS n FROM ev GROUP BY ALL")
def segments(spark, sf):
    return frames.segment_at(events(spark, sf), ["2024-01-20", "2024-01-10"]).groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@register("tokens_indexed", f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS i FROM c QUALIFY i <= 300) SELECT CASE WHEN i IS NULL THEN 'unknown' ELSE token END AS token, CAST(coalesce(i, 301) AS INT) AS index, count(*) AS n FROM tok LEFT JOIN v USING (token) GROUP BY 1, 2")
def indexed(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(C.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    t = written(t, "times")  # texts are split once
    return frames.apply_vocabulary(t, documents.vocabulary(t, "token", 300, "times")).groupBy("token", "index").agg(F.sum("times").alias("n"))


@register("cluster_members", "SELECT n_regionkey AS cluster, array_to_string(list_sort(list(n_nationkey)), ',') AS members FROM nation GROUP BY 1")
def members(spark, sf):
    m = frames.members(table(spark, sf, "nation"), "n_regionkey", "n_nationkey")
    return m.select(F.col("n_regionkey").alias("cluster"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@register("codes_polarized", f"WITH {DX} SELECT DISTINCT code, split_part(code, '.', 1) = '105' AS positive FROM dx")
def polarized(spark, sf):
    return frames.polarized(diagnoses(spark, sf), "code", C.text_root(F.col("code")), "105.1")


@register("merged_tables", "SELECT o_custkey AS k, n, c, a FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT c_custkey, c_nationkey AS c FROM customer) ON c_custkey = o_custkey JOIN (SELECT user_id, count(*) AS a FROM events GROUP BY 1) ON user_id = o_custkey")
def merged(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("c"))
    a = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    return frames.merge_all([n, c, a], "k")


@register("feature_pivot_auc")
def cross_validated(spark, sf):
    """Logistic regression on simple text features, five folds: iterative, so no SQL."""
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("length"), F.size(C.words(F.col("text"))).cast("double").alias("words"))
    x = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).join(d, "doc_id")
    x = written(x, "features")  # each fold and fit reads these few numbers, not the texts
    return spark.createDataFrame([(frames.cross_validated_auc(x, ["length", "words"], "label", 3),)], "auc double")
