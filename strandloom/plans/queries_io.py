"""Queries that write a table in an exchange format to the shared folder and answer from what they read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import documents, features
from ..sources import readers, writers
from ..state import shared_dir
from .queries_more import IS9, IS10, ISMED
from .registry import register
from .tables import CODE, DX, EV, TOK, diagnoses, events, table


IS_DIAGNOSIS, IS_DRUG = f"({IS9} OR {IS10})", ISMED


def fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/strandloom/{name}-{uuid.uuid4().hex}"


def csv(df, path, sep="|"):
    df.write.csv(path, sep=sep, header=True)
    return path


@register("timed_document_files", f"WITH {EV}, d AS (SELECT doc_id, string_agg(code, ' ' ORDER BY t, event_id) AS codes, count(DISTINCT t) AS visits FROM ev GROUP BY 1) SELECT md5(codes) AS codes, visits FROM d")
def timed_files(spark, sf):
    """Users' events as a line a user, in visits."""
    e = events(spark, sf).groupBy("doc_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "code"))), lambda x: x["code"]).alias("c"))
    visit = F.transform("c", lambda c: F.struct(F.col("t").alias("t"), c.alias("code")))
    rows = e.select("doc_id", F.struct("t", visit.alias("v")).alias("x")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("visits"))
    path = fresh(spark, "timed")
    writers.write_timed_documents(rows, path)
    back = readers.read_timed_documents(spark, path)
    n = readers.per_visit(back).groupBy("doc_id").agg(F.count(F.lit(1)).alias("visits"))
    return readers.per_patient(back).join(n, "doc_id").select(F.md5(F.array_join("codes", " ")).alias("codes"), "visits")


@register("document_files", f"WITH {DX} SELECT person_id, count(*) AS n, arg_min(code, (t, row_id, code)) AS first, CAST(min(t) AS VARCHAR) AS since, CAST(max(t) AS VARCHAR) AS until, max(c_mktsegment) AS label, 'labeled' AS source_type FROM dx JOIN customer ON c_custkey = person_id GROUP BY 1")
def document_files(spark, sf):
    """Customers' coded documents with labels as CSV."""
    rows = documents.build(diagnoses(spark, sf).select("person_id", "t", "row_id", "code"), ["t", "row_id"], "person_id")
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("label"))
    path = fresh(spark, "documents")
    writers.write_documents(rows.join(labels, "person_id"), path)
    d = readers.read_documents(spark, path, "labeled")
    day = lambda c: c.cast("string")
    return d.select("person_id", F.size("codes").cast("long").alias("n"), F.get("codes", F.lit(0)).alias("first"), day(F.array_min("times")).alias("since"), day(F.array_max("times")).alias("until"), "label", "source_type")


@register("source_table_files", f"WITH {DX}, {EV} SELECT 'condition' AS kind, count(*) AS n, count(DISTINCT person_id) AS persons, CAST(sum(len(code)) AS BIGINT) AS size FROM dx UNION ALL SELECT 'drug', count(*), count(DISTINCT person_id), CAST(sum(len('NDC:' || split_part(code, '.', 1))) AS BIGINT) FROM dx UNION ALL SELECT 'measurement', count(*), count(DISTINCT doc_id), CAST(sum(len(code)) AS BIGINT) FROM ev WHERE value > 10")
def source_files(spark, sf):
    """Condition, drug and measurement tables with their schemas: codes stay text, dates are dates."""
    d, e = diagnoses(spark, sf), events(spark, sf)
    tables = {
        "condition": (d.select("person_id", F.col("t").alias("condition_start_date"), F.col("code").alias("condition_source_value"), F.lit(1).alias("condition_concept_id")), "condition_source_value"),
        "drug": (d.select("person_id", F.col("t").alias("drug_exposure_start_date"), F.concat(F.lit("NDC:"), C.text_root(F.col("code"))).alias("drug_source_value"), F.lit(1).alias("drug_concept_id")), "drug_source_value"),
        "measurement": (e.select(F.col("doc_id").alias("person_id"), F.col("t").alias("measurement_date"), F.lit("00:00").alias("measurement_time"), F.col("value").alias("value_as_number"), F.col("code").alias("value_source_value")), "value_source_value"),
    }
    found = []
    for kind, (df, code) in tables.items():
        back = readers.read_table(spark, kind, csv(df, fresh(spark, kind)))
        back = back.where("value_as_number > 10") if kind == "measurement" else back
        found.append(back.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"), F.sum(F.length(code)).alias("size")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("concept_lookup_file", f"SELECT DISTINCT {CODE} AS concept_code, p_name AS concept_name FROM part WHERE {CODE} IN ('001', '015', '029', '029.29', '1')")
def concept_file(spark, sf):
    concepts = table(spark, sf, "part").select(F.expr(CODE).alias("concept_code"), F.col("p_name").alias("concept_name"))
    back = readers.read_table(spark, "concept", csv(concepts, fresh(spark, "concept")))
    return readers.lookup(back, ["001", "015", "029", "029.29", "1"])


@register("annotated_cohort_file", "SELECT c_custkey AS person_id, c_mktsegment AS NKF_Stage, CASE c_nationkey % 3 WHEN 0 THEN 'Case' WHEN 1 THEN 'Control' ELSE 'Unknown' END AS CaseControlUnknownStatus FROM customer WHERE c_nationkey % 3 < 2")
def annotated_file(spark, sf):
    status = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'Case' WHEN 1 THEN 'Control' ELSE 'Unknown' END")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("NKF_Stage"), status.alias("CaseControlUnknownStatus"))
    return readers.read_annotated(spark, csv(c, fresh(spark, "cohort"), ","), ["Case", "Control"])


@register("code_description_file", f"SELECT {CODE} AS code, p_type AS description FROM part WHERE regexp_matches({CODE}, '^[VE]?\\d')")
def description_file(spark, sf):
    p = table(spark, sf, "part").select(F.expr(CODE).alias("code"), F.col("p_type").alias("description"))
    path = fresh(spark, "descriptions")
    p.write.csv(path, sep="\t")
    return readers.read_code_descriptions(spark, path)


@register("edge_file", "SELECT c_custkey AS source_id, 1000000 + c_nationkey AS destination_id, 'is a' AS rel_text FROM customer WHERE c_custkey % 2 = 1")
def edge_file(spark, sf):
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), (F.lit(1_000_000) + F.col("c_nationkey")).cast("long").alias("destination_id"), F.lit("is a").alias("rel_text"), (F.col("c_custkey") % 2).cast("int").alias("active"))
    return readers.read_table(spark, "edges", csv(e, fresh(spark, "edges"), "\t")).where("active = 1").drop("active")


@register("sparse_matrix_files", f"WITH {TOK} SELECT doc_id, token AS feature, count(*)::DOUBLE AS value FROM tok GROUP BY 1, 2")
def sparse_files(spark, sf):
    """Document x token counts in long form, with the vocabulary beside it."""
    t = features.word_counts(table(spark, sf, "documents"), C.words(F.col("text")), token="feature").withColumn("value", F.col("n").cast("double"))
    path = fresh(spark, "sparse")
    writers.write_sparse(t, path)
    return features.with_words(readers.sparse(spark, path), spark.read.parquet(f"{path}/vocabulary"), "df", "feature").select("doc_id", "feature", "value")


@register("training_set_files", "SELECT l_orderkey * 10 + l_linenumber AS index, l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1, l_returnflag AS target FROM lineitem WHERE l_returnflag <> 'N'")
def training_files(spark, sf):
    """A training table by class folders: a class that isn't wanted is not read."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"), F.col("l_quantity").cast("double").alias("f0"), F.col("l_discount").cast("double").alias("f1"), F.col("l_returnflag").alias("target"))
    path = fresh(spark, "training")
    writers.write_training_set(li, path, ["target"])
    return readers.read_training_set(spark, path).where("target <> 'N'").select("index", "f0", "f1", "target")


@register("incremental_appends", "SELECT doc_id, CAST(min(round) AS INT) AS round FROM (SELECT doc_id, 1 AS round FROM labels UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY 1")
def appends(spark, sf):
    """Two runs into one table: the second adds only documents that the first left out, and again adds none."""
    path = fresh(spark, "appends")
    first = table(spark, sf, "labels").select("doc_id").distinct().withColumn("round", F.lit(1))
    second = table(spark, sf, "documents").select("doc_id").distinct().withColumn("round", F.lit(2))
    for rows in (first, second, second):
        writers.append_new(rows, path, "doc_id")
    return spark.read.parquet(path)


@register("terminology_folder", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def folder(spark, sf):
    """A terminology's CSV files read by name, all columns as text, and joined."""
    path = fresh(spark, "terminology")
    for name in ("nation", "region"):
        csv(table(spark, sf, name), f"{path}/{name}.csv", ",")
    t = readers.folder_tables(spark, path, ["nation", "region"])
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@register("pattern_table_file", f"WITH {EV}, p AS (SELECT doc_id, code, lead(code) OVER (PARTITION BY doc_id ORDER BY t, event_id) AS next FROM ev) SELECT code || ' ' || next AS ngram, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1")
def pattern_file(spark, sf):
    from ..operators import patterns
    from .tables import codes_of

    path = fresh(spark, "patterns")
    writers.write_patterns(patterns.count_ngrams(codes_of(spark, sf), 2, 2).select("ngram", "n"), path)
    return spark.read.schema("ngram string, n long").csv(path, sep="|", header=True)


@register("timed_document_kinds", f"WITH p AS (SELECT p_partkey, {CODE} AS code, p_partkey % 9 AS part FROM part), k AS (SELECT *, CASE WHEN {IS_DIAGNOSIS} THEN 'diag' WHEN {IS_DRUG} THEN 'drug' WHEN regexp_matches(code, '^\\d+$') THEN 'lab' ELSE 'other' END AS kind FROM p WHERE NOT contains(code, ' ')) SELECT code, count(*) AS n FROM k WHERE kind IN ('diag', 'drug') GROUP BY 1")
def timed_kinds(spark, sf):
    """Codes of two content types, out of two folders of timed documents read together."""
    p = table(spark, sf, "part").select("p_partkey", F.expr(CODE).alias("code")).where("not contains(code, ' ')")
    paths = []
    for half in (0, 1):
        own = p.where(F.col("p_partkey") % 2 == half).groupBy((F.col("p_partkey") % 9).alias("part")).agg(F.collect_list(F.struct(F.to_date(F.lit("2020-01-02")).alias("t"), "code")).alias("v"))
        paths.append(fresh(spark, "kinds"))
        writers.write_timed_documents(own.select(F.array("v").alias("visits")), paths[-1])
    back = readers.read_timed_documents(spark, paths, ["diag", "drug"])
    return readers.per_patient(back).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
