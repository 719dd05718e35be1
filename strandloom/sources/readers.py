"""Readers: explicit schemas, no inference (codes such as '250.00' are strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.codes import token_class

# Schemas of the exchange tables, and the separator each is written with.
SCHEMAS = {
    "condition": ("person_id long, condition_start_date date, condition_source_value string, condition_concept_id long", "|"),
    "drug": ("person_id long, drug_exposure_start_date date, drug_source_value string, drug_concept_id long", "|"),
    "measurement": ("person_id long, measurement_date date, measurement_time string, value_as_number double, value_source_value string", "|"),
    "concept": ("concept_code string, concept_name string", "|"),
    "concept_map": ("source_value string, internal_code string", "|"),
    "annotated_cohort": ("person_id long, NKF_Stage string, CaseControlUnknownStatus string", ","),
    "document": ("person_id long, sequence string, timestamp string, label string", "|"),
    "edges": ("source_id long, destination_id long, rel_text string, active int", "\t"),
}


def read_table(spark: SparkSession, kind: str, path: str, columns: list[str] | None = None) -> DataFrame:
    schema, sep = SCHEMAS[kind]
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table in ``parts`` half-open ranges of ``key``, one task each."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def lookup(concepts: DataFrame, codes: list[str]) -> DataFrame:
    return concepts.where(F.col("concept_code").isin(*codes)).select("concept_code", "concept_name").distinct()


def read_timed_documents(spark: SparkSession, path: str | list[str], kinds: list[str] | None = None) -> DataFrame:
    """doc_id, visits (array<array<struct<t, code>>>), file of text files with a document a line; the id is a hash of the line's text and file.

    ``path`` is a file, a folder or several. ``kinds`` keeps the codes of some content types only (``codes.token_class``:
    diag, drug, lab, other); visits that are left without codes go.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).where(F.trim("line") != "")
    found = lines.select(F.xxhash64("file", "line").alias("doc_id"), S.parse(F.trim("line")).alias("visits"), "file")
    if kinds is None:
        return found
    own = lambda v: F.filter(v, lambda e: token_class(e["code"]).isin(*kinds))
    return found.withColumn("visits", F.filter(F.transform("visits", own), lambda v: F.size(v) > 0))


def per_visit(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode("visits").alias("visit", "events"))


def per_patient(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.transform(F.flatten("visits"), lambda e: e["code"]).alias("codes"))


def read_documents(spark: SparkSession, path: str, source_type: str = "source") -> DataFrame:
    """person_id, codes, times, label from CSV; ``source_type`` (source, labeled, augmented, raw) is kept as a column."""
    df = read_table(spark, "document", path)
    times = F.transform(F.split("timestamp", ","), lambda t: t.try_cast("date"))
    return df.select("person_id", F.split("sequence", ",").alias("codes"), times.alias("times"), F.coalesce("label", F.lit("unknown")).alias("label"), F.lit(source_type).alias("source_type"))


def read_annotated(spark: SparkSession, path: str, status: list[str] | None = None) -> DataFrame:
    df = read_table(spark, "annotated_cohort", path)
    return df.where(F.col("CaseControlUnknownStatus").isin(*status)) if status else df


def read_code_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """code and description from a tab-separated file; lines that don't start with a code go."""
    df = spark.read.schema("code string, description string").csv(path, sep="\t")
    return df.where(F.col("code").rlike(r"^[VE]?\d"))


def read_training_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sparse(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, feature, value, as ``write_sparse`` left them."""
    return spark.read.parquet(f"{path}/values")


def folder_tables(spark: SparkSession, folder: str, names: list[str], sep: str = ",") -> dict[str, DataFrame]:
    """The CSV files of a terminology by name, all columns as text."""
    return {n: spark.read.csv(f"{folder}/{n}.csv", header=True, sep=sep) for n in names}
