"""Readers, writers and the streams."""

import datetime as dt

from pyspark.sql import functions as F

from strandloom.operators import documents, sampling, stats
from strandloom.sources import readers, writers
from strandloom.streaming import sessions

D = dt.date


def test_timed_documents(spark, tmp_path):
    rows = [([[(D(2020, 1, 1), "a"), (D(2020, 1, 1), "b")], [(D(2020, 2, 1), "a")]],), ([[(D(2021, 1, 1), "c")]],)]
    df = spark.createDataFrame(rows, "visits array<array<struct<t:date,code:string>>>")
    writers.write_timed_documents(df, str(tmp_path / "d"))
    back = readers.read_timed_documents(spark, str(tmp_path / "d"))
    assert sorted(str(r.visits) for r in back.collect()) == sorted(str(r.visits) for r in df.collect())
    assert sorted(r.codes for r in readers.per_patient(back).collect()) == [["a", "b", "a"], ["c"]]
    assert readers.per_visit(back).count() == 3


def test_document_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, [(D(2020, 1, 1), "250.00"), (D(2020, 1, 2), "x")], "L")], "person_id long, events array<struct<t:date,code:string>>, label string")
    writers.write_documents(df, str(tmp_path / "c"))
    r = readers.read_documents(spark, str(tmp_path / "c"), "labeled").first()
    assert (r.codes, r.times, r.label, r.source_type) == (["250.00", "x"], [D(2020, 1, 1), D(2020, 1, 2)], "L", "labeled")


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("person_id,NKF_Stage,CaseControlUnknownStatus\n1,Stage 1,Case\n2,,Unknown\n")
    assert readers.read_annotated(spark, str(tmp_path / "a.csv"), ["Case", "Control"]).count() == 1
    (tmp_path / "i.tsv").write_text("250.00\tDiabetes\nheader\tno\nV10\tHistory\n")
    assert sorted(r.code for r in readers.read_code_descriptions(spark, str(tmp_path / "i.tsv")).collect()) == ["250.00", "V10"]


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_new(spark.range(5), path, "id")
    writers.append_new(spark.range(8), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def test_policies(spark):
    df = spark.createDataFrame([(1, [(D(2020, 1, 1), "a")], "L"), (2, [], "L")], "doc_id long, events array<struct<t:date,code:string>>, label string")
    assert documents.filter_documents(df, "empty").count() == 1
    got = {r.doc_id: r for r in documents.filter_documents(df, "unknown", 1).collect()}
    assert got[2].events[0].code == "unknown" and got[2].label == "unknown" and got[1].label == "L"
    v = spark.createDataFrame([([["a", "b"], ["c"]],)], "visits array<array<string>>")
    assert sorted(r.sentence for r in documents.unroll(v).collect()) == ["a c", "b c"]


def test_no_spread_no_outliers(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (5, 5, 5, 5, 5, 5, 9)], "code string, value double")
    assert stats.lab_stats(df, ["code"], "value").first().n_sample == 7


def test_draws(spark):
    got = sampling.draws(spark.range(10), "id", 30)
    assert got.count() == 30 and got.collect() == got.collect()


def test_stream_counts_like_a_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(path)
    stream = sessions.window_counts(sessions.read_events(spark, path))
    q = stream.writeStream.format("memory").queryName("day_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(path).groupBy(F.to_date("ts"), "event_type").count()
    assert spark.table("day_counts").count() == batch.count()
    assert spark.table("day_counts").agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()
