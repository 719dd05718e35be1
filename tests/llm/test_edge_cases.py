"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing extra columns, and no rows."""

import pytest
from pyspark.sql import functions as F
from strandloom.llm import decontaminate, exact_dedup, html_extract, langid, lm_score, reshard, secrets, sentence_pieces, simhash, tool_calls
from strandloom.llm.common import fresh_path

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, "the same text here and more of it", "en", "a"), (4, "the same  text here\nand more of it", "en", "b"),
    (4, "the same  text here\nand more of it", "en", "b"), (5, LONG, "de", "a"), (None, "a text without an id", "en", "a"), (6, "日本   x", "fr", "a"), (7, " \t\n", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = "digest string, keep_id long, n long, w string, s string, target string, _id long, shard int, fp long, family int, h long, seed long, ids string, component_id long, _gone long"


@pytest.fixture(scope="module")
def docs(spark):
    n = len(EXTRA.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in ROWS], f"{SCHEMA}, {EXTRA}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact(spark, docs, none):
    got = exact_dedup.query(spark, docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[1].keep_id, by[2].keep_id, by[1].group_size) == (1, 1, 2)
    assert (by[3].kept, by[4].kept, by[4].keep_id, by[4].group_size) == (True, False, 3, 3)
    assert by[None].kept and by[None].keep_id is None
    assert exact_dedup.query(spark, none).count() == 0
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7]


def test_ids_that_are_null_or_repeat(spark):
    """A row goes by its text: rows without an id go where they should, and of rows that repeat an id and a text one stays."""
    many = [(None, "one text that is here again and again"), (None, "one text that is here again and again"), (1, "other words in another text altogether"), (1, "other words in another text altogether"), (1, "a third text under the same id as before"), (2, "other words in another  text altogether"), (None, None), (3, None)]
    df = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(many)], "doc_id long, text string, lang string, n long")
    rows = lambda found: sorted(r.n for r in found.collect())
    assert rows(exact_dedup.deduplicate(df)) == [0, 2, 4, 7]
    assert rows(simhash.deduplicate(df)) == [0, 2, 4, 6, 7]
    assert rows(langid.identified(df)) == [0, 1, 2, 3, 4, 5]
    items = spark.createDataFrame([(1, "here again and again"), (1, "here again and again"), (2, "words in another text altogether"), (None, "other words in another")], "item_id long, text string")
    assert rows(decontaminate.clean(df, items)) == [0, 1, 4, 6, 7]
    big = (1 << 60) + 1
    far = spark.createDataFrame([(None, "a text without an id"), (big, "another text with a very large id")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.query(spark, far).collect()} == {None, big}
    near = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(100)), "en", 0), (7, " ".join(f"w{i}" for i in range(99)), "en", 1), (7, " ".join(f"w{i}" for i in range(98)), "en", 2)], "doc_id long, text string, lang string, n long")
    assert len(rows(simhash.deduplicate(near))) == 1


def test_simhash(spark, docs, none):
    got = simhash.query(spark, docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[7].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[7].component_id == 1
    assert by[3].component_id == by[4].component_id == 3
    assert simhash.query(spark, none).count() == 0
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {1, 2, 3, 5, None, 6, 7}
    assert simhash.deduplicate(none).count() == 0


def test_language(spark, docs, none):
    got = {r.doc_id: r for r in langid.query(spark, docs).collect()}
    assert len(got) == len(ROWS) - 1
    assert [got[i].lang_pred for i in (1, 2, 7)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.query(spark, none).count() == 0
    assert {r.doc_id for r in langid.identified(docs).collect()} == {3, 4, 5, None, 6}


def test_secrets(spark, docs, none):
    assert secrets.query(spark, docs).count() == len(ROWS)
    assert secrets.query(spark, none).count() == 0


def test_scores(spark, docs, none):
    good = spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.score(lm_score.told_apart(docs, good)).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[7].n_tokens == 0 and got[1].score is None
    assert got[5].n_tokens == 30_000
    assert lm_score.score(lm_score.told_apart(none, good)).count() == 0
    assert lm_score.score(lm_score.told_apart(docs, good.where("false"))).count() == len(ROWS)


def test_shards(spark, docs, none):
    got = reshard.query(spark, docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.size for r in got}[1] == 16
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert reshard.query(spark, none).count() == 0


def test_pieces(spark, docs, none):
    path = sentence_pieces.default_path()
    found = sentence_pieces.encode(docs, path)
    back = sentence_pieces.decode(found, path).collect()
    want = {i: t or "" for i, t, *_ in ROWS}
    assert all(r.text == want[r.doc_id] for r in back)
    assert sum(r.doc_id == 1 for r in back) == 1
    assert sentence_pieces.encode(none, path).count() == 0


def test_containment(spark, docs, none):
    items = spark.createDataFrame([(1, "Same text here and more", "x"), (2, None, "x"), (3, "", "x"), (4, "x", "x"), (1, "Same text here and more", "x")], "item_id long, text string, w string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found, r.containment) for r in decontaminate.contained(docs, items).collect()}
    assert got == {(3, 1): (1, 1, 1.0), (4, 1): (1, 1, 1.0)}
    assert decontaminate.contained(none, items).count() == 0
    assert decontaminate.contained(docs, items.where("false")).count() == 0
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<p>" + "x " * 50_000, 1), (3, "u", "plain", 1), (None, "u", "<article><p>a &amp; b", 1)], "page_id long, url string, html string, text int")
    got = html_extract.query(spark, pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id is None] == ["a & b"]
    assert html_extract.query(spark, pages.where("false")).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", 'b"\n', 1), (1, 2, "user", None, 1), (None, 0, "user", "x", 1), (2, None, "assistant", "y", 1), (2, 0, None, "z", 1), (1, 0, "user", "a", 1)]
    got = tool_calls.query(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int"))
    by = {}
    for r in got.collect():
        by.setdefault(r.call_id, []).append(r)
    assert len(by["1:0"]) == 2 and by["1:0"][0].linked and by["1:0"][0].result_json == '{"content":"b\\"\\n","tool_call_id":"1:0"}'
    assert by["1:2"][0].problems == ["missing:text"] and by["1:2"][0].level == 1 and not by["1:2"][0].linked
    assert by[None][0].level is None and by["2:0"][0].problems == ["tool"]
    assert tool_calls.query(spark, got.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards_with_merged_plans(spark, docs, monkeypatch):
    """Beyond the bound of a broadcast the same rows come out; rewritten files keep every column."""
    want = sorted((str(r.doc_id), r.shard, r.slot) for r in reshard.query(spark, docs).collect())
    monkeypatch.setattr(reshard, "BROADCAST_ROWS", 0)
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in reshard.query(spark, docs).collect()) == want
    old = F.pmod(F.col("doc_id"), F.lit(3))
    plan = reshard.layout(docs, old, 4)
    folders = reshard.rewrite(docs, old, plan, fresh_path(spark, "files"))
    assert set(spark.read.parquet(*folders.values()).columns) >= {c for c in docs.columns if c != "shard"}
