"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to it, which comparing two MinHash sketches can't
see. Containment MinHash sketches the small set alone: the minimum of an item's shingles under each permutation is a
random shingle of the item, and the share of these that a document holds estimates how much of the item it contains,
whatever the document's length. Items are partitioned by size (powers of two of their distinct shingles): the sketch
grows with the partition up to a bound, and a document too small to hold the threshold's share of a partition's
smallest item isn't compared with it. Candidates are verified by the exact containment of all distinct shingles.

Native: only DataFrame functions. Permutation i of a 64-bit shingle hash is an exclusive or with a mask, so the
minimum under i is the shingle nearest to the mask.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_texts, materialise, table, text_key

WIDTH, THRESHOLD, PERMUTATIONS = 5, 0.8, 64
#: A candidate has this share of the sketch: half the threshold, far below what chance takes from a true containment.
SHARE = 0.4
#: Sketches and candidate ids are broadcast up to this many rows, by count; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """Hash of each run of ``width`` words, in order, repeats included; fewer words make one shingle, none none.

    ``w`` must be a plain column: an expression would be evaluated again for every shingle.
    """
    run = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), run)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def masks(n: int, seed: int = 7) -> list[int]:
    """Evenly spread in the top bits, so that no two permutations look for the same shingle first."""
    low = np.random.default_rng(seed).integers(0, 1 << 56, n, dtype=np.int64)
    top = np.linspace(0, 256, n, endpoint=False).astype(int) if n <= 256 else np.arange(n) % 256
    return [int(((int(a) << 56) | int(b)) - ((1 << 64) if a >= 128 else 0)) for a, b in zip(top, low)]


def sketches(item: DataFrame, permutations: int) -> DataFrame:
    """item_id, n, lowest size of the partition, size of the sketch, and a row for each of its shingles.

    A partition of items of up to 2^level shingles has min(2^level, permutations) permutations.
    """
    one = item.select("item_id", "n", "level", F.explode("s").alias("h"))
    nearest = [F.min(F.struct(F.col("h").bitwiseXOR(F.lit(m)).alias("d"), F.col("h").alias("h")))["h"] for m in masks(permutations)]
    mins = one.groupBy("item_id", "n", "level").agg(F.array(*nearest).alias("mins"))
    used = F.least(F.lit(permutations), F.pow(F.lit(2.0), F.col("level")).cast("int"))
    kept = mins.select("item_id", "n", "level", F.array_distinct(F.slice("mins", 1, used)).alias("sketch"))
    return kept.select("item_id", (F.floor(F.pow(F.lit(2.0), F.col("level") - 1)) + F.when(F.col("level") > 0, 1).otherwise(0)).cast("int").alias("lowest"), F.size("sketch").alias("size"), F.explode("sketch").alias("h"))


def contained(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, item_id, n_shingles (distinct, of the item), n_found (of them in the document), containment; pairs at ``threshold`` or over.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null and empty texts have no shingles and match nothing.
    An item of fewer words than ``width`` is one shingle, found only in documents of just these words. Rows that repeat
    an item_id are one item, of all their shingles; rows that repeat a doc_id are one document. Rows without an id are
    left out, of either table (``clean`` does see documents without one). No documents or no items give no rows. Other
    columns are ignored.
    """
    rows = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").select("item_id", F.explode(shingles(F.col("w"), width)).alias("h")).distinct()
    item = rows.groupBy("item_id").agg(F.collect_list("h").alias("s"))  # distinct shingles of one item
    item = materialise(item.select("item_id", "s", F.size("s").alias("n"), F.ceil(F.log2(F.size("s"))).cast("int").alias("level")), "items")
    wanted = materialise(sketches(item, permutations), "sketches")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    texts = docs.where("doc_id is not null").select("doc_id", words(F.col("text").cast("string")).alias("w"))
    runs = texts.select("doc_id", F.greatest(F.size("w") - width + 1, F.lit(1)).alias("room"), F.explode(shingles(F.col("w"), width)).alias("h"))
    hits = runs.join(wanted, "h").where(F.col("room") >= F.ceil(F.col("lowest") * threshold)).select("doc_id", "item_id", "size", "h").distinct()
    pairs = hits.groupBy("doc_id", "item_id", "size").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.col("size") * SHARE)
    pairs = materialise(pairs.select("doc_id", "item_id"), "candidates")

    # the exact check reads the documents once more, for the candidates alone
    ids = materialise(pairs.select(F.col("doc_id").alias("_id")).distinct(), "candidate-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    few = texts.join(ids, texts["doc_id"] == ids["_id"], "left_semi")
    there = few.select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), width))).alias("h")).distinct()
    asked = pairs.join(item.select("item_id", F.col("n").cast("long").alias("n_shingles"), F.explode("s").alias("h")), "item_id")
    found = there.join(asked, ["doc_id", "h"]).groupBy("doc_id", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_found"))
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item; columns unchanged. A row goes by its text, whether its id is null or repeats."""
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    return drop_texts(docs, contained(texts, items).select(F.col("doc_id").alias("key")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE '<' || array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
bs AS (
  SELECT DISTINCT item_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE '<' || array_to_string(w, ' ') END AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)
),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) / n_shingles::DOUBLE >= 0.8
"""
