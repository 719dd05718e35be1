"""Ranked lexical search over a bit-sliced impact index.

The index is partitioned by documents: a block of documents holds, for each of its terms, which of them have it and how
often. A search gives each block the terms of all items with their weights. There an impact, a whole number for each
document and term, is laid out as bitmaps, one for each binary digit; an item's scores are the sum of its terms'
bitmaps by bitwise carry arithmetic, 64 documents an operation, and the best k are found from the most significant
bitmap down. No score of a document that isn't among a block's best is ever formed as a number, and only the best of
each task are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

#: Most documents and bytes of text in a block.
BLOCK_ROWS, BLOCK_BYTES = 16_384, 32_000_000
#: Items searched in one pass, at most, and their text; also the text of the terms that an index is told to keep to. Changes no result.
PASS_ITEMS, PASS_BYTES = 10_000, 8_000_000
#: Items whose slices are added at once: words of 64 documents in one bitmap of all of them.
WORDS = 1 << 15
#: Partial results of an item are first merged in so many groups.
SALTS = 32

_KEEP = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: UTF-8 bytes: A-Z in lower case, what is between terms as spaces.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, list[str]]]:
    """Ids and texts of each block; a task that is run again numbers them alike."""
    block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for i, text in zip(b["doc_id"], b["text"]):
            if texts and (len(texts) >= BLOCK_ROWS or size + len(text or "") > BLOCK_BYTES):
                yield block, ids, texts
                block, ids, texts, size = block + 1, [], [], 0
            ids.append(None if i is None else int(i))
            texts.append(text)
            size += len(text or "")
    if texts:
        yield block, ids, texts


def index(docs: DataFrame, only: frozenset[bytes] | None = None) -> DataFrame:
    """A row a block of ``docs`` (doc_id, text): block, ids (0 where null), none (whether null), n (terms with repeats), and by term: terms, df, places (in the block, 4 bytes each), tf (4 bytes each).

    All terms, or those in ``only``. Documents of a block stand in ascending order of id, null ids last.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, ids, texts in _blocks(batches):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            n, found = [], {}
            for place, i in enumerate(order):
                words = terms(texts[i])
                n.append(len(words))
                for term, times in Counter(words if only is None else filter(only.__contains__, words)).items():
                    at = found.setdefault(term, ([], []))
                    at[0].append(place)
                    at[1].append(times)
            names = sorted(found)
            whole = lambda k: np.array([x for t in names for x in found[t][k]], "<u4").tobytes()  # noqa: B023, E731
            yield pd.DataFrame({"block": [block], "ids": [[ids[i] or 0 for i in order]], "none": [[ids[i] is None for i in order]], "n": [n], "terms": [[t.decode("utf-8", "surrogatepass") for t in names]], "df": [[len(found[t][0]) for t in names]], "places": [whole(0)], "tf": [whole(1)]})

    # ids pass through pandas as text: beside nulls it would make them doubles
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInPandas(each, "block long, ids array<long>, none array<boolean>, n array<long>, terms array<string>, df array<long>, places binary, tf binary")


def slices_of(values: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (digit, word) of ``values`` at ``places``, least significant first."""
    digits = max(int(values.max(initial=0)).bit_length(), 1)
    out = np.zeros((digits, words * 64), np.uint8)
    out[:, places] = values[None, :].astype(np.uint64) >> np.arange(digits, dtype=np.uint64)[:, None] & np.uint64(1)
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def add(sums: np.ndarray, more: np.ndarray) -> None:
    """Adds the bitmaps ``more`` (digit, item, word) to ``sums``, which has digits enough: a ripple of full adders."""
    carry = np.zeros_like(sums[0])
    for s, m in zip(sums, more):
        half = s ^ m
        carry, kept = (s & m) | (carry & half), half ^ carry
        s[:] = kept
    for s in sums[len(more) :]:
        if not carry.any():
            return
        kept = s ^ carry
        carry &= s
        s[:] = kept


def best(sums: np.ndarray, k: int) -> np.ndarray:
    """Bitmap (item, word) of each item's k highest documents above 0; of equal ones those that come first."""
    sure, open_ = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums, axis=0)
    for s in sums[::-1]:
        more = sure | (open_ & s)
        many = np.bitwise_count(more).sum(axis=1, dtype=np.int64) > k
        # too many with this digit: the rest is out; else all of them are in and the rest stays open
        sure = np.where(many[:, None], sure, more)
        open_ = np.where(many[:, None], open_ & s, open_ & ~s)
    left = k - np.bitwise_count(sure).sum(axis=1, dtype=np.int64)
    for i in np.flatnonzero(np.bitwise_count(open_).sum(axis=1, dtype=np.int64) > 0):
        bits = np.unpackbits(open_[i].view(np.uint8), bitorder="little")
        bits[np.flatnonzero(bits)[left[i] :]] = 0
        sure[i] |= np.packbits(bits, bitorder="little").view("<u8")
    return sure


def block_scores(n: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], wanted: list[list[int]], weight: np.ndarray, n_docs: int, length: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Item, places and scores of the best k of a block. postings: by term the places and times; wanted: by item the terms."""
    words = -(-len(n) // 64)
    norm = 100 - 50 + np.array([50 * int(x) * n_docs // length for x in n], np.int64)
    laid: dict[int, np.ndarray] = {}

    def laid_out(t: int) -> np.ndarray:
        if t not in laid:
            places, tf = postings[t]
            tf = tf.astype(np.int64)
            laid[t] = slices_of(int(weight[t]) * (1_000_000_000 * tf // (1_000 * tf + 20 * norm[places])), places, words)
        return laid[t]

    having = [(i, own) for i, w in enumerate(wanted) if (own := [t for t in w if t in postings])]
    having.sort(key=lambda x: len(x[1]))  # items of like length are added together
    step = max(1, WORDS // words)
    for at in range(0, len(having), step):
        group = having[at : at + step]
        most = max(len(own) for _, own in group)
        digits = max(sum(1 << laid_out(t).shape[0] for t in own) for _, own in group).bit_length()
        sums = np.zeros((digits, len(group), words), np.uint64)
        for j in range(most):
            parts = [laid_out(own[j]) if j < len(own) else None for _, own in group]
            more = np.zeros((max(p.shape[0] for p in parts if p is not None), len(group), words), np.uint64)
            for g, p in enumerate(parts):
                if p is not None:
                    more[: len(p), g] = p
            add(sums, more)
        chosen = best(sums, k)
        for g, (i, _) in enumerate(group):
            places = np.flatnonzero(np.unpackbits(chosen[g].view(np.uint8), bitorder="little"))
            bits = sums[:, g, places // 64] >> (places % 64).astype(np.uint64) & np.uint64(1)
            yield i, places, (bits.astype(np.int64) << np.arange(digits, dtype=np.int64)[:, None]).sum(axis=0)


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct items in runs of bounded size; items stream to the driver, one run at a time."""
    run, size = [], 0
    for r in items.toLocalIterator():
        if run and (len(run) >= PASS_ITEMS or size + len(r["text"] or "") > PASS_BYTES):
            yield run
            run, size = [], 0
        run.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
    if run:
        yield run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` documents (doc_id, text) that score highest above 0 for each item (item_id, text).

    A document's score is the sum over the item's distinct terms of w x (10^9 tf div (1000 tf + 20 m)), where
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + 50 n N div L, N the documents with terms, L all terms, n the
    document's, df the documents that hold the term. Ties go by ascending doc_id; null ids come last and rows that
    repeat an id are documents of their own. Null and blank texts have no terms. Repeated items (id and text) count
    once; an item without terms found gives no rows. Other columns are ignored. Scores must be below 2^63, which holds
    for items of up to 10^8 terms.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    only = frozenset(t for r in items.select("text").toLocalIterator() for t in terms(r["text"])) if size <= PASS_BYTES else None
    blocks = materialise(index(docs, only), "impact-index")
    n_docs, length = blocks.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = materialise(blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")), "df")
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for run in _passes(items.distinct()):
        part = _search_pass(spark, blocks, df, run, n_docs, length, k, kind)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return found


def _search_pass(spark: SparkSession, blocks: DataFrame, df: DataFrame, run: list[tuple], n_docs: int, length: int, k: int, kind: str) -> DataFrame:
    """``search`` for a bounded run of items: their terms and weights are known to every task."""
    wanted_terms = [list(dict.fromkeys(terms(text))) for _, text in run]
    names = sorted({t for w in wanted_terms for t in w})
    asked = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in names], "term string")
    counts = {r["term"].encode("utf-8", "surrogatepass"): r["df"] for r in df.join(asked, "term").collect()}  # terms of the run at most
    place = {t: i for i, t in enumerate(t for t in names if t in counts)}
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[t] + 1))) for t in place], np.int64)
    wanted = [[place[t] for t in w if t in place] for w in wanted_terms]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.itertuples():
                df = np.array(r.df, np.int64)
                ends = np.cumsum(df)
                places, tf = np.frombuffer(r.places, "<u4"), np.frombuffer(r.tf, "<u4")
                postings = {i: (places[e - d : e], tf[e - d : e]) for t, d, e in zip(r.terms, df.tolist(), ends.tolist()) if (i := place.get(t.encode("utf-8", "surrogatepass"))) is not None}
                ids, none = np.array(r.ids, np.int64), np.array(r.none, bool)
                for i, at, score in block_scores(np.array(r.n, np.int64), postings, wanted, weight, n_docs, length, k):
                    new = (score, ids[at], none[at])
                    if i in kept:
                        new = tuple(np.concatenate(x) for x in zip(kept[i], new))
                    order = np.lexsort((new[1], new[2], -new[0]))[:k]
                    kept[i] = tuple(x[order] for x in new)
        task = TaskContext.get().partitionId()
        for i, (score, ids, none) in kept.items():
            doc_id = pd.array(ids, "Int64")
            doc_id[none] = pd.NA
            yield pd.DataFrame({"item": i, "salt": task % SALTS, "doc_id": doc_id, "score": score})

    found = blocks.mapInPandas(each, "item long, salt int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(run)], f"item long, item_id {kind}")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), docs AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id
), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM docs
), tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total
), impact AS (
  SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length)))) AS impact
  FROM tf JOIN docs USING (doc_id) JOIN w USING (term), total
), scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
