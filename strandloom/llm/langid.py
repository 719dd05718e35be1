"""Language identification as a mixture: EM over each document's words.

Each language has a model of the character trigrams inside a word (its ends marked), hashed into a fixed number of
buckets. A document is a mixture of languages: every word comes from one language, drawn with the document's
proportions. EM estimates the proportions from the words' likelihoods. Languages are ranked by their share under the
full mixture, and of the nested sets of the first 1, 2, ... the one of the lowest penalised likelihood (BIC, the
sample size being the words) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_texts, keep_only, text_key

BUCKETS = 1 << 15
#: At most this many documents of a language are learned from: those of the smallest xxhash64 of their id and text.
TRAIN_DOCS = 1000
#: EM ends for a document when a step moves no proportion by more than TOLERANCE, or after STEPS at the latest.
TOLERANCE, STEPS = 1e-3, 200
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of ``texts``, one after the other: bucket of each trigram, where each word's trigrams begin, text of each word.

    A word is a run of letters (``str.isalpha``): a combining mark ends one, so decomposed accents split words.
    """
    joined = "\n".join((t or "").lower() for t in texts)
    code = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 0)
    first = np.flatnonzero((code[1:-1] > 0) & (code[:-2] == 0))  # the character before each word, which stands for its start
    mid = np.flatnonzero(code[1:-1] > 0) + 1
    h = code[mid - 1] * np.uint32(0x9E3779B1) ^ code[mid] * np.uint32(0x85EBCA6B) ^ code[mid + 1] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    starts = np.searchsorted(mid, first + 1)
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    return (h >> np.uint32(17)).astype(np.int32), starts, np.searchsorted(ends, first, side="right")


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # of a trigram: languages x buckets


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: text, language, and not held out."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Counts trigrams of a bounded sample of labelled documents (whole texts) on the executors; the driver gets at most BUCKETS counts a language."""
    labelled = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    u = F.xxhash64("doc_id", "text")
    # rows alike in id and text count once, however many there are
    sizes = {r["lang"]: max(r["n"], 1) for r in labelled.groupBy("lang").agg(F.approx_count_distinct(u, 0.02).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    # a share by hash that holds the bound in the mean with room for chance and the estimate, then the exact bound on the few rows left
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.6 * per_language / n)).otherwise(share)
    few = labelled.where(F.pmod(u, F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text", u.alias("u")).dropDuplicates(["lang", "u"])
    edge = few.groupBy("lang").agg(F.array_sort(F.collect_list("u")).alias("all")).select("lang", F.col("all")[F.least(F.size("all"), F.lit(per_language)) - 1].alias("last"))
    few = few.join(F.broadcast(edge), "lang").where(F.col("u") <= F.col("last"))  # one row a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(texts.tolist())[0], minlength=BUCKETS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    rows = few.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    counts[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    p = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    return Model(languages, np.log(p).astype(np.float32))


def em(like: np.ndarray, doc: np.ndarray, n_words: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log-likelihoods; ``use`` tells which languages each document's mixture has."""
    starts = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    share = use / use.sum(axis=1, keepdims=True)
    # documents still moving, and their words
    left, words, own, first = np.arange(len(share)), like, doc, starts
    for step in range(STEPS):
        now = share[left]
        r = words * now[own]
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first, axis=0) / n_words[left][:, None]
        share[left] = new
        moving = np.abs(new - now).max(axis=1) > TOLERANCE
        if not moving.any():
            break
        if moving.mean() < 0.7:
            words = words[moving[own]]
            left = left[moving]
            own = np.repeat(np.arange(len(left)), n_words[left])
            first = np.concatenate([[0], np.cumsum(n_words[left])[:-1]])
    total = np.log((like * share[doc]).sum(axis=1))
    return share, np.add.reduceat(total, starts)


def predict_batch(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and proportions of each text."""
    names, n = model.languages, len(texts)
    share, scores, out = np.zeros((n, len(names))), np.zeros(n), [UNKNOWN] * n
    if not names or not n:
        return out, scores, share
    bucket, starts, of = trigrams(texts)
    if not len(starts):
        return out, scores, share
    logs = np.stack([np.add.reduceat(row[bucket], starts) for row in model.log_p], axis=1).astype(np.float64)
    logs -= logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(logs, -50))
    there, doc, n_words = np.unique(of, return_inverse=True, return_counts=True)
    every = np.ones((len(there), len(names)))
    full, _ = em(like, doc, n_words, every)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best = np.full(len(there), np.inf)
    chosen = np.zeros_like(full)
    for k in range(1, len(names) + 1):
        # a language more must pay; sets that the last language adds nothing to are skipped
        open_ = np.flatnonzero((full * (rank == k - 1)).sum(axis=1) * n_words >= (0.5 if k > 1 else 0))
        if not len(open_):
            continue
        words = np.isin(doc, open_) if len(open_) < len(there) else slice(None)
        sub = np.searchsorted(open_, doc[words])
        got, log_like = em(like[words], sub, n_words[open_], (rank[open_] < k).astype(float))
        cost = -2 * log_like + (k - 1) * np.log(n_words[open_])
        better = cost < best[open_]
        best[open_[better]], chosen[open_[better]] = cost[better], got[better]
    share[there] = chosen
    top = chosen.argmax(axis=1)
    scores[there] = np.clip(chosen[np.arange(len(there)), top], 0, 1)
    for i, t in zip(there.tolist(), top.tolist()):
        out[i] = names[t]
    return out, scores, share


def predict(docs: DataFrame, model: Model, slice_chars: int = 500_000) -> DataFrame:
    """doc_id, lang_pred, score and proportions (language to share, the kept set only) of each row of ``docs``.

    Whole texts; null texts and texts without a letter are ``und`` with score 0, as all are if nothing could be
    learned. Of equal shares the language that sorts first wins. Rows that repeat an id each give a row.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("language")
        for b in batches:
            sizes = b["text"].str.len().fillna(0).cumsum() // slice_chars
            for _, part in b.groupby(sizes.to_numpy()):
                lang, score, share = predict_batch(model, [t if isinstance(t, str) else None for t in part["text"]])
                mix = [{model.languages[j]: float(row[j]) for j in np.flatnonzero(row)} for row in share]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "lang_pred": lang, "score": score, "proportions": mix})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, proportions map<string,double>")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = predict(docs, train(learnable(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "proportions")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in no language (``und``); columns unchanged. Mixed documents stay.

    A row goes by its text alone: null and empty texts go, whether ids are null or repeat.
    """
    texts = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    return drop_texts(docs, predict(texts, train(learnable(docs))).where(F.col("lang_pred") == UNKNOWN).select(F.col("doc_id").alias("key")))
