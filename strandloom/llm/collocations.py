"""Phrase collocations: phrases that occur far more often than chance, counted by suffix automata.

A shard is the text of a task. Its generalised suffix automaton, cut at five words, is built from the order of all
positions by what stands before them: the classes of substrings that end at the same positions are the states, the
number of these positions is a state's count, and the state of the longest shorter suffix with more positions is its
suffix link. Enumerating the states gives every phrase of the shard with its count, once.

Counts are summed over shards, phrase by phrase. Only phrases that may be frequent in all are sent: words are counted first;
then pairs of frequent words, by hash into a table with a bit for each place whose sum is large enough. Every phrase of
a frequent phrase is frequent, so what either table turns away can't be part of a candidate; what they wrongly let
through is counted exactly and found to be rare. The tables change what is sent, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shuffle_partitions, table

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language at most.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a shard, at most, and bytes of text split at once. They change no result.
SHARD_WORDS, TEXT_BYTES = 4_000_000, 4_000_000
#: Bits of the tables of frequent words and pairs: at least and at most (64 MB, known to every task).
BITS, MOST_BITS = 1 << 22, 1 << 29
#: Places of the pair table that are summed together.
CHUNK = 1 << 16
#: Words of text whose phrases are summed in one group.
RANGE_WORDS = 2_000_000
UNKNOWN = "und"

#: UTF-8 bytes: A-Z in lower case, tabs as spaces, what ends a piece as full stops.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 9 else 0x2E if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_END = b"."


def split(texts: list[str | None]) -> list[bytes]:
    """Words of ``texts``, with a full stop wherever a piece ends."""
    joined = b".".join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    return [w for w in joined.translate(_FOLD).replace(b".", b" . ").split(b" ") if w]


class Shard:
    """Words of one language, numbered as they come; 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {_END: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def take(self, texts: list[str | None]) -> None:
        words = split(texts)
        number = self.number
        for w in {*words}.difference(number):
            number[w] = len(number)
        self.parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def words(self) -> list[bytes]:
        return list(self.number)

    def sequence(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int32), *self.parts])


def shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Shard]]:
    """The task's text by language, in shards of bounded size."""
    open_: dict[str, Shard] = {}
    for b in batches:
        for lang, part in b.groupby("lang", sort=False):
            texts = part["text"].tolist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= TEXT_BYTES):
                    size += len(texts[j] or "")
                    j += 1
                own = open_.setdefault(lang, Shard())
                own.take(texts[i:j])
                i = j
                if sum(s.size for s in open_.values()) >= SHARD_WORDS:  # the largest goes first
                    name = max(open_, key=lambda k: open_[k].size)
                    yield name, open_.pop(name)
    yield from open_.items()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """XXH64 (seed 42) of language and word, as Spark's xxhash64 has it; 0 for the end of a piece."""
    head = lang.encode("utf-8", "surrogatepass") + b" "
    return np.array([0, *(xxhash.xxh64_intdigest(head + w, 42) for w in words[1:])], np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(31)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(8)) & np.uint64(bits - 1)


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def automaton(x: np.ndarray, reach: np.ndarray, longest: int) -> dict[str, np.ndarray]:
    """States of the suffix automaton of the sequence ``x``, cut at ``longest``; one of a state's substrings ends at each place of ``x``.

    ``reach`` tells how many symbols a substring that ends at a place may have (0: none). Columns by state: end (a
    place where its substrings end), count (of such places), long (length of its longest substring), short (of its
    shortest), link (the state of the suffix that is one shorter than the shortest, -1 if that is empty).
    """
    at = np.flatnonzero(reach)
    reach = reach[at].astype(np.int64)
    keys = np.zeros((longest, len(at)), np.int64)  # what stands at the place, and before it as far as it may reach
    for d in range(longest):
        keys[d] = np.where(reach > d, x[np.maximum(at - d, 0)] + 1, 0)
    wide = int(x.max(initial=0)) + 2
    span = max(1, 62 // wide.bit_length())  # symbols that fit into one sort key
    packed = [reduce(lambda a, b: a * wide + b, keys[d : d + span]) for d in range(0, longest, span)]
    order = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0], kind="stable")
    at, reach, keys = at[order], reach[order], keys[:, order]
    same = np.zeros(len(at), np.int64)  # symbols shared with the place before in this order
    still = np.ones(len(at), bool)
    still[:1] = False
    for d in range(longest):
        still[1:] &= (keys[d, 1:] == keys[d, :-1]) & (keys[d, 1:] > 0)
        same += still
    # by length: the runs of places whose last symbols are the same; a state is a run seen at its longest
    out = {c: [] for c in ("end", "count", "long", "short", "link")}
    above = np.full(len(at), -1)  # state of each place's suffix that is one shorter
    short = np.ones(len(at), np.int64)
    made = 0
    for d in range(1, longest + 1):
        fits = np.flatnonzero(reach >= d)
        if not len(fits):
            break
        # a run ends where fewer than d symbols are shared; places too short to take part sort before the run of their suffix
        first = np.flatnonzero(same[fits] < d)
        count = np.diff(np.append(first, len(fits)))
        if d < longest:
            longer = np.concatenate([[0], np.cumsum((reach[fits] > d) & (same[fits] > d))])
            fit_next = np.concatenate([[0], np.cumsum(reach[fits] > d)])
            ends = np.append(first[1:], len(fits))
            # all of a run's places go on by the same symbol: all fit, and all but the first share more with the one before
            goes_on = (fit_next[ends] - fit_next[first] == count) & (longer[ends] - longer[first] == count - 1)
        else:
            goes_on = np.zeros(len(first), bool)
        state = np.where(goes_on, -1, made + np.cumsum(~goes_on) - 1)
        keep = ~goes_on
        out["end"].append(at[fits[first[keep]]])
        out["count"].append(count[keep])
        out["long"].append(np.full(keep.sum(), d))
        out["short"].append(short[fits[first[keep]]])
        out["link"].append(above[fits[first[keep]]])
        made += int(keep.sum())
        run_state = np.repeat(state, count)
        there = run_state >= 0
        above[fits[there]] = run_state[there]
        short[fits[there]] = d + 1
    return {c: np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for c, v in out.items()}


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word), n: every word's occurrences."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, shard in shards(batches):
            n = np.bincount(shard.sequence(), minlength=len(shard.number))[1:]
            names = [w.decode("utf-8", "surrogatepass") for w in shard.words()[1:]]
            for i in range(0, len(names), 100_000):
                yield pd.DataFrame({"lang": lang, "phrase": names[i : i + 100_000], "n": n[i : i + 100_000]})

    found = _docs(docs).mapInPandas(each, "lang string, phrase string, n long")
    return materialise(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")


def table_bits(entries: int) -> int:
    """Bits of a table for so many entries: some 16 an entry, between the bounds."""
    return min(MOST_BITS, max(BITS, 1 << (16 * max(entries, 1) - 1).bit_length()))


def word_table(frequent: DataFrame, bits: int) -> np.ndarray:
    """The frequent words' bits, gathered as bitmaps of 32,768 bits: ``bits`` / 8 bytes reach the driver at most."""
    at = F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", "lang", "phrase")), 8).bitwiseAND(F.lit(bits - 1)) + 1
    maps = frequent.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(r["map"], np.uint8)[: len(out) - start]
    return out


def kept_sequence(lang: str, shard: Shard, frequent: Broadcast, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's sequence with 0 for words that aren't frequent, the others numbered anew; their old numbers and hashes."""
    h = word_hashes(lang, shard.words())
    often = has(frequent.value, places(h, bits))
    often[0] = False
    new = np.where(often, np.cumsum(often), 0).astype(np.int32)
    return new[shard.sequence()], np.concatenate([[0], np.flatnonzero(often)]), np.concatenate([np.zeros(1, np.uint64), h[often]])


def pair_table(docs: DataFrame, frequent: Broadcast, bits: int, pair_bits: int, least: int) -> np.ndarray:
    """Bits of the places whose pairs of frequent words occur ``least`` times in all, or more.

    Each task sums its pairs by place and sends them by chunks of places; a chunk's sums become bits.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for lang, shard in shards(batches):
            x, _, h = kept_sequence(lang, shard, frequent, bits)
            end = np.flatnonzero((x[1:] > 0) & (x[:-1] > 0)) + 1
            pair, times = np.unique(x[end - 1].astype(np.int64) << 32 | x[end], return_counts=True)
            more = places(pair_hashes(h[pair >> 32], h[pair & 0xFFFFFFFF]), pair_bits)
            at, inverse = np.unique(np.concatenate([at, more]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, times]), len(at)).astype(np.int64)
            if len(at) > 4_000_000:
                yield from sent(at, n)
                at, n = at[:0], n[:0]
        yield from sent(at, n)

    def sent(at: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        chunk = (at // np.uint64(CHUNK)).astype(np.int64)
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        low, n = (at % np.uint64(CHUNK)).astype(np.uint16), np.minimum(n, least).astype(np.uint32)
        ends = np.append(first[1:], len(at))
        salt = TaskContext.get().partitionId()
        for i in range(0, len(first), 64):
            rows = range(i, min(i + 64, len(first)))
            yield pd.DataFrame({"chunk": chunk[first[i : i + 64]], "salt": salt, "at": [low[first[k] : ends[k]].tobytes() for k in rows], "n": [n[first[k] : ends[k]].tobytes() for k in rows]})

    def summed(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros(CHUNK, np.int64)
        for at, n in zip(rows["at"], rows["n"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)  # a row has each place once
        return total

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = summed(rows)
        at = np.flatnonzero(total)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "at": [at.astype(np.uint16).tobytes()], "n": [np.minimum(total[at], least).astype(np.uint32).tobytes()]})

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "map": [np.packbits(summed(rows) >= least, bitorder="little").tobytes()]})

    found = _docs(docs).mapInPandas(each, "chunk long, salt int, at binary, n binary")
    if pair_bits == MOST_BITS:  # chunks no longer grow in number with the corpus: tasks are merged in groups first
        found = found.groupBy("chunk", F.expr("salt div 256").alias("salt")).applyInPandas(merge, "chunk long, at binary, n binary")
    out = np.zeros(pair_bits // 8, np.uint8)
    for r in found.select("chunk", "at", "n").groupBy("chunk").applyInPandas(close, "chunk long, map binary").toLocalIterator():
        out[r["chunk"] * (CHUNK // 8) : (r["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(r["map"], np.uint8)
    return out


def count_phrases(docs: DataFrame, frequent: Broadcast, bits: int, pairs: Broadcast, pair_bits: int, longest: int, least: int, ranges: int) -> DataFrame:
    """lang, phrase (words joined by spaces), a: phrases of 2 to ``longest`` words that occur at least ``least`` times.

    A shard sends its phrases in ``ranges`` of their hashes, each a row; a range is summed by one group. A phrase is once
    in a shard, so no phrase makes a range large.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, shard in shards(batches):
            x, old, h = kept_sequence(lang, shard, frequent, bits)
            words = shard.words()
            names = [words[i] for i in old.tolist()]
            end = np.flatnonzero((x[1:] > 0) & (x[:-1] > 0)) + 1
            joined = np.zeros(len(x), bool)
            joined[end[has(pairs.value, places(pair_hashes(h[x[end - 1]], h[x[end]]), pair_bits))]] = True
            run = joined.astype(np.int64)  # pairs in a row that end here, up to longest - 1
            for _ in range(longest - 2):
                run[1:] = np.where(joined[1:], np.minimum(run[:-1] + 1, longest - 1), 0)
            del shard, joined
            found = automaton(x, np.where(run > 0, run + 1, 0), longest)
            phrases, counts, to = [], [], []
            for d in range(2, longest + 1):
                s = np.flatnonzero((found["short"] <= d) & (found["long"] >= d))
                parts = [x[found["end"][s] - i] for i in range(d - 1, -1, -1)]
                to.append((reduce(pair_hashes, [h[p] for p in parts]) % np.uint64(ranges)).astype(np.int64))
                phrases += [b" ".join(p) for p in zip(*([names[w] for w in p.tolist()] for p in parts))]
                counts.append(found["count"][s])
            to, counts = np.concatenate(to), np.concatenate(counts)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cut))
            for i in range(0, len(some), 100):
                own = [order[cut[k] : cut[k + 1]] for k in some[i : i + 100].tolist()]
                yield pd.DataFrame({"lang": lang, "to": some[i : i + 100], "phrases": [b"\n".join([phrases[j] for j in o.tolist()]) for o in own], "counts": [counts[o].tobytes() for o in own]})

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        phrases = [p for raw in rows["phrases"] for p in raw.split(b"\n")]
        code, names = pd.factorize(np.array(phrases, object))
        total = np.zeros(len(names), np.int64)
        np.add.at(total, code, np.concatenate([np.frombuffer(c, np.int64) for c in rows["counts"]]))
        often = np.flatnonzero(total >= least)
        text = np.array([names[i].decode("utf-8", "surrogatepass") for i in often.tolist()], object)  # an object column, if empty too
        return pd.DataFrame({"lang": np.full(len(often), rows["lang"].iloc[0], object), "phrase": text, "a": total[often]})

    found = _docs(docs).mapInPandas(each, "lang string, to long, phrases binary, counts binary")
    return materialise(found.groupBy("lang", "to").applyInPandas(summed, "lang string, phrase string, a long"), "phrases")


def scored(phrases: DataFrame, part: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase at its lowest-scoring cut; ``part`` (lang, part, f) counts what cuts leave."""
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("*", F.concat_ws(" ", F.slice(w, 1, F.col("k"))).alias("first"), F.concat_ws(" ", F.slice(w, F.col("k") + 1, F.size(w))).alias("rest"))
    of = lambda c, name: part.select(F.col("lang"), F.col("part").alias(c), F.col("f").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # up to 10^38, beyond any product of counts here
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))")
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return worst.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those that a longer one holds as often.

    No phrase is more frequent than one it holds, so it is enough to look at phrases one word longer: those whose
    suffix link (first word dropped) or prefix (last word dropped) the phrase is.
    """
    w = F.split("phrase", " ")
    short = F.array(F.concat_ws(" ", F.slice(w, 2, F.size(w))), F.concat_ws(" ", F.slice(w, F.lit(1), F.size(w) - 1)))
    inside = phrases.where(F.size(w) > 2).select("lang", F.explode(short).alias("phrase"), "a")
    return phrases.join(inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer")), ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and those at spaces and tabs into words; null
    texts are empty, null languages ``und``. Candidates are phrases of 2 to ``longest`` words inside a piece that
    occur at least ``least`` times, overlaps included. A cut after k words scores floor(1000 a n / (l r)), with n the
    language's words and l, r the occurrences of both parts; the lowest score counts, of equal ones the smallest k.
    Phrases held as often by a longer candidate go. Ties go by a, then by the phrase's bytes. Rows that repeat count
    each time; no rows or no words give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = count_words(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = materialise(words.where(F.col("n") >= least), "frequent-words")
    n_frequent, n_words = frequent.count(), words.agg(F.sum("n")).first()[0] or 0
    bits, pair_bits = table_bits(n_frequent), table_bits(n_words // 64)
    known = spark.sparkContext.broadcast(word_table(frequent, bits))
    pairs = spark.sparkContext.broadcast(pair_table(docs, known, bits, pair_bits, least))
    phrases = count_phrases(docs, known, bits, pairs, pair_bits, longest, least, max(shuffle_partitions(spark), n_words // RANGE_WORDS))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # both sides of a candidate's cut are at least as frequent as it is
    part = materialise(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).union(frequent), "parts")
    return scored(maximal(phrases), part, totals).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return collocations(docs)


_WORD = r"list_filter(string_split_regex(p, '[\t ]+'), lambda w: w <> '')"
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
ORACLE = rf"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), pieces AS (SELECT lang, {_WORD} AS w FROM cut
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM c WHERE k >= 3 UNION ALL SELECT lang, array_to_string(w[:k - 1], ' '), a FROM c WHERE k >= 3) GROUP BY lang, phrase
), kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a
), cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM kept
), parts AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang) JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
), worst AS (SELECT lang, phrase, a, l, r, n, score FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
