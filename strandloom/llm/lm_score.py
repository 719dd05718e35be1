"""Cross-entropy difference between matched target and background n-gram models.

Tokens are the lower-cased words between white space. Each model gives the probability of a token after the one before
it; a text's start is a context and its end a token. Pairs are interpolated with words, and these with the words' shares
of all tokens of the corpus, which both models have in common, as they have the vocabulary:

    p(w | v) = (count(v, w) + MU x p(w)) / (count(v) + MU)
    p(w) = (count(w) + NU x share(w)) / (count of all + NU)

The background's counts are scaled to the target's size, so smoothing weighs equally in both. For each context the
probabilities of the vocabulary sum to one. Counts are exact, of every token of every document, by 64-bit hash; nothing
about the models has a fixed size.

A document's own counts are left out when it is scored, so its loss needs the counts of each of its contexts and pairs.
That is done where the counts are made: blocks of documents send the contexts and pairs of a hash bucket, with the
places of the documents that hold them, to one group, which sums the counts and sends back each document's share of its
loss, a packed row a block. A pair goes to the bucket of its second word, whose counts are so known there. N-grams that a
large share of all documents holds (``HOT``) would make some groups large: there are few of them, so their counts are
summed apart, known to every task, and never sent; pairs that end in such a word are dealt by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, materialise, table

#: Weights, in tokens, of the words' distribution beside pairs and of the corpus beside words.
MU, NU = 50.0, 1000.0
#: Bytes of text in a block, most rows of one, and bytes of text whose n-grams share a bucket.
SLICE_BYTES, SLICE_ROWS, BUCKET_BYTES = 3_000_000, 60_000, 16_000_000
#: An n-gram in at least this share of all documents is known to every task. As a document has L n-grams in the mean, there are at most 2 L / HOT of these.
HOT = 0.01
#: Target ids that are broadcast, by count; with more of them the texts are sort-merged with the ids once.
BROADCAST_ROWS = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D)
LOW = np.uint64((1 << 48) - 1)


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse mod 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each token of ``texts``, one after the other, between the start and the end of its text; and how many each text has with these, none if it has no tokens."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    gap = SPACE[buf]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
    words = mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)]) + 1
    n = np.diff(np.searchsorted(starts, bounds))
    some = n > 0
    size = np.where(some, n + 2, 0)
    first = (np.cumsum(size) - size)[some]
    out = np.full(int(size.sum()), START)
    out[first + size[some] - 1] = END
    inside = np.ones(len(out), bool)
    inside[first] = inside[first + size[some] - 1] = False
    out[inside] = words
    return out, size


class Postings:
    """Distinct (n-gram, text) pairs in order of a key: h, text, times; of pairs also the last word and how often the text has it."""

    def __init__(self, key: np.ndarray, h: np.ndarray, text: np.ndarray, last: np.ndarray | None = None, own: np.ndarray | None = None):
        order = np.argsort(key, kind="stable")  # texts stay in order inside a key
        h, text = h[order], text[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.empty(0, np.int64)
        self.key, self.h, self.text, self.times = key[order][new], h[new], text[new], np.diff(np.append(new, len(h)))
        self.last, self.own = (x[order][new] if x is not None else None for x in (last, own))
        self.order = order

    def where(self, keep: np.ndarray) -> Postings:
        out = object.__new__(Postings)
        for c, x in vars(self).items():
            setattr(out, c, x[keep] if x is not None and c != "order" else None)
        return out


def postings(texts: list[str], hot_words: np.ndarray = np.empty(0, np.uint64)) -> tuple[Postings, Postings, np.ndarray]:
    """Contexts and words, and pairs, of ``texts``; and how many tokens each has, with its start and end.

    The key of a context or word is its hash. That of a pair begins with its last word's hash, so the pairs of a word
    lie together; if that word is hot it is the pair's own.
    """
    h, n = tokens(texts)
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(h[:-1] != END) if len(h) else np.empty(0, np.int64)
    last = h[at + 1]
    pair = mixed(h[at] * np.uint64(0xD1342543DE82EF95) + last)
    half = np.uint64(0xFFFFFFFF)
    key = np.where(places(hot_words, last)[0], pair, last & ~half | pair & half)
    words = Postings(h, h, text)
    own = np.empty(len(h), np.int64)
    own[words.order] = np.repeat(words.times, words.times)
    return words, Postings(key, pair, text[at], last, own[at + 1]), n


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows in runs of about SLICE_BYTES, numbered apart over all tasks: a task that is run again numbers them alike."""
    block = TaskContext.get().partitionId() << 32
    held: list[pd.DataFrame] = []
    size = rows = 0
    for b in batches:
        at = (b["text"].str.len().cumsum() // SLICE_BYTES).to_numpy()
        for _, part in b.groupby(at):
            for i in range(0, len(part), SLICE_ROWS):
                piece = part.iloc[i : i + SLICE_ROWS]
                length = int(piece["text"].str.len().sum())
                if held and (size + length > SLICE_BYTES or rows + len(piece) > SLICE_ROWS):
                    yield block, pd.concat(held)
                    block, held, size, rows = block + 1, [], 0, 0
                held.append(piece)
                size, rows = size + length, rows + len(piece)
    if held:
        yield block, pd.concat(held)


def starts_of(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)


def places(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` are in ``known`` (in order), and where."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


class Hot:
    """Words (with the texts' starts and ends) and pairs that are known to every task, in order of their hashes, with their counts by side."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words, self.pairs = np.sort(words), np.sort(pairs)
        self.counts = [np.zeros((2, len(x))) for x in (self.words, self.pairs)]
        self.low = np.argsort(self.words & LOW)
        self.low_words = (self.words & LOW)[self.low]

    def by_low(self) -> np.ndarray:
        """The words' counts in the order of ``low_words``."""
        return self.counts[0][:, self.low]


def hot_ngrams(told: DataFrame, n_docs: int, share: float) -> tuple[Hot, np.ndarray]:
    """The n-grams that at least ``share`` of the documents hold (and some that half as many do), and the number of tokens with the ends of texts in target and background.

    Every block tells those that this share of its own documents hold; one that is so frequent in all is so in some
    block. Which n-grams are taken changes no result. The words of a hot pair are hot.
    """

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("scores")
        for _, part in blocks(batches):
            *both, n = postings(part["text"].tolist())
            for kind, x in enumerate(both):
                h = np.sort(x.h)
                at = starts_of(h)
                df = np.diff(np.append(at, len(h)))
                often = df >= max(share * len(part), 16)
                yield pd.DataFrame({"kind": kind, "h": h[at][often].view(np.int64), "df": df[often]})
            target = part["target"].to_numpy(bool)
            yield pd.DataFrame({"kind": 2, "h": [0, 1], "df": [int(np.maximum(n[side] - 1, 0).sum()) for side in (target, ~target)]})

    found = told.select("text", "target").mapInPandas(tell, "kind int, h long, df long").groupBy("kind", "h").agg(F.sum("df").alias("df")).where((F.col("df") >= share / 2 * n_docs) | (F.col("kind") == 2))
    got: dict[int, list[tuple[int, int]]] = {0: [], 1: [], 2: []}
    for r in found.toLocalIterator():  # at most 4 L / share
        got[r["kind"]].append((r["h"], r["df"]))
    of = lambda k: np.array([h for h, _ in got[k]], np.int64).view(np.uint64)
    return Hot(of(0), of(1)), np.array([n for _, n in sorted(got[2])] or [0, 0], float)


def count_hot(told: DataFrame, hot: Hot) -> None:
    """Fills in the times that target and background (rows) hold each hot n-gram."""
    if not len(hot.words):
        return

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [np.zeros(c.shape) for c in hot.counts]
        for _, part in blocks(batches):
            target = part["target"].to_numpy(bool)
            for x, known, sums in zip(postings(part["text"].tolist()), (hot.words, hot.pairs), got):
                is_hot, at = places(known, x.h)
                side = np.where(target[x.text[is_hot]], 0, len(known)) + at[is_hot]
                sums += np.bincount(side, x.times[is_hot], sums.size).reshape(sums.shape)
        for kind, sums in enumerate(got):
            some = np.flatnonzero(sums.any(axis=0))
            if len(some):
                yield pd.DataFrame({"kind": kind, "at": some, "target": sums[0, some], "background": sums[1, some]})

    for r in told.select("text", "target").mapInPandas(count, "kind int, at long, target double, background double").groupBy("kind", "at").agg(F.sum("target").alias("t"), F.sum("background").alias("b")).toLocalIterator():
        hot.counts[r["kind"]][:, r["at"]] = r["t"], r["b"]


def base(counts: tuple[np.ndarray, np.ndarray], totals: np.ndarray, scale: float, target: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(w) in the target and in the scaled background, times MU, for words of ``counts`` that documents of ``n`` tokens have ``own`` times; these are left out."""
    share = (counts[0] + counts[1]) / totals.sum()
    of = lambda by, k, mine: MU * (by * (counts[k] - own * mine) + NU * share) / (by * (totals[k] - n * mine) + NU)
    return of(1.0, 0, target), of(scale, 1, ~target)


def gains(times: np.ndarray, target: np.ndarray, counts: tuple[np.ndarray, np.ndarray], scale: float, more: tuple) -> np.ndarray:
    """Times the log of each n-gram's count and what is added to it in the target and in the scaled background (rows), a document's own count left out."""
    n_target, n_background = counts
    return np.stack([times * np.log(n_target - times * target + more[0]), times * np.log(scale * (n_background - times * ~target) + more[1])])


HEAD = "block long, idx int, doc_id {0}, n long, target boolean, gain_target double, gain_background double"


def send(told: DataFrame, hot: Hot, totals: np.ndarray, scale: float, buckets: int, kind: str) -> DataFrame:
    """For each document a row with its gains from hot n-grams, and for each block and bucket a row with the other n-grams packed."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, part in blocks(batches):
            words, pairs, n = postings(part["text"].tolist(), hot.words)
            target = part["target"].to_numpy(bool)
            contexts = words.where(words.h != END)
            sums = np.zeros((2, len(part)))
            cold = []
            for x, known, counts, sign in ((contexts, hot.words, hot.counts[0], -1), (pairs, hot.pairs, hot.counts[1], 1)):
                is_hot, at = places(known, x.h)
                own, at = x.where(is_hot), at[is_hot]
                side = target[own.text]
                more = (MU, MU) if sign < 0 else base(tuple(hot.counts[0][:, places(hot.words, own.last)[1]]), totals, scale, side, own.own, n[own.text] - 1)
                got = gains(own.times, side, (counts[0, at], counts[1, at]), scale, more)
                sums += sign * np.stack([np.bincount(own.text, g, len(part)) for g in got])
                cold.append(x.where(~is_hot))
            yield pd.DataFrame({"bucket": -1 - block, "block": block, "idx": np.arange(len(part), dtype=np.int32), "doc_id": part["doc_id"].to_numpy(), "n": n, "target": target, "gain_target": sums[0], "gain_background": sums[1], "packed": None})
            # the bucket is taken from a key's top bits, so that a bucket's n-grams lie together
            cuts = [np.searchsorted(((x.key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64), np.arange(buckets + 1)) for x in cold]
            rows = []
            for b in np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist():
                own = [x.where(slice(c[b], c[b + 1])) for x, c in zip(cold, cuts)]
                rows.append((b, pack(*own, target, n)))
            if not rows:  # a frame without rows has columns of other types
                continue
            none = [None] * len(rows)
            yield pd.DataFrame({"bucket": [b for b, _ in rows], "block": block, "idx": none, "doc_id": none, "n": none, "target": none, "gain_target": none, "gain_background": none, "packed": [p for _, p in rows]})

    return told.mapInPandas(each, f"bucket long, {HEAD.format(kind)}, packed binary")


def low(h: np.ndarray) -> np.ndarray:
    """The low 6 bytes of each hash."""
    return h & LOW


def planes(h: np.ndarray) -> np.ndarray:
    """The steps between 6-byte hashes in order, byte by byte: the high bytes of small steps are all 0, and compress."""
    return np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T)


def unplaned(raw: np.ndarray) -> np.ndarray:
    steps = np.zeros((len(raw) // 6, 8), np.uint8)
    steps[:, :6] = raw.reshape(6, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def bits_of(places: np.ndarray) -> np.ndarray:
    """Places in order, as bits."""
    there = np.zeros(int(places[-1]) + 1 if len(places) else 0, bool)
    there[places] = True
    return np.packbits(there)


def pack(contexts: Postings, pairs: Postings, target: np.ndarray, n: np.ndarray) -> bytes:
    """One cell: the words' hashes; of contexts the documents of each word (and 1), of pairs the hashes, the place of the last word, and the documents of each; of both the documents' places, times and sides; of pairs how often a document has the last word; the documents, and the tokens of each.

    Hashes are 6 bytes, in order; counts 1 byte, 0 and 4 more if over 255; documents 2 bytes, or a bit in their list; tokens
    2 bytes, 0 and 4 more if they need them; sides a bit.
    """
    words = np.unique(np.concatenate([low(contexts.h), low(pairs.last)]))
    at = np.searchsorted(words, low(contexts.h))
    contexts = contexts.where(np.argsort(at, kind="stable"))
    pairs = pairs.where(np.argsort(low(pairs.h), kind="stable"))
    first = starts_of(low(pairs.h))
    wide = np.uint16 if len(words) <= 1 << 16 else np.uint32
    parts = [planes(words), *small(np.bincount(at, minlength=len(words)) + 1), planes(low(pairs.h)[first]), np.searchsorted(words, low(pairs.last[first])).astype(wide), *small(np.diff(np.append(first, len(pairs.h))))]
    for x in (contexts, pairs):
        parts += [x.text.astype(np.uint16), *small(x.times), np.packbits(target[x.text])]
    who = np.unique(np.concatenate([contexts.text, pairs.text]))
    wide = n[who] >= 1 << 16
    parts += [*small(pairs.own), bits_of(who), np.where(wide, 0, n[who]).astype(np.uint16), n[who][wide].astype(np.uint32)]
    raw = [p.tobytes() for p in parts]
    return np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw)


def small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    large = x > 255
    return np.where(large, 0, x).astype(np.uint8), x[large].astype(np.uint32)


def unpack(raw: bytes) -> tuple[tuple, tuple, np.ndarray, np.ndarray]:
    """hash, text, times and side of each context of a text that ``pack`` put away; the same, the last word and how often the text has it of each pair; the texts and their tokens."""
    k = int(np.frombuffer(raw, np.uint32, 1)[0])
    sizes = np.frombuffer(raw, np.uint32, k, 4).astype(np.int64)
    ends = np.cumsum(sizes) + 4 * (k + 1)
    part = lambda i, t: np.frombuffer(raw[ends[i] - sizes[i] : ends[i]], t)

    def large(i: int) -> np.ndarray:
        x = part(i, np.uint8).astype(np.int64)
        x[x == 0] = part(i + 1, np.uint32)
        return x

    words, pairs = unplaned(part(0, np.uint8)), unplaned(part(3, np.uint8))
    last = words[part(4, np.uint16 if len(words) <= 1 << 16 else np.uint32)]
    df = (large(1) - 1, large(5))
    out = []
    for i, h, d in ((7, words, df[0]), (11, pairs, df[1])):
        text = part(i, np.uint16).astype(np.int64)
        out.append((np.repeat(h, d), text, large(i + 1), np.unpackbits(part(i + 3, np.uint8))[: len(text)].astype(bool)))
    tokens_of = part(18, np.uint16).astype(np.int64)
    tokens_of[tokens_of == 0] = part(19, np.uint32)
    return out[0], (*out[1], np.repeat(last, df[1]), large(15)), np.flatnonzero(np.unpackbits(part(17, np.uint8))), tokens_of


class Gathered:
    """The contexts or pairs of a bucket, from all its blocks, in narrow columns."""

    def __init__(self, columns: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(columns)]

    def take(self, h: np.ndarray, place: np.ndarray, times: np.ndarray, side: np.ndarray, *more: np.ndarray) -> None:
        for to, x, kind in zip(self.parts, (h, place, times, side, *more), (np.uint64, np.int32, np.int32, bool, np.uint64, np.int32)):
            to.append(x.astype(kind, copy=False))

    def columns(self) -> list[np.ndarray]:
        out = []
        for p in self.parts:
            out.append(np.concatenate(p))
            p.clear()
        return out


def numbered(h: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct hash, and how many there are."""
    order = np.argsort(h).astype(np.int32)
    there = h[order]
    new = np.concatenate([np.ones(min(len(h), 1), bool), there[1:] != there[:-1]])
    at = np.empty(len(h), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return at, int(new.sum())


def score(told: DataFrame, hot_share: float = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (nats a token, ends of texts counted) and score, their difference: low is like the target.

    ``told`` has doc_id, text and target (whether a document trains the target model; all others train the
    background). A row's own counts are taken out of the model it was counted in, not out of the corpus' shares. Whole
    texts. Null, empty and blank texts have no tokens and null losses. If there is no target, or no background, that
    side's model is these shares. Each row gives a row, whether its id is null or repeats. Other columns are ignored.
    ``hot_share`` and ``bucket_bytes`` change no result.
    """
    own_kind, kind = told.schema["doc_id"].dataType, "string"  # as text, ids pass through the groups unchanged, null or not
    told = told.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    size = F.octet_length("text").cast("long")
    n_docs, bytes_target, bytes_background = told.agg(F.count(F.lit(1)), F.sum(F.when(F.col("target"), size)), F.sum(F.when(~F.col("target"), size))).first()  # one row
    scale = bytes_target / bytes_background if bytes_target and bytes_background else 1.0
    buckets = max(1, -(-((bytes_target or 0) + (bytes_background or 0)) // bucket_bytes))
    hot, totals = hot_ngrams(told, n_docs, hot_share)
    count_hot(told, hot)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return rows.drop(columns="bucket")
        contexts, pairs, docs, sizes, n = Gathered(4), Gathered(6), [], [], 0
        for b, raw in zip(rows["block"], rows["packed"]):
            *both, who, tokens_of = unpack(raw)
            for to, x in zip((contexts, pairs), both):  # a document's n-grams in this bucket become one row
                to.take(x[0], n + np.searchsorted(who, x[1]), *x[2:])
            sizes.append(tokens_of)
            docs.append((b, n, len(who), bits_of(who).tobytes()))
            n += len(who)
        got = np.zeros((2, n))

        def counted(h: np.ndarray, times: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            at, distinct = numbered(h)
            return at, [np.bincount(at, times * side, distinct) for side in (sides, ~sides)]

        def gain(sign: int, at: np.ndarray, sums: list[np.ndarray], place: np.ndarray, times: np.ndarray, sides: np.ndarray, more) -> None:  # noqa: ANN001
            for i in range(0, len(at), 500_000):  # a piece at a time: only the narrow columns are held whole
                k = slice(i, i + 500_000)
                for j, x in enumerate(gains(times[k], sides[k], (sums[0][at[k]], sums[1][at[k]]), scale, more(k))):
                    got[j] += sign * np.bincount(place[k], x, n)

        h, place, times, sides = contexts.columns()
        gain(-1, *counted(h, times, sides), place, times, sides, lambda k: (MU, MU))
        h, place, times, sides, last, own = pairs.columns()
        sizes = np.concatenate(sizes).astype(np.int64) - 1
        # all pairs of a last word that isn't hot are here, so its counts are their sums
        word, of_word = counted(last, times, sides)
        totals_hot = hot.by_low()

        def more(k: slice) -> tuple[np.ndarray, np.ndarray]:
            counts = np.stack([c[word[k]] for c in of_word])
            is_hot, at = places(hot.low_words, last[k])
            counts[:, is_hot] = totals_hot[:, at[is_hot]]
            return base(tuple(counts), totals, scale, sides[k], own[k], sizes[place[k]])

        gain(1, *counted(h, times, sides), place, times, sides, more)
        packed = [np.uint32(len(bits)).tobytes() + bits + got[:, i : i + k].tobytes() for _, i, k, bits in docs]
        none = [None] * len(docs)
        return pd.DataFrame({"block": [x[0] for x in docs], "idx": none, "doc_id": none, "n": none, "target": none, "gain_target": none, "gain_background": none, "packed": packed})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        """A block's documents with their gains from all buckets added up."""
        docs = rows[rows["packed"].isna()].sort_values("idx")
        sums = docs[["gain_target", "gain_background"]].to_numpy(float).T.copy()
        for raw in rows["packed"].dropna():
            end = 4 + int(np.frombuffer(raw, np.uint32, 1)[0])
            places_in = np.flatnonzero(np.unpackbits(np.frombuffer(raw[4:end], np.uint8)))
            sums[:, places_in] += np.frombuffer(raw[end:]).reshape(2, -1)
        return pd.DataFrame({"doc_id": docs["doc_id"], "n": docs["n"], "t": sums[0], "b": sums[1]})

    sent = send(told, hot, totals, scale, buckets, kind)
    shares = sent.groupBy("bucket").applyInPandas(group, f"{HEAD.format(kind)}, packed binary")
    docs = shares.groupBy("block").applyInPandas(total, f"doc_id {kind}, n long, t double, b double")
    loss = lambda gain: F.when(F.col("n") > 0, -F.col(gain) / (F.col("n") - 1))  # noqa: E731  n counts start and end
    found = docs.select(F.col("doc_id").cast(own_kind).alias("doc_id"), F.greatest(F.col("n") - 2, F.lit(0)).alias("n_tokens"), loss("t").alias("loss_target"), loss("b").alias("loss_background"))
    return found.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def told_apart(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text and whether the document is of the target (``target_ids``: doc_id)."""
    chosen = materialise(target_ids.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().withColumn("target", F.lit(True)), "target")
    few = chosen.count() <= BROADCAST_ROWS
    found = docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    found = found.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return found if few else materialise(found, "told")  # read in each pass


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(told_apart(table(spark, sf_dir, "documents"), good))
