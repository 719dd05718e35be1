"""SimHash near-duplicates found with covering locality-sensitive hashing.

Covering: each of the 64 bit positions gets a random vector m(i) of r+1 bits. Table v (v from 1 to 2^(r+1)-1) looks
only at the positions whose m(i) has an odd number of ones in common with v. For any r positions some v is orthogonal
to all r vectors, so that table sees none of them: two fingerprints within distance r agree in it. No pair is missed.

Large buckets are never compared pair by pair. Two words are within an even distance r exactly if some word lies
within r/2 of both, so each fingerprint that is in some large bucket emits the words within r/2 of it (2081 for r = 4)
and meets its neighbours there. That is linear in the number of fingerprints and as exact as comparing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_texts, keep_only, materialise, one_of_each, shuffle_partitions, split, text_key
from .components import components
from .decontaminate import shingles, words

BITS = 64
#: Buckets of up to this many distinct fingerprints are compared pair by pair, larger ones through midpoints.
SMALL_BUCKET = 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; a text of fewer words is one shingle, no words none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends, joined = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist(), b" ".join(words)
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("simhash")
        for b in batches:
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": found.view(np.int64)})

    # ids pass through pandas as text: beside nulls it would make them doubles
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(each, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """The 2^(radius+1)-1 masks; every bit position takes part in half of the tables."""
    rng = np.random.default_rng(seed)
    # each non-zero vector is used for as many positions as any other, in random order: masks of near-equal weight
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    vectors = [vectors[i] for i in rng.permutation(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ball(radius: int) -> np.ndarray:
    """All words within ``radius`` of zero."""
    at = [1 << i for i in range(BITS)]
    return np.array([0, *(sum(c) for k in range(1, radius + 1) for c in combinations(at, k))], np.uint64)


def links(fps: DataFrame, radius: int, small: int = SMALL_BUCKET) -> DataFrame:
    """Edges (family, a, b) over distinct fingerprints ``fps`` (family, fp, weight): a graph whose components in a family are those of "differ in at most radius bits".

    Members of small buckets are compared; those of large ones meet at midpoints, and each midpoint links all that
    reach it to the weightiest of them (of equal ones the first). Nothing is capped. All joins are sort-merged: a table
    of buckets or members that is small as a file is several times as large where a driver builds its broadcast.
    """
    if radius % 2:
        raise ValueError("midpoints need an even radius")
    masks = covering_masks(radius)
    bucket = ["family", "v", "key"]
    fps = fps.repartition(shuffle_partitions(fps.sparkSession), "fp")  # a row becomes 31: dealt evenly before
    keys = fps.select("family", "fp", "weight", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("v", "key"))
    many = materialise(keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    member = materialise(keys.join(many.hint("merge"), bucket), "members")

    near = member.where(F.col("n") <= small)
    left, right = (near.select(*bucket, F.col("fp").alias(c)) for c in ("a", "b"))
    # a pair that meets in several tables is linked in the first of them alone (if that bucket is large, by midpoints)
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(masks)])
    direct = left.join(right.hint("merge"), bucket).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (first == F.col("v"))).select("family", "a", "b")

    near_words = ball(radius // 2)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                x = part["fp"].to_numpy().view(np.uint64)
                yield pd.DataFrame({"family": np.repeat(part["family"].to_numpy(), len(near_words)), "a": np.repeat(x, len(near_words)).view(np.int64), "weight": np.repeat(part["weight"].to_numpy(), len(near_words)), "mid": (x[:, None] ^ near_words[None, :]).ravel().view(np.int64)})

    hot = member.where(F.col("n") > small).select("family", "fp", "weight").distinct().mapInPandas(probes, "family int, a long, weight long, mid long")
    # a midpoint that one fingerprint alone reaches links nothing
    shared = hot.groupBy("family", "mid").agg(F.max(F.struct("weight", F.bitwise_not("a").alias("low"), "a"))["a"].alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    through = hot.join(shared.hint("merge"), ["family", "mid"]).where("a != first").select("family", F.col("first").alias("a"), F.col("a").alias("b"))
    return direct.unionByName(through).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in at most ``radius`` (even) bits; component_id is the smallest doc_id
    that links reach. Null and empty texts have fingerprint zero and link like any other. Fewer words than ``width``
    are one shingle. Rows that repeat a doc_id each give a row. A null doc_id gets a row, and is a component_id only
    where no other id is in its component. No documents, no rows. Other columns are ignored.

    Equal fingerprints are merged before anything is compared, so a hot group of copies costs one fingerprint.
    """
    seen = materialise(fingerprints(docs, width), "fingerprints")
    unique = materialise(seen.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "unique")
    one = unique.select(F.lit(0).alias("family"), "fp", F.lit(1).cast("long").alias("weight"))
    root = components(links(one, radius), "a", "b")
    # tables of a row a fingerprint: sort-merged, so that no driver holds them
    joined = unique.join(root.hint("merge"), unique["fp"] == root["node"])
    lowest = joined.groupBy("root").agg(F.min("first_id").alias("low_id"))
    moved = joined.join(lowest.hint("merge"), "root").select("fp", F.col("low_id").alias("component_id"))
    whole = materialise(unique.join(moved.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    return seen.join(whole.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: MinHash buckets: a pair of similarity J shares one with probability 1 - (1 - J^ROWS)^BANDS, 0.9999 at 0.8, wherever its texts differ.
BANDS, ROWS = 24, 5


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash signature of the shingles ``hashes``; equal sets have equal keys."""
    rng = np.random.default_rng(11)
    odd, flip = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = (hashes[at : at + 4096, None] ^ flip) * (odd | np.uint64(1))
        least = np.minimum(least, ((h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    key = (least.reshape(BANDS, ROWS) * (odd | np.uint64(1)).reshape(BANDS, ROWS)).sum(axis=1, dtype=np.uint64)
    key = (key ^ key >> np.uint64(30)) * np.uint64(0x94D049BB133111EB) + np.arange(BANDS, dtype=np.uint64)
    return (key ^ key >> np.uint64(31)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """One row a text: row (a number), key (of the text), doc_id (the smallest), n (rows of the text), fp (fingerprint of its set of words), bands (MinHash buckets of its set of ``width``-word shingles).

    Texts without words have no row.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("simhash")
        for b in batches:
            keys, ids, fps, bands = [], [], [], []
            for key, k, text in zip(b["key"], b["doc_id"], b["text"]):
                low = (text or "").lower()
                h = shingle_hashes(low, width)
                if len(h):
                    own = {*low.encode().split()}
                    keys.append(key)
                    ids.append(k)
                    fps.append(fingerprint(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in own), np.uint64, len(own))))
                    bands.append(band_keys(h))
            if keys:
                yield pd.DataFrame({"key": keys, "doc_id": ids, "fp": np.array(fps, np.uint64).view(np.int64), "bands": bands})

    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInPandas(each, "key binary, doc_id string, fp long, bands array<long>")  # ids as text, as above
    one = found.groupBy("key").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.count(F.lit(1)).alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    return materialise(one.select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")  # the numbers are fixed by being written


def covered(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of ``fps`` (fp) at most ``radius`` bits apart, by covering: in each bucket of each table the members with the bucket's first.

    That is at most one pair a member and table, however large a bucket.
    """
    dealt = fps.repartition(shuffle_partitions(fps.sparkSession), "fp")  # a row becomes 31: dealt evenly before
    keys = [F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(signed(m)))) for v, m in enumerate(covering_masks(radius))]
    rows = dealt.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    first = materialise(rows.groupBy("bucket").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "covers")
    near = (F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius)
    return rows.join(first.hint("merge"), "bucket").where(near).select("a", F.col("fp").alias("b")).distinct()


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (bucket, row) whose bucket has other rows too, with their number ``n``."""
    many = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    return materialise(rows.join(many.hint("merge"), "bucket"), "bucket-members")


#: Words of 64 bits in the parity sketch of a set.
PARITY = 16


def parities(s: str) -> Column:
    """A sketch of the set in column ``s`` (array of hashes): each hash flips one of 64 x PARITY bits.

    Sets that differ in d hashes differ in at most d bits, so pairs too far apart are told without a look at the sets,
    and no similar pair is lost.
    """
    flip = lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int")))
    word = lambda w: F.aggregate(F.filter(s, lambda h: F.pmod(h, F.lit(PARITY)) == w), F.lit(0).cast("long"), flip)
    return F.array(*[word(w) for w in range(PARITY)])


def settled(member: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``found`` and further links, so that no similar pair of a bucket of ``member`` (bucket, row) is left in two components.

    Rows of buckets that still hold several components are joined by prefixes: two sets of a similarity of at least
    ``threshold`` share one of their rarest shingles, of each as many as it may lack in the other and one more. Passages
    that many texts share are not among the rarest, so they bring no pairs together. Only pairs of two components whose
    sizes and parity sketches allow the similarity are compared; a group of copies is one component by now.
    """
    root = components(found, "a", "b").withColumnRenamed("node", "row")
    placed = materialise(member.select("bucket", "row").join(root, "row", "left").select("bucket", "row", F.coalesce("root", "row").alias("part")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
    open_ = materialise(placed.join(mixed, "bucket").select("row", "part").distinct().join(sets, "row").select("row", "part", "s"), "open")
    sketch = materialise(open_.select("row", "part", F.size("s").alias("size"), parities("s").alias("bits")), "parities")
    each = open_.select("row", F.size("s").alias("size"), "part", F.explode("s").alias("h"))
    many = materialise(each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("h", "df"), "shared-shingles")
    # shingles of one component alone bring nothing together: they count among the rarest but need no place in the join
    common = each.join(many, "h").groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("hs"))
    room = F.col("size") - F.ceil(F.col("size") * threshold) + 1 - (F.col("size") - F.size("hs"))
    rarest = common.where(room > 0).select("row", F.explode(F.slice("hs", 1, room.cast("int"))).alias("x")).select("row", F.col("x.h").alias("h"))
    prefix = materialise(rarest.join(sketch, "row"), "prefixes")
    x, y = (prefix.select("h", *(F.col(c).alias(f"{c}_{side}") for c in ("row", "part", "size", "bits"))) for side in "ab")
    apart = reduce(add, [F.bit_count(F.col("bits_a")[w].bitwiseXOR(F.col("bits_b")[w])) for w in range(PARITY)])
    most = (F.col("size_a") + F.col("size_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    met = x.join(y, "h").where((F.col("part_a") < F.col("part_b")) & (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a")) & (apart <= most))
    pairs = materialise(met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct(), "open-pairs")
    return found.unionByName(verified(pairs, sets, threshold))


def to_centres(member: DataFrame) -> DataFrame:
    """Pairs (a, b) of each row of ``member`` with the row of its bucket that is in the fullest buckets."""
    ranked = member.join(member.groupBy("row").agg(F.sum("n").alias("typical")), "row")
    best = F.max(F.struct("typical", (-F.col("row")).alias("low"), "row"))["row"]
    return member.join(materialise(ranked.groupBy("bucket").agg(best.alias("a")), "bucket-centres"), "bucket").select("a", F.col("row").alias("b"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (row, s) have Jaccard similarity ``threshold`` or over."""
    of = lambda c: sets.select(F.col("row").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def linked(docs: DataFrame, unique: DataFrame, width: int, threshold: float, radius: int) -> DataFrame:
    """Verified links (a, b) between rows of ``unique`` (the ``sketches`` of ``docs``), whose components are those of all similar pairs."""
    first = materialise(unique.groupBy("fp").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")), "fingerprints")
    alike = unique.join(first.where("copies > 1"), "fp").select(F.col("first").alias("a"), F.col("row").alias("b"))
    to = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_row"))
    close = covered(first.select("fp"), radius).join(to("a"), "a").join(to("b"), "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"))
    member = shared_buckets(unique.select(F.explode("bands").alias("bucket"), "row"))
    pairs = alike.unionByName(close).unionByName(to_centres(member)).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")

    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = materialise(unique.join(ids, "row", "left_semi").select("row", F.col("key").alias("_key")), "pair-texts")
    # texts are shuffled and split into words after it: their words as arrays are twice as large
    few = docs.select(F.col("text").cast("string").alias("text"))
    if wanted.take(1):
        few, _ = split(few, text_key(few["text"]), wanted.select("_key"))  # others aren't shuffled
    few = few.select(text_key(F.col("text")).alias("key"), "text").join(wanted.hint("merge"), F.col("key") == F.col("_key")).select("row", "text")
    if unique.where("n > 1").take(1):
        few = few.dropDuplicates(["row"])
    few = few.select("row", words(F.col("text")).alias("w"))
    # the filter is on the words: one on the shingles would be pushed below and evaluate them for every word
    sets = materialise(few.where("size(w) > 0").select("row", F.array_distinct(shingles(F.col("w"), width)).alias("s")), "shingle-sets")
    return settled(member, materialise(verified(pairs, sets, threshold), "links"), sets, threshold)


def similar(docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 4) -> DataFrame:
    """Links (a, b) between the doc_ids of different texts: Jaccard similarity of the sets of ``width``-word shingles at ``threshold`` or over.

    A few changed words change a text's word set little, so candidates are texts whose fingerprints of word sets lie
    within ``radius``, found by covering. Cut or added passages change it more, so texts that share a MinHash bucket of
    their shingles are candidates as well. In each bucket of either kind members are first compared with one of them
    alone, which is linear in its size; members of a MinHash bucket that are not connected then meet by their rarest
    shingles (``settled``). So not every similar pair gets a link, but the components are those of all similar pairs that
    share a MinHash bucket (0.9999 of those at 0.8, more above). Texts without words link to nothing; equal texts are
    one, of the smallest doc_id; texts without an id have null there.
    """
    unique = sketches(docs, width)
    of = lambda c: unique.select(F.col("row").alias(c), F.col("doc_id").alias(f"{c}_id"))
    named = linked(docs, unique, width, threshold, radius).join(of("a"), "a").join(of("b"), "b")
    return named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group that links of ``similar`` connect; columns unchanged.

    The row of the smallest doc_id stays, null ids last, then by text. Of rows of equal texts one stays as well, but
    all rows without words do. Rows that repeat an id with different texts are different documents.
    """
    unique = sketches(docs, width)
    root = components(linked(docs, unique, width, threshold, radius), "a", "b")
    group = materialise(root.join(unique.select(F.col("row").alias("node"), "doc_id", "key"), "node"), "groups")
    best = group.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("stays"))
    gone = group.join(best, "root").where("key != stays").select("key")
    return one_of_each(drop_texts(docs, gone), text_key(F.col("text")), unique.where("n > 1"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=4, radius=4)
