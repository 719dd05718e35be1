"""Operators that the queries don't reach, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions import udfs
from strandloom.operators import cohort, documents, evaluate, frames, pathways, patterns, sampling, stats, terminology
from strandloom.sources import readers, writers
from strandloom.state import numbered, placed


def test_deep_and_wide_hierarchies(spark):
    chain = spark.range(200).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent"))
    up = terminology.closure(chain)
    assert up.count() == 201 * 202 // 2
    assert up.where("node = '0' and ancestor = '200'").first().depth == 200
    wide = spark.range(1_200_000).select(F.concat(F.lit("c"), F.col("id")).alias("child"), F.concat(F.lit("p"), F.col("id") % 1000).alias("parent"))
    assert terminology.closure(wide).count() == 2 * 1_200_000 + 1000
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    for f in (terminology.closure, terminology.layers):
        with pytest.raises(ValueError):
            f(ring)
    assert terminology.closure(chain.where("false")).count() == 0


def test_layers_by_longest_way(spark):
    e = spark.createDataFrame([("b_1", "a_1"), ("c_1", "b_1"), ("c_1", "a_1"), ("d_1", None)], "child string, parent string")
    found = terminology.layers(e)
    assert {r.node: r.layer for r in found.collect()} == {"a_1": 0, "b_1": 1, "c_1": 2}
    assert [r.node for r in terminology.linearized(found).orderBy("place").collect()] == ["a", "b", "c"]


def test_numbered_rows(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    got = [r.i for r in numbered(df, ["h"], "i").orderBy("h").collect()]
    assert got == list(range(5000))
    assert numbered(df.where("false"), ["h"], "i").count() == 0


def test_documents_are_counted_without_meeting_every_pattern(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F
    from strandloom.operators import patterns

    draw = random.Random(5)
    docs = [(i, [draw.choice("abcdef") for _ in range(draw.randint(0, 9))]) for i in range(60)] + [(3, list("abcabc")), (70, None)]
    kinds = sorted({tuple(draw.choice("abcdefg") for _ in range(draw.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame(docs, "doc_id long, codes array<string>")
    given = spark.createDataFrame([(i, list(p)) for i, p in enumerate(kinds)], "pattern_id int, pattern array<string>")
    old = patterns.containing(df, given).groupBy("pattern_id").agg(F.countDistinct("doc_id").alias("df"))
    want = {r.pattern_id: r.df for r in old.collect()}
    monkeypatch.setattr(patterns, "FEW", 0)
    for rows in (df, df.where("doc_id <> 3")):  # ids that repeat, and none
        found = patterns.document_counts(rows, given).collect()
        got = {r.pattern_id: r.df for r in found}
        assert len(found) == len(got) and (got == want if rows is df else got.keys() <= want.keys())
    monkeypatch.setattr(patterns, "containing", None)  # documents times patterns
    assert pathways.derive(df, df.where("doc_id < 6"), at_least=2).count() > 0


def test_long_patterns_are_counted_where_documents_are(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strandloom.operators import patterns

    draw = random.Random(6)
    docs = [(i, [draw.choice("abcdefgh") for _ in range(draw.randint(0, 14))]) for i in range(200)] + [(300, None), (301, ["a", None, "b", "c", "b"])]
    kinds = sorted({tuple(draw.choice("abcdefghz") for _ in range(draw.randint(3, 6))) for _ in range(400)})
    inside = lambda p, t: all(c in it for it in [iter(t)] for c in p)
    want = {i: n for i, p in enumerate(kinds) if (n := sum(inside(p, t) for _, t in docs if t))}
    df = spark.createDataFrame(docs, "doc_id long, codes array<string>")
    given = spark.createDataFrame([(i, list(p)) for i, p in enumerate(kinds)], "pattern_id int, pattern array<string>")
    monkeypatch.setattr(patterns, "FEW", 0)
    for side, at_once, pairs in ((patterns.SIDE, patterns.PATTERNS_AT_ONCE, patterns.PAIRS_AT_ONCE), (patterns.SIDE, 90, 50), (4, 150, 1000)):
        for name, value in (("SIDE", side), ("PATTERNS_AT_ONCE", at_once), ("PAIRS_AT_ONCE", pairs)):
            monkeypatch.setattr(patterns, name, value)
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        found = patterns.document_counts(df, given).collect()
        assert {r.pattern_id: r.df for r in found} == want and len(found) == len(want) > 100
        new = store.executionsList(before, 1000)
        assert not [i for i in range(new.size()) if "Generate" in new.apply(i).physicalPlanDescription()]  # documents times pairs of items


def test_vectors_are_scored_by_products_of_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strandloom.operators import features

    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)] + [(90, None), (91, [0.0] * 4), (92, [1.0, 2.0])]  # ties, null, zero, short
    df = spark.createDataFrame(rows, "k int, x array<float>")
    asked = df.where("k % 7 = 0 or k > 88")
    exact = df.select(F.col("k").alias("b"), F.col("x").alias("y")).join(asked.select(F.col("k").alias("a"), "x"), F.col("a") != F.col("b"))
    exact = exact.select("a", "b", F.round(1 - features.cosine(F.col("y"), F.col("x")), 6).alias("d")).collect()
    monkeypatch.setattr(features, "cosine", None)  # a row at a time
    monkeypatch.setattr(features, "ROW_BLOCK", 20)
    got = features.distances(df, asked, "k", "x", block=5)
    assert got.schema["a"].dataType == df.schema["k"].dataType
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, (tuple(r) for r in exact)))
    want = {a: [r.b for r in sorted((r for r in exact if r.a == a), key=lambda r: (r.d is not None, r.d or 0.0, r.b))[:6]] for a in {r.a for r in exact}}
    near = features.nearest_to(df, asked, "k", "x", 6, block=5).collect()
    assert {a: [r.neighbour_id for r in sorted((r for r in near if r.query_id == a), key=lambda r: r["rank"])] for a in want} == want


def test_scored_vectors_are_not_shuffled(spark):
    from strandloom.operators import features

    df = spark.range(400).select("id", F.array(*[F.cos(F.col("id") * i) for i in range(1, 9)]).alias("x"))
    asked = df.where("id % 50 = 0")
    made = features.distances(df, asked, "id", "x", block=3)
    assert made.count() == 8 * 399
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert len(made.collect()) == 8 * 399
    plans = [store.executionsList(before, 1000).apply(0).physicalPlanDescription()]
    assert "MapInArrow" in plans[0] and "Exchange" not in plans[0]
    near = features.nearest_to(df, asked, "id", "x", 5, block=3)
    want = {}
    for r in sorted(made.collect(), key=lambda r: (r.distance, r.b)):
        want.setdefault(r.a, []).append(r.b)
    assert sorted((r.query_id, r["rank"], r.neighbour_id) for r in near.collect()) == sorted((a, i + 1, b) for a, bs in want.items() for i, b in enumerate(bs[:5]))


def test_derived_subsequences(spark):
    rng = random.Random(3)
    docs = {i: [rng.choice("abcd") for _ in range(rng.randrange(3, 12))] for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, codes array<string>")
    got = pathways.derive(df, df.where("doc_id < 6"), at_least=2).collect()
    inside = lambda p, t: all(c in it for it in [iter(t)] for c in p)
    counts = {}
    for a in range(6):
        for b in range(a + 1, 6):
            items = udfs.lcs_items(docs[a], docs[b])
            runs = [x for i, x in enumerate(items) if not i or items[i - 1] != x]
            if len(runs) >= 2:
                counts[" ".join(runs)] = counts.get(" ".join(runs), 0) + 1
    assert {r.lcs: r.n for r in got} == counts
    for r in got:
        assert r.df == sum(inside(r["items"], t) for t in docs.values()) and r.n_uniq == len(set(r["items"]))


def test_common_subsequence_length(spark):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert udfs.lcs_size(a, b) == len(udfs.lcs_items(a, b))


def test_visits_unrolled(spark):
    df = spark.createDataFrame([(1, [["a", "b"], [], ["c"]]), (2, [])], "i int, visits array<array<string>>")
    assert sorted((r.i, r.sentence) for r in documents.unroll(df).collect()) == [(1, "a c"), (1, "b c"), (2, "")]


def test_steps_by_name(spark):
    df = spark.createDataFrame([(1, [("a",), ("x",), ("b",)])], "i int, events array<struct<code:string>>")
    codes = lambda d: [e.code for e in d.first().events]
    assert codes(documents.transformed(df, "cut", lambda c: c == "x", inclusive=False)) == ["a"]
    assert codes(documents.transformed(df, "filter", lambda c: c != "x")) == ["a", "b"]
    assert codes(documents.transformed(df, "simplify", lambda c: F.upper(c))) == ["A", "X", "B"]
    with pytest.raises(ValueError):
        documents.transformed(df, "other", lambda c: c)
    assert documents.content_type("Medication") == "med" and documents.content_type("diagnosis codes") == "diag"
    with pytest.raises(ValueError):
        documents.content_type("zzz")
    assert documents.option(["a", "b"], 1, b=2) == 2 and documents.option(["a"], 1) == 1


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert frames.dropped(df, ["b", "nope"]).columns == ["a"]
    arrays = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    assert arrays.select(frames.gather(F.col("v"), F.array(F.lit(2), F.lit(5)))).first()[0] == [3, None]
    runs = spark.createDataFrame([(["a", "a", "b", "a"],), ([],)], "v array<string>")
    assert [r[0] for r in runs.select(S.collapse_runs(F.col("v"))).collect()] == [["a", "b", "a"], []]


def test_sparse_tables_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f", 2.0), (2, "g", 1.0)], "doc_id long, feature string, value double")
    writers.write_sparse(rows, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.sparse(spark, str(tmp_path / "m")).collect())) == [(1, "f", 2.0), (2, "g", 1.0)]
    (tmp_path / "map.csv").write_text("a,b\n1,x\n")
    assert readers.folder_tables(spark, str(tmp_path), ["map"])["map"].first() == ("1", "x")


def test_draws_repeat(spark):
    ids = spark.range(50).withColumnRenamed("id", "k")
    a, b = ([(r.draw, r.k) for r in sampling.draws(ids, "k", 200, seed=3).orderBy("draw").collect()] for _ in range(2))
    assert a == b and len(a) == 200 and {k for _, k in a} <= set(range(50)) and len({k for _, k in a}) > 30


def test_rank_sum_with_ties(spark):
    rows = [(g, v) for g, v in ((0, 1), (0, 2), (0, 2), (0, 3), (1, 2), (1, 3), (1, 3), (1, 4), (1, 5))]
    r = evaluate.rank_sum(spark.createDataFrame(rows, "g int, v int"), [], "g", "v").first()
    # by hand: ranks 1, 3, 3, 6 and 3, 6, 6, 8, 9; ties of 3 at 2 and 3 at 3
    u = 3 + 6 + 6 + 8 + 9 - 15
    sd = (20 / 12 * (10 - (24 + 24) / 72)) ** 0.5
    assert r.u == u and abs(r.z - (u - 10) / sd) < 1e-12
    import math

    assert abs(r.p - math.erfc(abs(r.z) / 2**0.5)) < 1e-6


def test_rows_placed_in_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(10**9), rng.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    got = {(r.g, r.v): (r["_upto"], r["_n"]) for r in placed(df, ["g"], ["v"], F.col("w")).collect()}
    for g in ("a", "b", None):
        total, all_ = 0, sorted((v, w) for k, v, w in rows if k == g)
        for v, w in all_:
            total += w
            assert got[g, v] == (total, sum(w for _, w in all_))
    assert sorted(r["_upto"] for r in placed(df, [], ["v", "g"]).collect()) == list(range(1, 3001))
    assert placed(df.where("false"), ["g"], ["v"]).count() == 0


def test_quantiles_of_skewed_groups(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=4000), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([2.5])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("d", None)], "k string, x double")
    got = {r.k: r for r in stats.quantiles(df, ["k"], F.col("x"), {"low": 0.1, "mid": 0.5}).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert abs(got[k].low - np.quantile(v, 0.1)) < 1e-12 and abs(got[k].mid - np.quantile(v, 0.5)) < 1e-12 and got[k].n_values == len(v)
    assert abs(stats.quantiles(df, [], F.col("x"), {"q": 0.3}).first().q - np.quantile(np.concatenate([*values.values()]), 0.3)) < 1e-12


def test_layers_of_chains_and_rings(spark):
    chain = spark.range(30_000).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    found = terminology.layers(chain)
    assert found.where("layer + node <> 30000").count() == 0 and found.count() == 30_001
    ring = spark.range(30_000).select(F.col("id").alias("child"), F.pmod(F.col("id") + 1, F.lit(30_000)).alias("parent"))
    knot = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (3, 4)], "child long, parent long")
    for bad in (ring, knot):
        with pytest.raises(ValueError):
            terminology.layers(bad)
    rng = random.Random(2)
    edges = [(i, rng.randrange(i)) for i in range(1, 300) for _ in range(rng.choice([1, 1, 2]))]
    depth = {0: 0}
    for i in range(1, 300):
        depth[i] = 1 + max(depth[p] for c, p in edges if c == i)
    assert {r.node: r.layer for r in terminology.layers(spark.createDataFrame(edges, "child long, parent long")).collect()} == depth


def test_maximal_sets_and_leaders(spark):
    rng = random.Random(6)
    sets = {i: sorted({rng.choice("abcdefg") for _ in range(rng.randrange(6))}) for i in range(80)}
    df = spark.createDataFrame([(i, x, i % 3) for i, x in sets.items()], "k long, x array<string>, e long")
    want = sorted(i for i, x in sets.items() if not any(set(x) < set(y) for y in sets.values()))
    assert sorted(r.k for r in patterns.maximal_sets(df, "k", "x").collect()) == want
    got = {r.k: r.leader for r in cohort.group_by_subset(df, "k", "e", "x").collect()}
    for i, x in sets.items():
        assert got[i] == min((-len(y), j) for j, y in sets.items() if j % 3 == i % 3 and set(x) <= set(y))[1]


def test_pairs_of_neighbours_in_an_order(spark):
    df = spark.createDataFrame([(i, ["a"] * (i % 7 + 1)) for i in range(20)], "doc_id long, codes array<string>")
    order = sorted(range(20), key=lambda i: (-(i % 7 + 1), i))
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(order) for b in order[i + 1 : i + 3])
    got = pathways.pairs(df, 2, "longest").collect()
    assert sorted((r.a, r.b) for r in got) == want and all(len(r.codes_a) == r.a % 7 + 1 and len(r.codes_b) == r.b % 7 + 1 for r in got)


def test_derivation_in_one_run(spark):
    docs = [(1, ["a", "b", "c"], "x"), (2, ["a", "q", "b"], "x"), (3, ["b", "a", "a"], "x"), (4, ["b", "a", "z"], "x"), (5, ["a", "b"], "y")]
    df = spark.createDataFrame(docs, "doc_id long, codes array<string>, label string")
    got = {r.lcs: r for r in pathways.derive(df, df, None, label="label", permutations=False).collect()}
    assert set(got) == {"a b"} and got["a b"].n == 2 and got["a b"].df == 3  # (1, 2) gives a b, (3, 4) b a: one, counted as a b
    assert pathways.derive(df, df, None, label="label", min_df=4).count() == 0
    assert {r.lcs for r in pathways.derive(df, df, None, at_least=1, at_most=1).collect()} == {"a", "b"}


def test_short_patterns_are_counted_without_meeting_documents(spark, monkeypatch):
    """Items and pairs are counted in the tasks, in a square table or by runs; no document is joined with a pattern."""
    import random

    rnd = random.Random(8)
    docs = [(i, None if i == 3 else [rnd.choice("abcdefgh") for _ in range(rnd.randrange(9))]) for i in range(60)]
    kinds = [[a] for a in "abcdefghz"] + [[a, b] for a in "abcdefgh" for b in "abcdefgh"]

    def held(p, codes):
        it = iter(codes or [])
        return all(x in it for x in p)

    want = {" ".join(p): n for p in kinds if (n := sum(held(p, c) for _, c in docs))}
    rows = spark.createDataFrame(docs, "doc_id int, codes array<string>").repartition(3)
    given = spark.createDataFrame([(" ".join(p), p) for p in kinds], "pattern_id string, pattern array<string>")
    monkeypatch.setattr(patterns, "containing", None)
    assert {r.pattern_id: r.df for r in patterns.document_counts(rows, given).collect()} == want
    for side, at_once in ((4, 1 << 20), (2048, 10), (0, 10)):
        monkeypatch.setattr(patterns, "SIDE", side)
        monkeypatch.setattr(patterns, "PAIRS_AT_ONCE", at_once)
        got = {" ".join(x for x in (r.x, r.y) if x): r.df for r in patterns.item_pair_counts(rows).collect()}
        assert got == want
