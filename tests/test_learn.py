"""Clusters, factorisations, model selection, getters and trees against plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import getters, udfs
from strandloom.operators import clustering, factors, features, graphs, pathways, selection, terminology, training

SF = "/root/testdata/sf0.001"


def vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    rows = sorted((r.vec_id, list(r.embedding)) for r in e.collect())
    return e, [i for i, _ in rows], np.array([x for _, x in rows])


def test_components_of_any_shape(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(90)] + [(7, 7), (9999, 9999)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_density_clusters_of_embeddings(spark):
    """Whole vectors of 64 coordinates, with repeats, against a plain scan of all pairs."""
    e, ids, x = vectors(spark)
    rows = e.union(e.where("vec_id < 5").select(F.col("vec_id") + 10_000, "embedding"))
    ids, x = [*ids, *(i + 10_000 for i in ids[:5])], np.concatenate([x, x[:5]])
    radius, least = 1.17, 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = d <= radius
    core = near.sum(axis=1) >= least
    label = {i: None for i in range(len(ids))}
    for s in sorted(range(len(ids)), key=lambda i: ids[i]):
        if core[s] and label[s] is None:
            todo = [s]
            while todo:
                i = todo.pop()
                if label[i] is None:
                    label[i] = ids[s]
                    todo += [j for j in np.flatnonzero(near[i] & core) if label[j] is None]
    got = {r.vec_id: r for r in clustering.dbscan(rows, "vec_id", "embedding", radius, least, [0, 1]).collect()}
    assert len(got) == len(ids) and core.sum() > 20 and (~core).sum() > 20
    for i, k in enumerate(ids):
        assert got[k].core == bool(core[i])
        if core[i]:
            assert got[k].cluster == label[i]
        else:
            cores = [(round(d[i, j], 12), ids[j]) for j in np.flatnonzero(near[i] & core)]
            assert got[k].cluster == (label[ids.index(min(cores)[1])] if cores else None)


def test_single_linkage_and_cophenetic_heights(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(60, 3)), 1)  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    forest, ways = clustering.single_linkage(rows, "k", "x", 100.0, 60, [0])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    top = d.copy()
    for m in range(60):  # the smallest heaviest step over all ways
        top = np.minimum(top, np.maximum(top[:, m : m + 1], top[m : m + 1, :]))
    assert forest.count() == 59 and abs(sum(r.weight for r in forest.collect()) - _tree_weight(d)) < 1e-9
    pairs = spark.createDataFrame([(a, b, float(d[a, b])) for a in range(60) for b in range(60) if a != b], "a long, b long, distance double")
    found = clustering.cophenetic(pairs, ways).collect()
    assert all(abs(r.height - top[r.a, r.b]) < 1e-9 for r in found)
    one = clustering.cophenetic_correlation(clustering.cophenetic(pairs, ways)).first()
    off = ~np.eye(60, dtype=bool)
    assert abs(one.correlation - np.corrcoef(d[off], top[off])[0, 1]) < 1e-9
    got = {r.k: r.cluster for r in clustering.cut(forest, rows, "k", 0.8).collect()}
    assert got == {i: min(j for j in range(60) if i == j or top[i, j] <= 0.8) for i in range(60)}
    # rows that nothing joins
    far = clustering.single_linkage(rows, "k", "x", 0.3, 5, [0, 1])[1]
    apart = clustering.cophenetic(pairs, far).where("height is null").count()
    assert apart > 0


def test_nearest_rows_are_found_without_all_near_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(150, 2)) * 0.05, rng.normal(size=(60, 2)) * 3]), 2)  # a dense place, copies, lone rows
    x = np.concatenate([x, np.repeat(x[:3], 9, axis=0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "k long, x array<double>")
    old = clustering.nearest_graph(clustering.near_pairs(rows, "k", "x", 1.0, [0, 1]), 4)
    want = sorted((r.a, r.b, r.distance, r["rank"]) for r in old.collect())
    monkeypatch.setattr(clustering, "near_pairs", None)  # all pairs inside the radius: quadratic in a dense place
    got = sorted((r.a, r.b, r.distance, r["rank"]) for r in clustering.nearest_within(rows, "k", "x", 1.0, 4, [0, 1]).collect())
    assert got == want and len(want) > 700
    forest, ways = clustering.single_linkage(rows, "k", "x", 1.0, 4, [0, 1])
    asked = rows.where("k % 10 = 0")
    pairs = rows.select(F.col("k").alias("b")).join(asked.select(F.col("k").alias("a")), F.col("a") != F.col("b"))
    height = {(r.a, r.b): r.height for r in clustering.cophenetic(pairs, ways).collect()}
    made = clustering.cophenetic_of(rows, asked, "k", "x", ways, block=7)
    assert {(r.a, r.b): r.height for r in made.collect()} == height and None in height.values()
    few = clustering.cophenetic_of(rows, asked, "k", "x", ways, joined=True, block=7).collect()
    assert {(r.a, r.b): r.height for r in few} == {p: h for p, h in height.items() if h is not None}
    assert all(abs(r.distance - np.linalg.norm(x[r.a] - x[r.b])) < 1e-12 for r in few)


def test_correlation_of_equal_heights(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5, 0.0), (2, 3, 0.7, 0.0)], "a long, b long, distance double, height double")
    one = clustering.cophenetic_correlation(pairs).first()
    assert math.isnan(one.correlation) and one.n_pairs == 2
    assert clustering.cophenetic_correlation(pairs.where("false")).first().correlation is None


def _tree_weight(d):
    inside, total = {0}, 0.0
    best = d[0].copy()
    while len(inside) < len(d):
        j = min((j for j in range(len(d)) if j not in inside), key=lambda j: best[j])
        total += best[j]
        inside.add(j)
        best = np.minimum(best, d[j])
    return total


def test_lloyd_steps_and_the_gap(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.1 + c for c in ([0, 0], [3, 3], [0, 4])])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>")
    start = x[[0, 1, 50]]
    c = start.copy()
    for _ in range(30):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(3)])
    assert np.allclose(clustering.lloyd(rows, "k", "x", 3, centres=start.tolist()), c, atol=1e-9)
    found = clustering.gap_statistic(rows, "k", "x", [1, 2, 3, 4], references=4, steps=10)
    assert clustering.best_k(found) == 3
    for r in found:
        assert abs(r["gap"] - (r["expected"] - r["log_w"])) < 1e-12 and r["s"] >= 0
    box = clustering.uniform_like(rows, "k", "x", 1).collect()
    assert all(x[:, i].min() <= r.x[i] <= x[:, i].max() for r in box for i in (0, 1)) and len({tuple(r.x) for r in box}) == 120


def test_singular_values(spark):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((40, 25)) < 0.3, rng.random((40, 25)), 0) + np.outer(rng.random(40), rng.random(25)) * 3
    entries = spark.createDataFrame([(int(i), f"t{j:02}", float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j string, value double")
    s, left, right = factors.truncated_svd(entries, 3, iterations=60, tolerance=1e-12)
    u, want, v = np.linalg.svd(m)
    assert np.abs(s - want[:3]).max() < 1e-6
    l = np.array([r.x for r in left.orderBy("id").collect()])  # noqa: E741
    r = np.array([r.x for r in right.orderBy("id").collect()])
    assert np.abs(np.abs(np.diag(l.T @ u[:, :3])) - 1).max() < 1e-4 and np.abs(np.abs(np.diag(r.T @ v[:3].T)) - 1).max() < 1e-4


def test_singular_values_of_documents(spark):
    from strandloom.plans import queries_learn

    entries = queries_learn.word_counts(spark, SF)
    rows = entries.collect()
    at = [{k: n for n, k in enumerate(sorted({r[c] for r in rows}))} for c in ("i", "j")]
    m = np.zeros((len(at[0]), len(at[1])))
    for r in rows:
        m[at[0][r.i], at[1][r.j]] += r.value
    s, _, _ = factors.truncated_svd(entries, 2, iterations=40, tolerance=1e-11)
    want = np.linalg.svd(m, compute_uv=False)[:2]
    assert np.abs(s / want - 1).max() < 1e-6


def test_planted_blocks_are_found(spark):
    rng = random.Random(6)
    rows = [(i, f"w{j}", 5.0 if i % 3 == j % 3 else 1.0) for i in range(36) for j in range(24) if i % 3 == j % 3 or rng.random() < 0.1]
    got = factors.coclusters(spark.createDataFrame(rows, "i long, j string, value double"), 3).collect()
    kind = {(r.side, r.id): r.cluster for r in got}
    assert len(kind) == 60
    of = [{kind["i", str(i)] for i in range(36) if i % 3 == b} | {kind["j", f"w{j}"] for j in range(24) if j % 3 == b} for b in range(3)]
    assert all(len(x) == 1 for x in of) and len(set.union(*of)) == 3


def test_words_that_stand_alike_have_like_vectors(spark):
    rng = random.Random(7)
    docs = [(i, [rng.choice(["red", "blue"] if k % 2 else ["car", "bus"]) if i % 2 else rng.choice(["sun", "moon"] if k % 2 else ["rise", "set"]) for k in range(20)]) for i in range(30)]
    counts = factors.cooccurrences(spark.createDataFrame(docs, "i long, t array<string>"), "t", 2)
    plain = {}
    for _, t in docs:
        for a in range(len(t)):
            for b in range(max(0, a - 2), min(len(t), a + 3)):
                if a != b:
                    plain[t[a], t[b]] = plain.get((t[a], t[b]), 0) + 1
    assert {(r.x, r.y): r.n for r in counts.collect()} == plain
    vectors = factors.word_vectors(factors.positive_pmi(counts), 3, iterations=40)
    pairs = spark.createDataFrame([("red", "blue"), ("red", "sun"), ("red", "none")], "x string, y string")
    by = {r.y: r.similarity for r in factors.pair_similarities(pairs, vectors).collect()}
    assert set(by) == {"blue", "sun"} and by["blue"] > 0.9 > by["sun"]
    dealt = factors.shuffled_pairs(counts.select("x", "y")).collect()
    assert sorted(r.x for r in dealt) == sorted(a for a, _ in plain) and sorted(r.y for r in dealt) == sorted(b for _, b in plain)


def labelled(spark, n=240):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] - 2 * x[:, 2] + 0.3 * rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(n)], "k long, a double, b double, c double, d double, y int")


def test_planted_features_are_stable(spark):
    df = labelled(spark)
    got = selection.stability(df, list("abcd"), "y", "k", draws=4, strength=0.05)
    assert got == selection.stability(df, list("abcd"), "y", "k", draws=4, strength=0.05)
    by = dict(got)
    assert by["a"] == by["c"] == 1.0 and max(by["b"], by["d"]) < 1.0


def test_nested_cross_validation(spark):
    df = labelled(spark)
    got = selection.nested_cv(df, list("abcd"), "y", "k", [("logistic", 0.0), ("svm", 0.1)], outer=2, inner=2).collect()
    assert sorted(r.k for r in got) == list(range(240)) and {r.fold for r in got} == {0, 1}
    truth = {r.k: r.y for r in df.collect()}
    assert all(r.label == truth[r.k] and r.predicted == (r.score > 0) for r in got)
    assert sum(r.label == r.predicted for r in got) > 200
    assert len({(r.fold, r.kind, r.strength) for r in got}) == 2
    with pytest.raises(ValueError):
        selection.classifier("tree", 0.1)


def test_report_and_curves(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), rng.randrange(2), rng.randrange(6)) for _ in range(200)] + [("z", 1, 3)]
    df = spark.createDataFrame(rows, "k string, y int, s int")
    grid = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    points = selection.roc_points(df, ["k"], "y", "s")
    curves = {(r.k, r.x): r.tpr for r in selection.on_grid(points, ["k"], grid).collect()}
    for k in "xy":
        own = [(y, s) for g, y, s in rows if g == k]
        pos, neg = sum(y for y, _ in own), sum(1 - y for y, _ in own)
        pts = [(0.0, 0.0)] + [(sum(1 - y for y, s in own if s >= t) / neg, sum(y for y, s in own if s >= t) / pos) for t in sorted({s for _, s in own}, reverse=True)]
        assert sorted((round(r.fpr, 9), round(r.tpr, 9)) for r in points.where(f"k = '{k}'").collect()) == sorted((round(a, 9), round(b, 9)) for a, b in pts)
        for g in grid:
            assert abs(curves[k, g] - np.interp(g, [a for a, _ in pts], [b for _, b in pts])) < 1e-9
    assert points.where("k = 'z'").count() == 0
    mean = {r.x: r.tpr for r in selection.mean_curve(selection.on_grid(points, ["k"], grid)).collect()}
    assert all(abs(mean[g] - (curves["x", g] + curves["y", g]) / 2) < 1e-12 for g in grid)
    assert abs(selection.area(selection.mean_curve(selection.on_grid(points, ["k"], grid)), []).first().area - np.trapezoid([mean[g] for g in grid], grid)) < 1e-9
    said = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in selection.report(said).collect()}
    assert got == {0: (1.0, 0.5, 2), 1: (1 / 3, 1.0, 1), 2: (0.0, 0.0, 1)}


def test_common_subsequences_of_many(spark):
    rng = random.Random(1)

    def longest(rows):
        seen = {}

        def go(p):
            if p not in seen:
                seen[p] = 0
                for c in set.intersection(*map(set, rows)):
                    q = []
                    for r, i in zip(rows, p):
                        if c not in r[i:]:
                            break
                        q.append(r.index(c, i) + 1)
                    else:
                        seen[p] = max(seen[p], 1 + go(tuple(q)))
            return seen[p]

        return go((0,) * len(rows)) if rows and all(rows) else 0

    inside = lambda p, t: all(c in it for it in [iter(t)] for c in p)
    for _ in range(60):
        rows = [[rng.choice("abcd") for _ in range(rng.randrange(0, 14))] for _ in range(rng.choice([1, 2, 3, 4]))]
        got = udfs.lcs_of_all(rows)
        assert len(got) == longest(rows) and all(inside(got, r) for r in rows)
    assert len(udfs.lcs_of_all([[rng.choice("abcde") for _ in range(100)] for _ in range(5)])) > 20  # in under a second
    assert len(udfs.lcs_of_all(["abacbdab", "bdcaba", "cbacaa"])) == 3

    docs = {i: [rng.choice("abc") for _ in range(8)] for i in range(13)}
    df = spark.createDataFrame([(i, c, "xy"[i % 2]) for i, c in docs.items()], "doc_id long, codes array<string>, label string")
    sets = pathways.subsets(df, 3, 2, label="label").collect()
    assert len(sets) == 2 * (7 // 3 + 6 // 3) and all(len(r.sequences) == 3 for r in sets)
    got = pathways.derive_many(df, 3, rounds=2, at_least=1, label="label").collect()
    counts = {}
    for r in sets:
        items = udfs.lcs_of_all([list(s) for s in r.sequences])
        runs = " ".join(x for i, x in enumerate(items) if not i or items[i - 1] != x)
        if runs:
            counts[r.label, runs] = counts.get((r.label, runs), 0) + 1
    assert {(r.label, r.lcs): r.n for r in got} == counts
    assert all(r.df == sum(inside(r["items"], c) for c in docs.values()) for r in got)


def test_getters_by_name(spark):
    name = getters.register(spark, "prefixes")
    spark.createDataFrame([("250.13",), ("7",), (None,)], "code string").createOrReplaceTempView("codes")
    got = spark.sql(f"SELECT code, value FROM codes, LATERAL {name}(code)").collect()
    assert sorted((r.code, r.value) for r in got) == [("250.13", "250"), ("250.13", "250.1"), ("250.13", "250.13"), ("7", "7")]


def test_json_trees(spark):
    deep = {"name": "n0", "children": []}
    at = deep
    for i in range(1, 12):
        at["children"].append({"name": f"n{i}", "children": []})
        at["children"].append({"name": f"leaf{i}"})
        at = at["children"][0]
    rows = [(json.dumps(deep),), ("not json",), (None,), ('{"children": [{"name": "x"}]}',), ('{"name": "a", "children": [{"children": [{"name": "y"}]}, {"name": 5}]}',)]
    got = {(r.child, r.parent) for r in terminology.json_tree_edges(spark.createDataFrame(rows, "j string"), "j").collect()}
    assert got == {(f"n{i}", f"n{i - 1}") for i in range(1, 12)} | {(f"leaf{i}", f"n{i - 1}") for i in range(1, 12)} | {("5", "a")}
    assert terminology.json_tree_edges(spark.createDataFrame([("{",)], "j string"), "j").count() == 0


def test_siblings_and_keyword_groups(spark):
    e = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("a", "q")], "child string, parent string")
    assert {(r.node, r.sibling) for r in terminology.siblings_of(e).collect()} == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    rows = [(1, "Acute renal failure"), (2, "renal cyst of it"), (3, "common cold"), (4, "Cold weather, common"), (5, None), (6, "acute of it")]
    got = {r.k: r.group for r in terminology.keyword_groups(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1}
    assert math.isclose(sum(got.values()), 14)


def test_few_columns_need_no_join(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), f"t{j:02}", float(rng.random())) for i in range(60) for j in range(20) if (i + j) % 3]
    entries = spark.createDataFrame(rows + [(None, "t00", 2.0)] + rows[:5], "i long, j string, value double")
    got = {}
    for most in (0, 100):
        monkeypatch.setattr(factors, "BROADCAST_ROWS", most)
        s, *sides = factors.truncated_svd(entries.where("i is not null"), 2, iterations=60, tolerance=1e-12)
        got[most] = s, [{r.id: np.array(r.x) for r in x.collect()} for x in sides]
    assert np.abs(got[0][0] - got[100][0]).max() < 1e-8
    for a, b in zip(got[0][1], got[100][1]):
        assert a.keys() == b.keys()
        for c in range(2):
            x, y = (np.array([v[c] for _, v in sorted(side.items())]) for side in (a, b))
            assert abs(abs(x @ y) - 1) < 1e-6
    monkeypatch.setattr(factors, "_times", None)  # no join with the entries
    factors.truncated_svd(entries.where("i is not null"), 2, iterations=3)


def test_pairs_are_counted_before_they_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(features, "SLICE_WORDS", 7)
    docs = [(["a", "a", "b", "a", None, "a"],), ([],), (None,), (["b"],), (["é", "a", "b"] * 5,)]
    df = spark.createDataFrame(docs, "t array<string>").repartition(2)
    plain, totals = {}, {}
    for (t,) in docs:
        for a in range(len(t or [])):
            for b in range(max(0, a - 2), min(len(t), a + 3)):
                if a != b:
                    plain[t[a], t[b]] = plain.get((t[a], t[b]), 0) + 1
                    totals[t[a]] = totals.get(t[a], 0) + 1
    counts = factors.cooccurrences(df, "t", 2)
    assert {(r.x, r.y): r.n for r in counts.collect()} == plain
    assert "Union" not in counts._jdf.queryExecution().optimizedPlan().toString()  # one shuffle, of unordered pairs
    assert {r.x: r.n for r in factors.pair_totals(df, "t", 2).where("n > 0").collect()} == totals
    known = factors.positive_pmi(counts, 3, factors.pair_totals(df, "t", 2))
    assert sorted((r.x, r.y, r.n, round(r.pmi, 9)) for r in known.collect()) == sorted((r.x, r.y, r.n, round(r.pmi, 9)) for r in factors.positive_pmi(counts, 3).collect())


def test_words_are_counted_in_their_rows(spark, monkeypatch):
    docs = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["a", None, "b", None]), (5, ["c"])]
    df = spark.createDataFrame(docs, "doc_id long, w array<string>")
    once = features.word_counts(df, F.col("w"))
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()  # F14, F16: no row a word is shuffled
    assert sorted(map(str, once.collect())) == sorted(map(str, df.select("doc_id", F.explode("w").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).collect()))
    again = spark.createDataFrame(docs + [(1, ["a", "d"]), (None, ["a"]), (None, ["a", "e"])], "doc_id long, w array<string>")
    want = again.select("doc_id", F.explode("w").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, features.word_counts(again, F.col("w")).collect())) == sorted(map(str, want.collect()))
    tokens = again.select("doc_id", F.explode("w").alias("token")).where("token is not null")
    clusters = tokens.select("token").distinct().withColumn("cluster", F.ascii("token") % 4)
    vectors = tokens.select("token").distinct().withColumn("vector", F.array(F.ascii("token").cast("double"), F.lit(1.0)))
    bags, means = [], []
    for most in (2, 100):
        monkeypatch.setattr(features, "BROADCAST_WORDS", most)
        bag = features.bag_of_centroids(tokens, clusters, [0, 1, 2, 3])
        if most == 100:  # frequent words are broadcast
            assert "BroadcastHashJoin" in bag._jdf.queryExecution().executedPlan().toString()
        bags.append(sorted(map(str, bag.collect())))
        means.append(sorted(str((r.doc_id, [round(v, 9) for v in r.vector])) for r in training.mean_word_vectors(features.word_counts(again, F.col("w")), vectors, 5).collect()))
    assert bags[0] == bags[1] and means[0] == means[1] and len(bags[0]) == len(means[0]) == 4
    found, _ = training.weighted_bag(once.where("token is not null"), 5, 1, 1.0, 40)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]  # lengths need no join


def test_nested_folds_are_scored_in_one_query(spark, monkeypatch):
    """Areas of all inner fits come from one query, and the choice is that of fits one by one."""
    import random

    from strandloom.operators import evaluate

    rnd = random.Random(4)
    rows = [(i, i % 2, (i % 2) + rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    grid, calls, auc = [("logistic", 0.0), ("logistic", 50.0)], [], evaluate.auc
    monkeypatch.setattr(evaluate, "auc", lambda *a: calls.append(a[1]) or auc(*a))
    got = selection.nested_cv(df, ["a", "b"], "y", "k", grid, outer=2, inner=2).collect()
    assert len(calls) == 1 and sorted(r.k for r in got) == list(range(120))
    fold = {r.k: r.fold for r in got}
    for o in (0, 1):
        held = [r for r in got if r.fold == o]
        (kind, strength), *more = {(r.kind, r.strength) for r in held}
        assert not more
        from pyspark.ml.feature import VectorAssembler

        x = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(df).withColumn("_y", df["y"].cast("double"))
        rest = x.where(~x["k"].isin([k for k, f in fold.items() if f == o]))
        model = selection.classifier(kind, strength).fit(rest)
        for r in held:
            a, b = rows[r.k][2:]
            assert abs(r.score - (model.intercept + model.coefficients[0] * a + model.coefficients[1] * b)) < 1e-6
