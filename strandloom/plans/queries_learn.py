"""Queries of clusters, factorisations, model selection, curves and code look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import getters
from ..operators import clustering, documents, evaluate, factors, features, pathways, selection, terminology, training
from ..state import written
from .queries_more import HITS, _hits, segment_sequences
from .queries_patterns import SCORED, _edges, _scored
from .registry import register
from .tables import CODE, DX, TOK, diagnoses, table

# Clusters of the parts by size and price: all coordinates, all rows.

POINTS = "p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice / 20 AS y FROM part)"
NEAR = POINTS + ", near AS (SELECT * FROM (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r}) WHERE d <= {r})"
RADIUS, LEAST = 0.3, 5


def points(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 20).alias("x"))


@register("density_clusters", f"""WITH RECURSIVE {NEAR.format(r=RADIUS)}, core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= {LEAST}), e AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
  lab(node, c) USING KEY (node) AS (SELECT k, k FROM core UNION SELECT e.b, min(lab.c) FROM lab JOIN e ON e.a = lab.node JOIN recurring.lab old ON old.node = e.b WHERE lab.c < old.c GROUP BY e.b),
  edge AS (SELECT near.a AS k, arg_min(lab.c, (near.d, near.b)) AS c FROM near JOIN lab ON lab.node = near.b WHERE near.a NOT IN (SELECT k FROM core) GROUP BY 1)
  SELECT p.k, coalesce(lab.c, edge.c) AS cluster, lab.c IS NOT NULL AS core FROM p LEFT JOIN lab ON lab.node = p.k LEFT JOIN edge ON edge.k = p.k""")
def density(spark, sf):
    return clustering.dbscan(points(spark, sf), "k", "x", RADIUS, LEAST, [0, 1])


NEIGHBOURS, REACH, HEIGHT = 5, 1.1, 0.25
GRAPH = NEAR.format(r=REACH) + f", g AS (SELECT a, b, d FROM near WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= {NEIGHBOURS}), s AS (SELECT a, b, d FROM g UNION SELECT b, a, d FROM g)"
JOINED = GRAPH + """, r(q, node, h) USING KEY (q, node) AS (SELECT k, k, 0.0::DOUBLE FROM p WHERE k % 50 = 0 UNION
  SELECT r.q, s.b, min(greatest(r.h, s.d)) FROM r JOIN s ON s.a = r.node LEFT JOIN recurring.r old ON old.q = r.q AND old.node = s.b WHERE old.h IS NULL OR greatest(r.h, s.d) < old.h GROUP BY 1, 2)"""


def linkage(spark, sf):
    return clustering.single_linkage(points(spark, sf), "k", "x", REACH, NEIGHBOURS, [0, 1])


def joined(spark, sf, alone=False):
    """The stated query set, the parts whose key is divisible by 50, against all (or ``alone`` those joined with it): distances and heights."""
    p = points(spark, sf)
    return clustering.cophenetic_of(p, p.where("k % 50 = 0"), "k", "x", linkage(spark, sf)[1], alone)


@register("cophenetic_heights", f"WITH RECURSIVE {JOINED} SELECT q.k AS a, p.k AS b, round(r.h, 6) AS height FROM p q JOIN p ON p.k <> q.k LEFT JOIN r ON r.q = q.k AND r.node = p.k WHERE q.k % 50 = 0")
def heights(spark, sf):
    return joined(spark, sf).select("a", "b", F.round("height", 6).alias("height"))


@register("cophenetic_correlation", f"WITH RECURSIVE {JOINED} SELECT round(corr(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), r.h), 6) AS correlation, count(*) AS n_pairs FROM r JOIN p a ON a.k = r.q JOIN p b ON b.k = r.node WHERE r.q <> r.node")
def correlation(spark, sf):
    return clustering.cophenetic_correlation(joined(spark, sf, True)).select(F.round("correlation", 6).alias("correlation"), "n_pairs")


@register("linkage_clusters", f"WITH RECURSIVE {GRAPH}, lab(node, c) USING KEY (node) AS (SELECT k, k FROM p UNION SELECT s.b, min(lab.c) FROM lab JOIN s ON s.a = lab.node AND s.d <= {HEIGHT} JOIN recurring.lab old ON old.node = s.b WHERE lab.c < old.c GROUP BY s.b) SELECT node AS k, c AS cluster FROM lab")
def linkage_cut(spark, sf):
    return clustering.cut(linkage(spark, sf)[0], points(spark, sf), "k", HEIGHT)


@register("linkage_merges", f"WITH RECURSIVE {GRAPH}, t(w) AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, {REACH}])), lab(w, node, c) USING KEY (w, node) AS (SELECT w, k, k FROM p, t UNION SELECT lab.w, s.b, min(lab.c) FROM lab JOIN s ON s.a = lab.node AND s.d <= lab.w JOIN recurring.lab old ON old.node = s.b AND old.w = lab.w WHERE lab.c < old.c GROUP BY 1, 2) SELECT w::DOUBLE AS height, count(*) - count(DISTINCT c) AS n_merges FROM lab GROUP BY 1")
def merges(spark, sf):
    """Merges up to some heights: rows less clusters."""
    forest = written(linkage(spark, sf)[0], "forest")
    up_to = spark.createDataFrame([(h,) for h in (0.05, 0.1, 0.25, 0.5, REACH)], "height double")
    return up_to.join(forest, F.col("weight") <= F.col("height"), "left").groupBy("height").agg(F.count("weight").alias("n_merges"))


@register("gap_by_k")
def gaps(spark, sf):
    """Gap statistic of k-means over all coordinates: iterative, so no SQL; the tests check it against plain Lloyd steps."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = clustering.gap_statistic(e, "vec_id", "embedding", [1, 2, 3], references=2, steps=6)
    best = clustering.best_k(found)
    return spark.createDataFrame([(r["k"], r["log_w"], r["expected"], r["gap"], r["s"], r["k"] == best) for r in found], "k int, log_w double, expected double, gap double, s double, best boolean")


# Factorisations.


def word_counts(spark, sf):
    """i (document), j (word), value: the words that at least one document in fifty has."""
    docs = table(spark, sf, "documents")
    t = written(features.word_counts(docs, C.words(F.col("text"))), "words")
    n = docs.agg(F.countDistinct("doc_id").alias("n"))  # one row
    often = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df * 50 >= n").select("token")
    often = written(often, "often")  # at most fifty times the words of a mean document, so mostly broadcast
    return t.join(often, "token").select(F.col("doc_id").alias("i"), F.col("token").alias("j"), F.col("n").cast("double").alias("value"))


@register("document_word_coclusters")
def coclusters(spark, sf):
    """Documents and words clustered together by singular vectors: iterative, so no SQL; the tests check values and planted blocks with numpy."""
    return factors.coclusters(word_counts(spark, sf), 4, iterations=12, tolerance=1e-5)


WINDOW = 2
PAIRS = f"d AS (SELECT doc_id, regexp_extract_all(lower(text), '[-0-9a-z_:.]+') AS a FROM documents), o AS (SELECT unnest(list_zip(a[:len(a) - k], a[1 + k:])) AS p FROM d, range(1, {WINDOW + 1}) AS t(k) WHERE len(a) > k), one AS (SELECT p[1] AS x, p[2] AS y, count(*) AS n FROM o GROUP BY 1, 2), c AS (SELECT x, y, sum(n)::BIGINT AS n FROM (SELECT x, y, n FROM one UNION ALL SELECT y, x, n FROM one) GROUP BY 1, 2)"


def word_lists(spark, sf):
    return table(spark, sf, "documents").select(C.words(F.col("text")).alias("tokens"))


def nearby(spark, sf):
    return factors.cooccurrences(word_lists(spark, sf), "tokens", WINDOW)


@register("word_cooccurrences", f"WITH {PAIRS} SELECT x, y, n FROM c WHERE n >= 5")
def word_pairs(spark, sf):
    return nearby(spark, sf).where("n >= 5")


@register("word_pmi", f"WITH {PAIRS}, m AS (SELECT x, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c), z AS (SELECT c.x, c.y, c.n, ln(c.n::DOUBLE * t.n / (a.n::DOUBLE * b.n)) AS pmi FROM c JOIN m a ON a.x = c.x JOIN m b ON b.x = c.y, t WHERE c.n >= 5) SELECT x, y, n, round(pmi, 6) AS pmi FROM z WHERE pmi > 0")
def pmi(spark, sf):
    return factors.positive_pmi(nearby(spark, sf), 5, factors.pair_totals(word_lists(spark, sf), "tokens", WINDOW)).withColumn("pmi", F.round("pmi", 6))


@register("word_vector_similarity")
def similarity(spark, sf):
    """Whether pairs that stand together are more alike than pairs by chance, as an area under the curve: iterative, so no SQL."""
    counts = written(nearby(spark, sf).where("n >= 5"), "nearby")
    vectors = written(factors.word_vectors(factors.positive_pmi(counts), 8, iterations=6, tolerance=1e-4), "vectors")
    real = counts.select("x", "y").where("x < y")
    both = factors.pair_similarities(real, vectors).withColumn("hit", F.lit(1)).unionByName(factors.pair_similarities(factors.shuffled_pairs(real), vectors).withColumn("hit", F.lit(0)))
    return evaluate.auc(both.where("similarity is not null"), [], "hit", "similarity")


# Model selection and curves.

FEATURES = ["size", "words", "digits", "marks", "capitals", "lines", "noise_1", "noise_2"]


def quality_rows(spark, sf):
    """doc_id, quality and features of the labelled documents; two are noise by hash."""
    x = F.col("text")
    n = lambda pattern: F.regexp_count(x, F.lit(pattern)) / F.greatest(F.length(x), F.lit(1))
    noise = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1000)) / 1000.0
    made = [F.ln(1.0 + F.length(x)), n(r"\s+"), n(r"\d"), n(r"[.,;:!?]"), n(r"[A-Z]"), n(r"\n"), noise(1), noise(2)]
    d = table(spark, sf, "documents").select("doc_id", *[c.alias(f) for f, c in zip(FEATURES, made)])
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@register("stable_features")
def stable(spark, sf):
    """How often L1 regressions of hashed subsamples choose each feature: fits, so no SQL; the tests plant features."""
    return spark.createDataFrame(selection.stability(quality_rows(spark, sf), FEATURES, "quality", "doc_id", draws=6), "feature string, frequency double")


@register("nested_cv_predictions")
def nested(spark, sf):
    """Out-of-fold predictions of nested cross-validation: fits, so no SQL; the tests check folds and rows."""
    grid = [("logistic", 0.0), ("logistic", 0.1), ("svm", 0.1)]
    return selection.nested_cv(quality_rows(spark, sf), FEATURES, "quality", "doc_id", grid, outer=3, inner=2)


@register("class_report", f"WITH {SCORED}, k AS (SELECT unnest([0, 1]) AS class), r AS (SELECT class, count(*) FILTER (WHERE quality = class AND guess = class) AS hit, count(*) FILTER (WHERE guess = class) AS said, count(*) FILTER (WHERE quality = class) AS support FROM p, k GROUP BY 1), s AS (SELECT class, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support FROM r) SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, support FROM s")
def class_report(spark, sf):
    x = selection.report(_scored(spark, sf), "quality", "guess")
    return x.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("confusion_matrix", f"WITH {SCORED} SELECT quality, guess, count(*) AS n FROM p GROUP BY 1, 2")
def confusion(spark, sf):
    return selection.confusion_matrix(_scored(spark, sf), "quality", "guess")


ROC = f"{HITS}, n AS (SELECT class, score AS threshold, sum(hit) AS p, sum(1 - hit) AS q FROM x GROUP BY 1, 2), c AS (SELECT class, threshold, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS pos, sum(q) OVER (PARTITION BY class) AS neg FROM n WINDOW w AS (PARTITION BY class ORDER BY threshold DESC)), roc AS (SELECT class, threshold, fp / neg AS fpr, tp / pos AS tpr FROM c WHERE pos > 0 AND neg > 0 UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM c WHERE pos > 0 AND neg > 0)"
GRID = [i / 20 for i in range(21)]
CURVES = ROC + f", e AS (SELECT class, fpr, max(tpr) AS hi, min(tpr) AS lo FROM roc GROUP BY 1, 2), g AS (SELECT DISTINCT class, unnest([{', '.join(f'{i} / 20.0' for i in range(21))}])::DOUBLE AS x FROM roc), m AS (SELECT g.class, g.x, a.fpr AS x0, a.hi AS y0, b.fpr AS x1, b.lo AS y1 FROM g ASOF JOIN e a ON a.class = g.class AND g.x >= a.fpr ASOF LEFT JOIN e b ON b.class = g.class AND g.x < b.fpr), curve AS (SELECT class, x, CASE WHEN x1 IS NULL OR x = x0 THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END AS tpr FROM m)"


def roc(spark, sf):
    return selection.roc_points(_hits(spark, sf), ["class"], "hit", "score")


def curves(spark, sf):
    return selection.on_grid(roc(spark, sf), ["class"], GRID)


@register("roc_curves", f"WITH {ROC} SELECT class, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc")
def roc_curves(spark, sf):
    return roc(spark, sf).select("class", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@register("roc_on_grid", f"WITH {CURVES} SELECT class, round(x, 6) AS x, round(tpr, 9) AS tpr FROM curve")
def roc_on_grid(spark, sf):
    return curves(spark, sf).select("class", F.round("x", 6).alias("x"), F.round("tpr", 9).alias("tpr"))


@register("macro_roc", f"WITH {CURVES}, y AS (SELECT x, avg(tpr) AS tpr FROM curve GROUP BY 1), z AS (SELECT x, tpr, (x - lag(x) OVER (ORDER BY x)) * (tpr + lag(tpr) OVER (ORDER BY x)) / 2 AS a FROM y) SELECT round(sum(a), 9) AS macro FROM z")
def macro(spark, sf):
    """The area under the mean of the classes' interpolated curves."""
    return selection.area(selection.mean_curve(curves(spark, sf)), []).select(F.round("area", 9).alias("macro"))


# Documents, codes and terminologies.


@register("filled_visits", f"WITH {DX}, v AS (SELECT person_id, t, list(code ORDER BY row_id, code) AS c FROM dx GROUP BY 1, 2), f AS (SELECT person_id, t, CASE WHEN len(c) < 5 THEN c || list_transform(range(1, 6 - len(c)), lambda i: c[1 + CAST(CAST('0x' || substr(md5(person_id || ':' || t || ':' || i || ':53'), 1, 8) AS UBIGINT) % len(c) AS BIGINT)]) ELSE c END AS c FROM v) SELECT person_id, t, array_to_string(c, ',') AS codes FROM f")
def filled(spark, sf):
    v = diagnoses(spark, sf).groupBy("person_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "code"))), lambda x: x["code"]).alias("codes"))
    return documents.filled_visits(v, 5, "person_id", "t").select("person_id", "t", F.array_join("codes", ",").alias("codes"))


@register("getter_lookup", f"WITH c AS (SELECT p_partkey, {CODE} AS code FROM part) SELECT p_partkey, value FROM (SELECT p_partkey, unnest(list_transform(range(0, len(code) - len(split_part(code, '.', 1)) + (CASE WHEN contains(code, '.') THEN 0 ELSE 1 END)), lambda i: CASE WHEN i = 0 THEN split_part(code, '.', 1) ELSE left(code, len(split_part(code, '.', 1)) + 1 + i) END)) AS value FROM c)")
def getter_lookup(spark, sf):
    """Each part's code with its root and longer forms, from a getter applied as a table function in a lateral join."""
    return getters.applied(table(spark, sf, "part").select("p_partkey", F.expr(CODE).alias("code")), F.col("code"), "prefixes").select("p_partkey", "value")


@register("json_tree_edges", "SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region")
def json_edges(spark, sf):
    """The hierarchy written as one JSON tree a region, and read back as edges."""
    e = _edges(spark, sf)
    leaf = lambda c, more=None: F.struct(F.col(c).alias("name"), *([F.col(more).alias("children")] if more else []))
    below = lambda kind, of: e.where(F.col("child").startswith(kind)).select("child", F.col("parent").alias(of))
    nations = below("n", "r").join(below("c", "n").groupBy("n").agg(F.collect_list(leaf("child")).alias("below")), F.col("child") == F.col("n"), "left")
    regions = below("r", "top").withColumnRenamed("child", "name").join(nations.groupBy("r").agg(F.collect_list(leaf("child", "below")).alias("below")), F.col("name") == F.col("r"), "left")
    trees = regions.select(F.to_json(F.struct(F.col("top").alias("name"), F.array(leaf("name", "below")).alias("children"))).alias("json"))
    return terminology.json_tree_edges(trees, "json")


@register("sibling_pairs", "SELECT 'n' || a.n_nationkey AS node, 'n' || b.n_nationkey AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey UNION ALL SELECT 'r' || a.r_regionkey, 'r' || b.r_regionkey FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey")
def sibling_pairs(spark, sf):
    return terminology.siblings_of(_edges(spark, sf).where("not child like 'c%'"))


@register("keyword_groups", r"""WITH RECURSIVE w AS (SELECT DISTINCT item_id AS k, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), s AS (SELECT * FROM w WHERE len(w) >= 4), h AS (SELECT w, min(k) AS f FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 3), e AS (SELECT f AS a, k AS b FROM s JOIN h USING (w) UNION SELECT k, f FROM s JOIN h USING (w)),
  lab(node, c) USING KEY (node) AS (SELECT item_id, item_id FROM benchmark UNION SELECT e.b, min(lab.c) FROM lab JOIN e ON e.a = lab.node JOIN recurring.lab old ON old.node = e.b WHERE lab.c < old.c GROUP BY e.b) SELECT node AS item_id, c AS "group" FROM lab""")
def keyword_groups(spark, sf):
    return terminology.keyword_groups(table(spark, sf, "benchmark"), "item_id", "text", 3)


@register("pathway_derivation_many")
def derivation_many(spark, sf):
    """Common subsequences of sets of three customers of a segment, with their frequencies over all: a back-trace, so no SQL; the tests check it against brute force."""
    docs = written(segment_sequences(spark, sf), "sequences")
    return pathways.derive_many(docs, 3, rounds=2, at_least=1, label="label", permutations=False).drop("items")


# Documents to vectors to training tables.

BAG = f"{TOK}, c AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2), t AS (SELECT count(*) AS d FROM documents), v AS (SELECT token, count(*) AS df, row_number() OVER (ORDER BY sum(n) DESC, token) AS i FROM c GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.5 * (SELECT d FROM t) QUALIFY i <= 40), r AS (SELECT doc_id, CAST(i AS INT) AS feature, n * (ln((t.d + 1) / (df + 1)) + 1) AS x FROM c JOIN v USING (token), t), b AS (SELECT doc_id, feature, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS value FROM r)"


def weighted(spark, sf):
    docs = table(spark, sf, "documents")
    return written(features.word_counts(docs, C.words(F.col("text"))), "counts"), docs.count()


@register("weighted_bag_of_words", f"WITH {BAG} SELECT doc_id, feature, round(value, 9) AS value FROM b")
def weighted_bag(spark, sf):
    counts, n = weighted(spark, sf)
    return training.weighted_bag(counts, n, 3, 0.5, 40)[0].select("doc_id", "feature", F.round("value", 9).alias("value"))


@register("document_training_set", f"WITH {BAG} SELECT doc_id AS index, " + ", ".join(f"round(coalesce(max(value) FILTER (WHERE feature = {i + 1}), 0), 9) AS f{i}" for i in range(40)) + ", quality AS target FROM b JOIN labels USING (doc_id) GROUP BY doc_id, quality")
def document_set(spark, sf):
    """Documents, counted, weighted, made vectors and joined with their labels in one run."""
    counts, n = weighted(spark, sf)
    bag, _ = training.weighted_bag(counts, n, 3, 0.5, 40)
    x = training.training_set(training.dense(bag, 40), table(spark, sf, "labels"), "quality", 40)
    return x.select("index", *[F.round(f"f{i}", 9).alias(f"f{i}") for i in range(40)], "target")


@register("mean_word_vectors", f"WITH {TOK}, c AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1), t AS (SELECT count(*) AS d FROM documents), w AS (SELECT doc_id, n * (ln((t.d + 1) / (df + 1)) + 1) AS w, len(token)::DOUBLE AS a, ascii(token)::DOUBLE AS b FROM c JOIN d USING (token), t) SELECT doc_id, round(sum(w * a) / sum(w), 6) AS a, round(sum(w * b) / sum(w), 6) AS b FROM w GROUP BY 1")
def mean_vectors(spark, sf):
    counts, n = weighted(spark, sf)
    vectors = counts.select("token").distinct().select("token", F.array(F.length("token").cast("double"), F.ascii("token").cast("double")).alias("vector"))
    x = training.mean_word_vectors(counts, vectors, n)
    return x.select("doc_id", F.round(F.get("vector", F.lit(0)), 6).alias("a"), F.round(F.get("vector", F.lit(1)), 6).alias("b"))
