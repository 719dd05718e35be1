"""Pattern, feature, label, sampling, evaluation and terminology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import sequences as S
from ..functions import udfs
from ..operators import documents, evaluate, features, labels, patterns, sampling, terminology
from ..state import written
from .registry import register
from .tables import DX, EV, EV_POS, TOK, codes_of, diagnoses, events, table

HEAD = EV_POS + ", p AS (SELECT doc_id, pos, code FROM pos)"
GRAM2 = HEAD + ", g AS (SELECT doc_id, code AS a, lead(code) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM p)"


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(C.words(F.col("text"))).alias("token"))


@register("ngram2_total", f"WITH {GRAM2} SELECT a || ' ' || b AS ngram, count(*) AS n, count(DISTINCT doc_id) AS df FROM g WHERE b IS NOT NULL GROUP BY 1")
def ngram2(spark, sf):
    return patterns.count_ngrams(codes_of(spark, sf), 2, 2).select("ngram", "n", "df")


@register("ngram2_partial", f"WITH {GRAM2} SELECT least(a, b) || ' ' || greatest(a, b) AS ngram, count(*) AS n, count(DISTINCT doc_id) AS df FROM g WHERE b IS NOT NULL GROUP BY 1")
def ngram2_partial(spark, sf):
    return patterns.count_ngrams(codes_of(spark, sf), 2, 2, partial_order=True).select("ngram", "n", "df")


GRAMS = HEAD + ", g AS (SELECT doc_id, code AS a, lead(code) OVER w AS b, lead(code, 2) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), u AS (SELECT doc_id, 1 AS length, a AS ngram FROM g UNION ALL SELECT doc_id, 2, a || ' ' || b FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, 3, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL)"


@register("ngram_top_per_length", f"WITH {GRAMS}, c AS (SELECT length, ngram, count(*) AS n, count(DISTINCT doc_id) AS df FROM u GROUP BY 1, 2) SELECT length, ngram, n, df, row_number() OVER (PARTITION BY length ORDER BY n DESC, ngram) AS rank FROM c QUALIFY rank <= 10")
def ngram_top(spark, sf):
    return patterns.top_per(patterns.count_ngrams(codes_of(spark, sf), 1, 3), ["length"], "n", "ngram", 10)


@register("ngram_given_counts", f"WITH {GRAM2}, w(ngram) AS (VALUES ('click view'), ('view purchase'), ('no such')) SELECT w.ngram, count(g.a) AS n, count(DISTINCT g.doc_id) AS df FROM w LEFT JOIN g ON g.a || ' ' || g.b = w.ngram GROUP BY 1")
def ngram_given(spark, sf):
    wanted = spark.createDataFrame([("click view",), ("view purchase",), ("no such",)], "ngram string")
    return patterns.count_given(codes_of(spark, sf), wanted, 2)


@register("ngram_local_global_ratio", f"WITH {GRAM2}, x AS (SELECT a || ' ' || b AS ngram, doc_id FROM g WHERE b IS NOT NULL) SELECT 2 AS length, ngram, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_local, count(*) AS n_global, round(count(*) FILTER (WHERE doc_id % 5 = 0) / count(*), 9) AS ratio FROM x GROUP BY ngram")
def ngram_ratio(spark, sf):
    docs = codes_of(spark, sf)
    local = patterns.count_ngrams(docs.where("doc_id % 5 = 0"), 2, 2)
    return patterns.compare_counts(local, patterns.count_ngrams(docs, 2, 2)).withColumn("ratio", F.round("ratio", 9))


@register("cluster_ngram_tfidf", f"WITH {GRAM2}, c AS (SELECT doc_id % 4 AS cluster, a || ' ' || b AS ngram, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL), d AS (SELECT ngram, count(DISTINCT cluster) AS df FROM c GROUP BY 1), r AS (SELECT cluster, ngram, n * (ln((SELECT count(DISTINCT cluster) FROM c) / df) + 1) AS raw FROM c JOIN d USING (ngram)) SELECT cluster, ngram, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY cluster)), 6) AS tfidf FROM r")
def cluster_tfidf(spark, sf):
    docs = codes_of(spark, sf).withColumn("cluster", F.col("doc_id") % 4)
    counts = patterns.ngram_rows(docs, 2, 2).groupBy("cluster", "ngram").agg(F.count(F.lit(1)).alias("n"))
    return features.tfidf_l2(counts, "cluster", "ngram", "n").select("cluster", "ngram", F.round("tfidf", 6).alias("tfidf"))


@register("token_idf", f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf, round(log10((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf10 FROM tok GROUP BY 1")
def token_idf(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))  # one row
    df = features.document_frequencies(_tokens(spark, sf)).crossJoin(F.broadcast(n))
    return df.select("token", "df", "tf", F.round(features.idf_smooth(F.col("n"), F.col("df")), 6).alias("idf"), F.round(features.idf_log10(F.col("n"), F.col("df")), 6).alias("idf10"))


@register("topn_per_group", f"WITH {TOK}, c AS (SELECT lang, token, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c QUALIFY rank <= 20")
def topn(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.explode(C.words(F.col("text"))).alias("token"))
    return patterns.top_per(t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")), ["lang"], "n", "token", 20)


PATTERNS = [(1, ["signup", "purchase", "error"]), (2, ["click", "click", "purchase", "purchase"]), (3, ["error", "error", "error", "error", "error", "error", "error", "error", "error", "error"]), (4, ["view"]), (5, ["signup", "error", "signup", "error", "signup", "error", "signup", "error"])]
LIKES = " UNION ALL ".join(f"SELECT doc_id, {i} AS pattern_id, {len(p)} AS len FROM s WHERE s LIKE '%{'%'.join(f',{c},' for c in p)}%'" for i, p in PATTERNS)
FOUND = HEAD + f", s AS (SELECT doc_id, string_agg(',' || code || ',', '' ORDER BY pos) AS s FROM p GROUP BY 1), f AS ({LIKES})"


def _found(spark, sf):
    return patterns.containing(codes_of(spark, sf), spark.createDataFrame(PATTERNS, "pattern_id int, pattern array<string>"))


@register("subsequence_df", f"WITH {FOUND} SELECT pattern_id, count(*) AS df FROM f GROUP BY 1")
def subsequence_df(spark, sf):
    return _found(spark, sf).groupBy("pattern_id").agg(F.countDistinct("doc_id").alias("df"))


@register("pattern_contrast_ratio", f"WITH {FOUND}, c AS (SELECT pattern_id, doc_id % 3 AS label, count(*) AS n FROM f GROUP BY 1, 2) SELECT pattern_id, label, n, round(n / sum(n) OVER (PARTITION BY pattern_id), 9) AS ratio FROM c")
def contrast(spark, sf):
    x = patterns.contrast(_found(spark, sf).withColumn("label", F.col("doc_id") % 3), "label")
    return x.withColumn("ratio", F.round("ratio", 9))


@register("label_by_longest_pattern", f"WITH {FOUND} SELECT doc_id, coalesce((SELECT CAST(arg_min(pattern_id, (100 - len) * 100 + pattern_id) AS VARCHAR) FROM f WHERE f.doc_id = s.doc_id), 'No_Match') AS label FROM s")
def longest(spark, sf):
    found = _found(spark, sf).withColumn("pattern_id", F.col("pattern_id").cast("string"))
    return patterns.longest_pattern(codes_of(spark, sf), found)


@register("label_by_rarest_pattern", f"WITH {FOUND}, d AS (SELECT pattern_id, count(*) AS df FROM f GROUP BY 1) SELECT doc_id, coalesce((SELECT CAST(arg_min(pattern_id, df * 100 + pattern_id) AS VARCHAR) FROM f JOIN d USING (pattern_id) WHERE f.doc_id = s.doc_id), 'No_Match') AS label FROM s")
def rarest(spark, sf):
    found = _found(spark, sf).withColumn("pattern_id", F.col("pattern_id").cast("string"))
    return patterns.rarest_pattern(codes_of(spark, sf), found)


@register("permutation_merge", f"WITH {GRAMS.replace('u AS', 'u0 AS')}, t AS (SELECT DISTINCT doc_id, ngram, string_split(ngram, ' ') AS x FROM u0 WHERE length = 3) SELECT array_to_string(list_sort(x), ' ') AS canonical, count(DISTINCT doc_id) AS df, min(ngram) AS example FROM t GROUP BY 1")
def permutations(spark, sf):
    g = patterns.ngram_rows(codes_of(spark, sf), 3, 3).distinct()
    return patterns.merge_permutations(g.withColumn("x", F.split("ngram", " ")), F.col("x"))


@register("match_positions", f"WITH {HEAD} SELECT doc_id, CAST(count(*) AS INT) AS n_matches, CAST(min(pos) - 1 AS INT) AS first_at FROM p a WHERE code = 'signup' AND EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.code = 'error') GROUP BY 1")
def positions(spark, sf):
    d = codes_of(spark, sf).withColumn("m", S.match_positions(F.array(F.lit("signup"), F.lit("error")), F.col("codes")))
    return d.where(F.size("m") > 0).select("doc_id", F.size("m").alias("n_matches"), F.get(F.get("m", F.lit(0)), F.lit(0)).cast("int").alias("first_at"))


def _neighbours(spark, sf):
    a = codes_of(spark, sf)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("codes").alias("other"))
    return a.join(b, "doc_id")


LCS_SQL = f"""WITH RECURSIVE {HEAD}, d AS (SELECT doc_id, list(code ORDER BY pos) AS c FROM p GROUP BY 1),
  q AS (SELECT a.doc_id, a.c AS x, b.c AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
  cell(doc_id, x, y, i, j, acc, prev) AS (
    SELECT doc_id, x, y, 1, 0, [0], list_transform(range(0, len(y) + 1), lambda z: 0) FROM q
    UNION ALL
    SELECT doc_id, x, y, CASE WHEN j = len(y) THEN i + 1 ELSE i END, CASE WHEN j = len(y) THEN 0 ELSE j + 1 END,
      CASE WHEN j = len(y) THEN [0] ELSE list_append(acc, CASE WHEN x[i] = y[j + 1] THEN prev[j + 1] + 1 ELSE greatest(prev[j + 2], acc[j + 1]) END) END,
      CASE WHEN j = len(y) THEN acc ELSE prev END
    FROM cell WHERE i <= len(x))
  SELECT doc_id, CAST(prev[len(y) + 1] AS INT) AS lcs_length FROM cell WHERE i = len(x) + 1 AND j = 0"""


@register("lcs_pair_length", LCS_SQL)
def lcs_length(spark, sf):
    return _neighbours(spark, sf).select("doc_id", udfs.lcs_length("codes", "other").alias("lcs_length"))


@register("lcs_pair_string")
def lcs_string(spark, sf):
    """The subsequences themselves, of whole sequences, runs collapsed: a back-trace, so no SQL; its length is checked by lcs_pair_length."""
    x = _neighbours(spark, sf).select("doc_id", udfs.lcs("codes", "other").alias("items"))
    return x.select("doc_id", F.array_join("items", " ").alias("lcs"), F.size("items").alias("length"), F.array_join(S.collapse(F.col("items")), " ").alias("collapsed"))


@register("edit_distance", "SELECT a.p_partkey, levenshtein(a.p_brand || a.p_type, b.p_brand || b.p_type)::DOUBLE AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edits(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("s"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("t"))
    return p.join(q, "p_partkey").select("p_partkey", F.levenshtein("s", "t").cast("double").alias("distance"))


@register("vocabulary_index", f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1) SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) AS INT) AS index FROM c QUALIFY index <= 500")
def vocabulary(spark, sf):
    return documents.vocabulary(_tokens(spark, sf), "token", 500)


@register("bag_of_words", f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS i FROM c QUALIFY i <= 100) SELECT doc_id, CAST(i AS INT) AS index, count(*) AS n FROM tok JOIN v USING (token) GROUP BY ALL")
def bag(spark, sf):
    t = written(_tokens(spark, sf).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")), "counts")  # texts are split once
    v = documents.vocabulary(t, "token", 100, "n").select("token", "index")
    return t.join(F.broadcast(v), "token").select("doc_id", "index", "n")  # 100 rows


@register("label_by_top_code", f"WITH {DX}, c AS (SELECT person_id AS doc_id, split_part(code, '.', 1) AS r, count(*) AS n FROM dx WHERE code LIKE '1%' GROUP BY ALL), t AS (SELECT doc_id, r AS label FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, r) = 1) SELECT DISTINCT dx.person_id AS doc_id, coalesce(label, '-1') AS label FROM dx LEFT JOIN t ON t.doc_id = dx.person_id")
def top_code(spark, sf):
    d = diagnoses(spark, sf).withColumnRenamed("person_id", "doc_id")
    return labels.most_frequent(d, C.text_root(F.col("code")), F.col("code").startswith("1"))


@register("relabel_merge_focus", "SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'AUTOMOBILE' ELSE c_mktsegment END AS merged, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN c_mktsegment ELSE 'Others' END AS focused, CAST(c_mktsegment IN ('BUILDING') AS INT) AS target, count(*) AS n FROM customer GROUP BY ALL")
def relabel(spark, sf):
    x = F.col("c_mktsegment")
    return table(spark, sf, "customer").groupBy(labels.merge(x, {"MACHINERY": "AUTOMOBILE"}).alias("merged"), labels.focus(x, ["BUILDING", "AUTOMOBILE"]).alias("focused"), labels.binarize(x, ["BUILDING"]).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@register("phenotype_bits", f"WITH {DX} SELECT person_id AS doc_id, CAST(sum(regexp_matches(code, '^250\\.\\d[13]$')::INT) >= 1 AS INT) AS type1, CAST(sum(regexp_matches(code, '^250\\.\\d[02]$')::INT) >= 1 AS INT) AS type2, CAST(sum(regexp_matches(code, '^648\\.[08]')::INT) >= 1 AS INT) AS gestational, CAST((sum(regexp_matches(code, '^250\\.\\d[13]$')::INT) >= 1)::INT + 2 * (sum(regexp_matches(code, '^250\\.\\d[02]$')::INT) >= 1)::INT + 4 * (sum(regexp_matches(code, '^648\\.[08]')::INT) >= 1)::INT AS INT) AS bits FROM dx GROUP BY 1")
def phenotype(spark, sf):
    c = F.col("code")
    d = diagnoses(spark, sf).withColumnRenamed("person_id", "doc_id")
    return labels.bits(d, {"type1": C.is_type1(c), "type2": C.is_type2(c), "gestational": C.is_gestational(c)})


@register("class_weights", "WITH c AS (SELECT c_mktsegment AS label, count(*) AS n_class FROM customer GROUP BY 1) SELECT label, n_class, round((SELECT sum(n_class) FROM c) / ((SELECT count(*) FROM c) * n_class), 9) AS weight FROM c")
def weights(spark, sf):
    x = labels.class_weights(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label")), "label")
    return x.withColumn("weight", F.round("weight", 9))


MD5 = "md5(CAST(c_custkey AS VARCHAR) || ':53')"


@register("stratified_top_n", f"SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) AS rank FROM customer QUALIFY rank <= 20")
def stratified(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    return sampling.per_class(c, "c_mktsegment", 20, [sampling.hashed(F.col("c_custkey"))])


@register("near_equal_sample", f"WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) AS rank, dense_rank() OVER (ORDER BY c_mktsegment) AS g FROM customer) SELECT c_mktsegment, c_custkey, rank FROM r WHERE rank <= 10 + CASE WHEN g <= 2 THEN 1 ELSE 0 END")
def near_equal(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    return sampling.near_equal(c, "c_mktsegment", 52, 5, [sampling.hashed(F.col("c_custkey"))])


@register("round_robin_sample", f"WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) AS round FROM customer) SELECT * FROM r ORDER BY round, c_mktsegment LIMIT 33")
def round_robin(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    return sampling.round_robin(c, "c_mktsegment", 33, [sampling.hashed(F.col("c_custkey"))])


@register("exact_split", f"WITH r AS (SELECT c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) - 1) / count(*) OVER (PARTITION BY c_mktsegment) AS s FROM customer) SELECT c_mktsegment, CASE WHEN s < 0.8 THEN 0 WHEN s < 0.9 THEN 1 ELSE 2 END AS part, count(*) AS n FROM r GROUP BY ALL")
def exact_split(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    return sampling.split(c, "c_mktsegment", [0.8, 0.1, 0.1], "c_custkey").groupBy("c_mktsegment", "part").agg(F.count(F.lit(1)).alias("n"))


@register("index_interval", f"WITH {EV}, l AS (SELECT code, list_sort(list(value)) AS s, avg(value) AS m, median(value) AS d, stddev_samp(value) AS sd FROM ev WHERE value IS NOT NULL GROUP BY 1) SELECT code, round(m, 6) AS mean, round(d, 6) AS median, round(sd, 6) AS std, s[CAST(floor(len(s) * 0.05) AS INT) + 1] AS low, s[CAST(floor(len(s) * 0.95) AS INT) + 1] AS high FROM l")
def index_interval(spark, sf):
    x = sampling.interval(events(spark, sf).where("value is not null"), ["code"], "value")
    return x.select("code", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "low", "high")


@register("weighted_pick", "WITH r AS (SELECT s_suppkey, sum(s_acctbal + 1000) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) / sum(s_acctbal + 1000) OVER () AS hi, (s_acctbal + 1000) / sum(s_acctbal + 1000) OVER () AS w FROM supplier) SELECT s_suppkey, CAST(point AS DOUBLE) AS point FROM r, (VALUES (0.111), (0.523), (0.907)) AS v(point) WHERE point >= hi - w AND point < hi")
def pick(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000).alias("w"))
    return sampling.weighted_pick(s, "w", "s_suppkey", [0.111, 0.523, 0.907]).select("s_suppkey", "point")


@register("one_per_interval", "WITH n AS (SELECT s_suppkey, ntile(10) OVER (ORDER BY s_acctbal, s_suppkey) AS interval FROM supplier) SELECT s_suppkey, interval FROM n QUALIFY row_number() OVER (PARTITION BY interval ORDER BY md5(CAST(s_suppkey AS VARCHAR) || ':53')) = 1")
def intervals(spark, sf):
    return sampling.one_per_interval(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 10, "s_suppkey").select("s_suppkey", "interval")


@register("cluster_purity", "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), m AS (SELECT label % 4 AS cluster, i, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, label, cluster, round(sum((x - m) * (x - m)), 6) AS d FROM x JOIN m USING (i) GROUP BY ALL), e AS (SELECT label, cluster FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1), n AS (SELECT cluster, label, count(*) AS n FROM e GROUP BY 1, 2) SELECT cluster, CAST(sum(n) AS BIGINT) AS size, arg_min(label, -n * 1000 + label) AS majority, max(n) AS n_majority, round(max(n) / sum(n), 9) AS purity FROM n GROUP BY 1")
def purity(spark, sf):
    """Clusters: every vector with the nearest of four means, by all its coordinates."""
    e = table(spark, sf, "embeddings")
    means = features.cluster_means(e.withColumn("cluster", F.col("label") % 4), "cluster", "embedding")
    return evaluate.purity(features.nearest_mean(e, means, "cluster", "embedding"), "cluster", "label").withColumn("purity", F.round("purity", 9))


SCORED = "p AS (SELECT doc_id, quality, toxic, n_chars % 101 AS score, CAST(n_chars % 101 >= 50 AS INT) AS guess, lang FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") % 101).alias("score"))
    return table(spark, sf, "labels").join(d, "doc_id").withColumn("guess", (F.col("score") >= 50).cast("int"))


@register("confusion_sens_spec", f"WITH {SCORED}, c AS (SELECT sum((quality = 1 AND guess = 1)::INT) AS tp, sum((quality = 0 AND guess = 0)::INT) AS tn, sum((quality = 0 AND guess = 1)::INT) AS fp, sum((quality = 1 AND guess = 0)::INT) AS fn FROM p) SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 9) AS specificity FROM c")
def confusion(spark, sf):
    x = evaluate.confusion(_scored(spark, sf), "quality", "guess")
    return x.withColumn("sensitivity", F.round("sensitivity", 9)).withColumn("specificity", F.round("specificity", 9))


AUC = "sum((CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END))"


@register("auc_rank", f"WITH {SCORED} SELECT count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg, round({AUC} / count(*), 9) AS auc FROM p a JOIN p b ON a.quality = 1 AND b.quality = 0")
def auc(spark, sf):
    return evaluate.auc(_scored(spark, sf), [], "quality", "score").withColumn("auc", F.round("auc", 9))


@register("auc_one_vs_rest", f"WITH {SCORED}, l AS (SELECT DISTINCT lang AS class FROM p) SELECT class, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg, round({AUC} / count(*), 9) AS auc FROM l JOIN p a ON a.lang = class JOIN p b ON b.lang <> class GROUP BY 1")
def auc_ovr(spark, sf):
    s = _scored(spark, sf).withColumn("class", F.explode(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]))).withColumn("hit", (F.col("lang") == F.col("class")).cast("int"))
    return evaluate.auc(s, ["class"], "hit", "score").withColumn("auc", F.round("auc", 9))


RANKS = f"{SCORED}, r AS (SELECT lang, toxic, score, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM p), k AS (SELECT lang, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT lang, count(*) AS c FROM p GROUP BY lang, score) GROUP BY 1), s AS (SELECT lang, sum(toxic) AS n1, sum(1 - toxic) AS n0, sum(r) FILTER (WHERE toxic = 1) AS r1 FROM r GROUP BY 1)"


@register("rank_sum_test", f"WITH {RANKS} SELECT lang, n1, n0, coalesce(r1, 0) - n1 * (n1 + 1) / 2 AS u, round((coalesce(r1, 0) - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / nullif(sqrt(n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 0), 6) AS z FROM s JOIN k USING (lang)")
def rank_sum(spark, sf):
    return evaluate.rank_sum(_scored(spark, sf), ["lang"], "toxic", "score").withColumn("z", F.round("z", 6)).drop("p")


COS = "1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z))))"


@register("knn_cosine", f"WITH d AS (SELECT b.vec_id AS query_id, a.vec_id AS neighbour_id, round({COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d QUALIFY rank <= 10")
def knn(spark, sf):
    e = table(spark, sf, "embeddings")
    return features.nearest_to(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@register("density_grid", "SELECT x, round(avg(exp(-0.5 * pow((s_acctbal - x) / 500, 2)) / (500::DOUBLE * 2.5066282746310002::DOUBLE)), 9) AS density FROM supplier, (VALUES (0.0), (2500.0), (5000.0), (7500.0)) AS g(x0), (SELECT CAST(x0 AS DOUBLE) AS x) GROUP BY x")
def density(spark, sf):
    return features.density(table(spark, sf, "supplier"), "s_acctbal", [0.0, 2500.0, 5000.0, 7500.0], 500.0).withColumn("density", F.round("density", 9))


@register("min_max_scaled", "SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 9) AS s_acctbal_scaled FROM supplier")
def min_max(spark, sf):
    x = features.min_max(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")
    return x.select("s_suppkey", F.round("s_acctbal_scaled", 9).alias("s_acctbal_scaled"))


EDGES = "edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


def _edges(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    b = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    return a.union(b).union(table(spark, sf, "region").select(name("r", "r_regionkey").alias("child"), F.lit("root").alias("parent")))


UP = f"WITH RECURSIVE {EDGES}, nodes AS (SELECT child AS n FROM edges UNION SELECT parent FROM edges), up(node, ancestor, depth) AS (SELECT n, n, 0 FROM nodes UNION ALL SELECT node, parent, depth + 1 FROM up JOIN edges ON ancestor = child)"


@register("hierarchy_closure", UP + " SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2")
def closure(spark, sf):
    return terminology.closure(_edges(spark, sf))


@register("hierarchy_leaves", UP + " SELECT ancestor AS node, count(*) AS n_leaves FROM up WHERE node NOT IN (SELECT parent FROM edges) GROUP BY 1")
def leaves(spark, sf):
    e = _edges(spark, sf)
    return terminology.leaves(terminology.closure(e), e).groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves"))


@register("hierarchy_siblings", f"WITH {EDGES} SELECT child AS node, count(*) OVER (PARTITION BY parent) - 1 AS n_siblings FROM edges")
def siblings(spark, sf):
    return terminology.siblings(_edges(spark, sf))


@register("hierarchy_descendants", UP + " SELECT DISTINCT node FROM up WHERE ancestor IN ('r1', 'n3')")
def descendants(spark, sf):
    return terminology.descendants(terminology.closure(_edges(spark, sf)), spark.createDataFrame([("r1",), ("n3",)], "node string"))


@register("class_propagation", f"WITH {EDGES}, s AS (SELECT 'r' || r_regionkey AS node, r_name AS class FROM region WHERE r_regionkey < 3), n1 AS (SELECT child AS node, class FROM edges JOIN s ON parent = node), n2 AS (SELECT child AS node, class FROM edges JOIN n1 ON parent = node) SELECT node, class, 0 AS level FROM s UNION ALL SELECT node, class, 1 FROM n1 UNION ALL SELECT node, class, 2 FROM n2")
def propagate(spark, sf):
    seed = table(spark, sf, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("class"))
    return terminology.propagate(seed, _edges(spark, sf).select(F.col("parent").alias("src"), F.col("child").alias("dst")), 2)


@register("preferred_name", "SELECT p_size AS concept, arg_min(p_name, CASE p_brand WHEN 'Brand#11' THEN '1' WHEN 'Brand#22' THEN '2' ELSE '3' END || p_name) AS name, len(list(DISTINCT p_brand)) AS n_kinds FROM part GROUP BY 1")
def preferred(spark, sf):
    x = terminology.preferred(table(spark, sf, "part"), "p_size", "p_brand", "p_name", ["Brand#11", "Brand#22"])
    return x.select(F.col("p_size").alias("concept"), "name", F.size("kinds").cast("long").alias("n_kinds"))


@register("closest_names", "SELECT DISTINCT p_type, levenshtein(lower(p_type), 'large brass') AS distance FROM part ORDER BY distance, p_type LIMIT 10")
def closest(spark, sf):
    return terminology.closest_names(table(spark, sf, "part").select("p_type").distinct(), "p_type", "Large Brass")


@register("most_frequent_target", "WITH n AS (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_size, p_brand FROM n QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, p_brand) = 1")
def frequent_target(spark, sf):
    return terminology.most_frequent_target(table(spark, sf, "part"), "p_size", "p_brand")
