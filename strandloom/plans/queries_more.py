"""Queries of codes, terminologies, pathways, document pipelines, training tables and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import predicates as P
from ..functions import sequences as S
from ..operators import cohort, documents, evaluate, features, frames, labels, pathways, patterns, sampling, terminology
from ..state import written
from .queries_patterns import MD5, SCORED, _edges, _scored
from .registry import register
from .tables import CODED, DX, EV_POS, TOK, coded_parts, codes_of, diagnoses, events, table

# Codes.

PAIR = "p AS (SELECT a.p_partkey AS k, lpad(CAST((a.p_partkey * 7) % 90 AS VARCHAR), CAST(2 + a.p_partkey % 2 AS INT), '0') || '.' || (a.p_partkey % 3) AS a, lpad(CAST((b.p_partkey * 11) % 90 AS VARCHAR), CAST(2 + b.p_partkey % 2 AS INT), '0') || '.' || (b.p_partkey % 3) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 2)"
NUM = "TRY_CAST(split_part({0}, '.', 1) AS DOUBLE)"


@register("code_comparisons", f"WITH {PAIR} SELECT k, {NUM.format('a')} = {NUM.format('b')} AS same_number, split_part(a, '.', 1) = split_part(b, '.', 1) AS same_root, lower(trim(a)) = lower(trim(b)) AS same_text, len(split_part(a, '.', 1)) = len(split_part(b, '.', 1)) AND {NUM.format('a')} > {NUM.format('b')} AS greater, len(split_part(a, '.', 1)) = len(split_part(b, '.', 1)) AND {NUM.format('a')} < {NUM.format('b')} AS less FROM p")
def comparisons(spark, sf):
    code = lambda m: F.concat(F.lpad(((F.col("p_partkey") * m) % 90).cast("string"), (F.col("p_partkey") % 2 + 2).cast("int"), F.lit("0")), F.lit("."), (F.col("p_partkey") % 3).cast("string"))
    p = table(spark, sf, "part")
    a, b = p.select(F.col("p_partkey").alias("k"), code(7).alias("a")), p.select((F.col("p_partkey") - 2).alias("k"), code(11).alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, "k").select("k", C.same_number(x, y).alias("same_number"), C.same_root(x, y).alias("same_root"), C.same_text(x, y).alias("same_text"), C.greater(x, y).alias("greater"), C.less(x, y).alias("less"))


IS9, IS10 = r"regexp_matches(code, '^(V\d{2}(\.\d{1,2})?|\d{3}(\.\d{1,2})?|E\d{3}(\.\d)?)$')", r"regexp_matches(code, '(?i)^[A-TV-Z][0-9][A-Z0-9](\.\w{1,4}\b)?')"
ISMED = r"regexp_matches(upper(code), '^(MULTUM|NDC|MED):\d{2,12}')"


@register("code_kinds", rf"""WITH {CODED} SELECT code, {IS9} OR {IS10} AS icd, NOT contains(code, '.') AND regexp_matches(code, '^(V\d{{2}}|\d{{3}}|E\d{{3}})$') AS icd9_base, NOT contains(code, '.') AND {IS10} AS icd10_base,
  {ISMED} OR regexp_matches(code, '^\d+$') AS source_value, regexp_matches(code, '^250\.\d[13]$') AS type1, regexp_matches(code, '^250\.\d[02]$') AS type2, regexp_matches(code, '^648\.[08]') AS gestational, left(code, 3) IN ('249', '250', '648') AS diabetes,
  CASE WHEN {IS9} OR {IS10} THEN 'diag' WHEN {ISMED} THEN 'drug' WHEN regexp_matches(code, '^\d+$') THEN 'lab' ELSE 'other' END AS token_class, CASE WHEN {ISMED} THEN lower(split_part(code, ':', 1)) ELSE 'unknown' END AS drug_class FROM c""")
def kinds(spark, sf):
    x = F.col("code")
    return coded_parts(spark, sf).select("code", C.is_icd(x).alias("icd"), C.is_icd9_base(x).alias("icd9_base"), C.is_icd10_base(x).alias("icd10_base"), C.is_source_value(x).alias("source_value"), C.is_type1(x).alias("type1"), C.is_type2(x).alias("type2"), C.is_gestational(x).alias("gestational"), C.is_diabetes(x).alias("diabetes"), C.token_class(x).alias("token_class"), C.drug_class(x).alias("drug_class"))


@register("code_spellings", r"""WITH """ + CODED + r""" SELECT code, CASE WHEN contains(code, '.') OR len(code) <= 3 THEN code ELSE left(code, 3) || '.' || substr(code, 4) END AS dotted, regexp_replace(code, '^I(10|9):', '') AS bare, regexp_replace(code, '\.$', '') AS no_dot,
  CASE WHEN contains(code, ':') THEN regexp_extract(code, '([^:]*)$', 1) ELSE code END AS after_prefix,
  array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(code, '[^A-Za-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '_') AS condensed,
  regexp_matches(code, '^[A-Za-z0-9]+\s+[A-Za-z0-9]+(\s.*)?$') AS description, regexp_matches(code, '(?i)re') AND regexp_matches(code, '(?i)f') AS soft FROM c""")
def spellings(spark, sf):
    x = F.col("code")
    return coded_parts(spark, sf).select("code", C.dotted(x).alias("dotted"), C.strip_diagnosis_prefix(x).alias("bare"), C.drop_trailing_dot(x).alias("no_dot"), C.after_prefix(x).alias("after_prefix"), C.condense(x).alias("condensed"), C.is_description(x).alias("description"), C.all_match(x, ["re", "f"]).alias("soft"))


@register("code_is_a", f"WITH {DX}, x AS (SELECT DISTINCT code FROM dx) SELECT code, split_part(code, '.', 1) = '105' AS loose, starts_with(code, '105.1') AS strict, starts_with(code, '10') AND starts_with(code, '10') AS prefixed, CAST(len(list_filter(['105.1', '105.9', '210.1'], lambda c: split_part(c, '.', 1) = split_part(code, '.', 1))) AS INT) AS n_matching FROM x")
def is_a(spark, sf):
    x = F.col("code")
    d = diagnoses(spark, sf).select("code").distinct()
    candidates = F.array(*[F.lit(c) for c in ("105.1", "105.9", "210.1")])
    return d.select("code", C.is_a(x, F.lit("105.1")).alias("loose"), C.is_a(x, F.lit("105.1"), strict=True).alias("strict"), P.starts_with_any(x, ["10", "10"]).alias("prefixed"), F.size(C.matching(x, candidates)).alias("n_matching"))


@register("sequence_predicates", f"""WITH {DX}, s AS (SELECT person_id, list(code) AS c FROM dx GROUP BY 1) SELECT person_id, len(list_intersect(c, ['105.1', '210.2', '315.3', '007.1'])) >= 1 AS any_of, len(list_intersect(c, ['105.1', '210.2', '315.3', '007.1'])) >= 2 AS two_of, list_has_all(c, ['007.1', '014.1']) AS all_of, len(list_filter(c, lambda x: starts_with(x, '1'))) >= 8 AS by_prefix,
  len(list_filter(c, lambda x: starts_with(x, '585') OR starts_with(x, '584') OR starts_with(x, '403') OR starts_with(x, '404'))) > 0 AS in_book, len(list_filter(c, lambda x: starts_with(x, '585'))) > 0 AS registered, len(list_filter(c, lambda x: x IN ('105.1', '210.2'))) AS n_in, len(list_filter(c, lambda x: x NOT IN ('105.1', '210.2'))) AS n_out FROM s""")
def sequence_predicates(spark, sf):
    c, four = F.col("codes"), ["105.1", "210.2", "315.3", "007.1"]
    d = diagnoses(spark, sf).groupBy("person_id").agg(F.collect_list("code").alias("codes"))
    n = lambda p: F.size(F.filter(c, p)).cast("long")
    return d.select("person_id", P.is_case(c, four).alias("any_of"), P.has_code(c, four, 2).alias("two_of"), P.is_case(c, ["007.1", "014.1"], logic="all").alias("all_of"), P.is_case(c, prefix="1", threshold=8).alias("by_prefix"), F.exists(c, lambda x: C.in_code_book(x, "CKD")).alias("in_book"), F.exists(c, P.disease("ckd")).alias("registered"), n(lambda x: P.in_codes(x, four[:2])).alias("n_in"), n(lambda x: P.in_codes(x, four[:2], negate=True)).alias("n_out"))


@register("code_constraints", f"WITH {DX} SELECT count(*) FILTER (WHERE code IN ('105.1', '210.2')) AS exact, count(*) FILTER (WHERE starts_with(code, '105') OR starts_with(code, '210')) AS base FROM dx")
def constraints(spark, sf):
    n = lambda codes: F.count(F.when(P.code_constraint(F.col("code"), codes), 1))
    return diagnoses(spark, sf).agg(n(["105.1", "210.2"]).alias("exact"), n(["105", "210.2"]).alias("base"))


# Cohorts.


@register("person_code_sets", f"WITH {DX} SELECT person_id, md5(array_to_string(list_sort(list_distinct(list(code))), ',')) AS codes_md5, array_to_string(list_sort(list_distinct(list(split_part(code, '.', 1)))), ',') AS roots FROM dx GROUP BY 1")
def person_codes(spark, sf):
    x = cohort.person_codes(diagnoses(spark, sf), F.col("code"), C.text_root(F.col("code")))
    return x.select("person_id", F.md5(F.array_join("codes", ",")).alias("codes_md5"), F.array_join("roots", ",").alias("roots"))


@register("root_tables", f"WITH {DX} SELECT split_part(code, '.', 1) AS root, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM dx GROUP BY 1")
def root_tables(spark, sf):
    return cohort.root_table(diagnoses(spark, sf), F.col("code"), C.text_root(F.col("code"))).select("root", F.array_join("codes", ",").alias("codes"))


@register("unused_roots", f"WITH {DX} SELECT DISTINCT lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS root FROM part EXCEPT SELECT split_part(code, '.', 1) FROM dx")
def unused(spark, sf):
    scope = table(spark, sf, "part").select(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0").alias("root"))
    used = diagnoses(spark, sf).select(C.text_root(F.col("code")).alias("root"))
    return cohort.unused_roots(scope, used)


@register("least_common_codes", f"WITH {DX} SELECT code, count(*) AS n FROM dx GROUP BY 1 ORDER BY n, code LIMIT 15")
def least(spark, sf):
    return cohort.least_common(diagnoses(spark, sf), F.col("code"), 15)


@register("id_consistency", "SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_both, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_left_only, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_right_only")
def consistency(spark, sf):
    return cohort.id_report(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@register("concept_map", "SELECT DISTINCT p_type AS source_value, p_brand AS internal_code FROM part UNION SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def concepts(spark, sf):
    return cohort.concept_map((table(spark, sf, "part"), "p_type", "p_brand"), (table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"))


@register("lab_descriptions", "SELECT p_size AS code, count(*) AS n, coalesce(n_name, 'unknown') AS description FROM part LEFT JOIN nation ON n_nationkey = p_size GROUP BY 1, 3")
def lab_descriptions(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"))
    counts = table(spark, sf, "part").groupBy(F.col("p_size").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return terminology.described(counts, "code", [names]).select("code", "n", "description")


@register("stratum_lists", "SELECT c_mktsegment, c_nationkey % 3 AS area, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 3 ORDER BY c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey % 3) AS n FROM customer")
def strata(spark, sf):
    return labels.index_by(table(spark, sf, "customer").withColumn("area", F.col("c_nationkey") % 3), ["c_mktsegment", "area"], "c_custkey")


# Terminologies.

EDGES = "edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


def _nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@register("hierarchy_parents", f"WITH {EDGES} SELECT child AS node, parent FROM edges WHERE child IN ('c1', 'c2', 'n3', 'r1', 'root')")
def direct_parents(spark, sf):
    return terminology.parents(_edges(spark, sf), _nodes(spark, "c1", "c2", "n3", "r1", "root"))


@register("hierarchy_children", f"WITH {EDGES} SELECT parent AS node, child FROM edges WHERE parent IN ('n3', 'r1', 'c1')")
def direct_children(spark, sf):
    return terminology.children(_edges(spark, sf), _nodes(spark, "n3", "r1", "c1"))


@register("hierarchy_within_set", f"WITH {EDGES}, s AS (SELECT child AS x FROM edges WHERE child LIKE 'n%' UNION SELECT 'r0' UNION SELECT 'r1' UNION SELECT 'c5') SELECT child, parent FROM edges WHERE child IN (SELECT x FROM s) AND parent IN (SELECT x FROM s)")
def within(spark, sf):
    e = _edges(spark, sf)
    nodes = e.where(F.col("child").startswith("n")).select(F.col("child").alias("node")).union(_nodes(spark, "r0", "r1", "c5"))
    return terminology.within_set(e, nodes).select("child", "parent")


@register("hierarchy_code_set", f"WITH {EDGES} SELECT child AS node FROM edges UNION SELECT parent FROM edges")
def code_set(spark, sf):
    return terminology.code_set(_edges(spark, sf))


@register("hierarchy_layers", f"WITH {EDGES} SELECT 'root' AS node, 0 AS layer UNION ALL SELECT child, CASE left(child, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 ELSE 3 END FROM edges")
def layers(spark, sf):
    return terminology.layers(_edges(spark, sf)).select("node", F.col("layer").cast("int").alias("layer"))


@register("hierarchy_linearized", f"WITH {EDGES}, l AS (SELECT 'root' AS node, 0 AS layer UNION ALL SELECT child, CASE left(child, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 ELSE 3 END FROM edges) SELECT row_number() OVER (ORDER BY layer, node) - 1 AS place, regexp_replace(node, '[0-9]+$', '') AS node FROM l")
def linearized(spark, sf):
    return terminology.linearized(terminology.layers(_edges(spark, sf)), r"\d+$")


RELATIONS = "rel AS (SELECT 'p' || l_partkey AS source, CASE l_returnflag WHEN 'A' THEN 'has' ELSE 'is' END AS relation, 's' || l_suppkey AS target FROM lineitem)"


@register("related_concepts", f"WITH {RELATIONS} SELECT DISTINCT source, relation, target FROM rel WHERE source = 'p7' AND relation = 'has'")
def related(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.when(F.col("l_returnflag") == "A", "has").otherwise("is").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"))
    return terminology.related(li, "p7", "has").distinct()


@register("description_cascade", "SELECT DISTINCT p_size AS code, coalesce(n_name, CASE WHEN p_size <= 30 THEN 'part size ' || p_size END, 'none') AS description FROM part LEFT JOIN nation ON n_nationkey = p_size")
def cascade(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("description"))
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("code")).distinct()
    second = sizes.where("code <= 30").select("code", F.concat(F.lit("part size "), F.col("code").cast("string")).alias("description"))
    return terminology.described(sizes, "code", [names, second], "none")


@register("codes_by_description", "SELECT DISTINCT p_size AS code FROM part WHERE regexp_matches(p_type, '(?i)^econ')")
def by_description(spark, sf):
    return terminology.codes_described(table(spark, sf, "part").select(F.col("p_size").alias("code"), F.col("p_type").alias("description")), "^econ")


@register("concept_for_name", "WITH h AS (SELECT CASE WHEN starts_with(lower(p_type), 'small brass shiny') THEN 0 WHEN contains(lower(p_type), 'small brass shiny') THEN 1 WHEN starts_with(lower(p_type), 'small brass') THEN 2 WHEN contains(lower(p_type), 'small brass') THEN 3 WHEN starts_with(lower(p_type), 'small') THEN 4 WHEN contains(lower(p_type), 'small') THEN 5 END AS t, p_size FROM part) SELECT CAST(p_size AS VARCHAR) AS concept, count(*) AS n, t AS tries FROM h WHERE t IS NOT NULL GROUP BY 1, 3 ORDER BY t, n DESC, concept LIMIT 1")
def for_name(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("concept"), F.col("p_type").alias("name"), F.lit("x").alias("kind"))
    return terminology.concept_for_name(names, "Small Brass shiny")


@register("values_of_concept", "SELECT DISTINCT p_brand FROM part WHERE p_size = 7")
def of_concept(spark, sf):
    return terminology.distinct_values_of(table(spark, sf, "part"), "p_size", "p_brand", 7)


@register("split_classes", "SELECT DISTINCT p_size, unnest(string_split(p_type, ' ')) AS class FROM part")
def classes(spark, sf):
    return terminology.split_classes(table(spark, sf, "part").select("p_size", "p_type"), "p_size", "p_type", " ")


@register("names_of_concept", "SELECT CAST(p_size AS VARCHAR) AS concept, p_name AS name, p_brand AS source, p_type AS kind, true AS negated FROM part WHERE p_size = 7")
def concept_names(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("concept"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("kind"))
    return terminology.names_of(names, "-7@x")


@register("drug_class_names", "SELECT DISTINCT p_type, trim(regexp_replace(lower(regexp_replace('[AB12] ' || p_type || '  [C]', '\\[[^\\]]*\\]', ' ', 'g')), '\\s+', ' ', 'g')) AS name FROM part")
def class_names(spark, sf):
    return table(spark, sf, "part").select("p_type", C.class_name(F.concat(F.lit("[AB12] "), F.col("p_type"), F.lit("  [C]"))).alias("name")).distinct()


# Pathways.

TWO = [(1, ["signup", "error"]), (2, ["click", "purchase"]), (3, ["view", "view"]), (4, ["purchase", "nothing"])]
TF = f"{EV_POS}, k(pattern_id, x, y) AS (VALUES (1, 'signup', 'error'), (2, 'click', 'purchase'), (3, 'view', 'view'), (4, 'purchase', 'nothing')), f AS (SELECT a.doc_id, pattern_id, count(*) AS tf FROM pos a JOIN k ON a.code = x WHERE EXISTS (SELECT 1 FROM pos b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.code = y) GROUP BY 1, 2), df AS (SELECT pattern_id, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT user_id) AS n FROM events)"


def _occurrences(spark, sf):
    docs = codes_of(spark, sf)
    return docs, pathways.occurrences(docs, spark.createDataFrame(TWO, "pattern_id int, pattern array<string>"))


@register("pathway_tfidf", f"WITH {TF} SELECT doc_id, pattern_id, CAST(tf AS INT) AS tf, round(tf * (ln((1 + n) / (1 + df)) + 1), 6) AS tfidf FROM f JOIN df USING (pattern_id), n")
def pathway_tfidf(spark, sf):
    docs, found = _occurrences(spark, sf)
    return pathways.tfidf(found, docs.count()).select("doc_id", "pattern_id", "tf", F.round("tfidf", 6).alias("tfidf"))


@register("pathway_ranked", f"WITH {TF} SELECT pattern_id, sum(tf)::BIGINT AS tf, df, round(sum(tf) * (ln((1 + n) / (1 + df)) + 1), 6) AS score FROM f JOIN df USING (pattern_id), n GROUP BY pattern_id, df, n ORDER BY score DESC, pattern_id LIMIT 2")
def pathway_ranked(spark, sf):
    docs, found = _occurrences(spark, sf)
    return pathways.ranked(found, docs.count(), 2).withColumn("score", F.round("score", 6))


TRIPLES = f"{EV_POS}, g AS (SELECT doc_id, code || ' ' || lead(code) OVER w || ' ' || lead(code, 2) OVER w AS lcs FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), t AS (SELECT lcs, count(*) AS n, count(DISTINCT doc_id) AS df FROM g WHERE lcs IS NOT NULL GROUP BY 1)"


def _triples(spark, sf):
    return patterns.count_ngrams(codes_of(spark, sf), 3, 3).select(F.col("ngram").alias("lcs"), "n", "df")


@register("pathways_by_df", f"WITH {TRIPLES} SELECT * FROM t WHERE df >= 3 ORDER BY df DESC, lcs LIMIT 20")
def by_df(spark, sf):
    return pathways.by_df(_triples(spark, sf), 20, 3)


@register("pathways_rare", f"WITH {TRIPLES} SELECT * FROM t ORDER BY n, df, lcs LIMIT 20")
def rare(spark, sf):
    return pathways.select_set(_triples(spark, sf), 20, "rare", ["n", "df"])


@register("pathways_enriched", f"WITH {TRIPLES} SELECT * FROM t ORDER BY n DESC, df DESC, lcs LIMIT 20")
def enriched(spark, sf):
    return pathways.select_set(_triples(spark, sf), 20, "enriched", ["n", "df"])


@register("pathway_set_keys", f"WITH {TRIPLES} SELECT array_to_string(list_sort(list_distinct(string_split(lcs, ' '))), ' ') AS key, count(*) AS n_patterns, sum(n)::BIGINT AS n FROM t GROUP BY 1")
def set_keys(spark, sf):
    return _triples(spark, sf).groupBy(pathways.set_key(F.split("lcs", " ")).alias("key")).agg(F.count(F.lit(1)).alias("n_patterns"), F.sum("n").alias("n"))


PAIRS = f"{EV_POS}, s AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY 1), o AS (SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM s)"


@register("pathway_pairs", f"WITH {PAIRS} SELECT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b, CAST(a.n + b.n AS INT) AS size FROM o a JOIN o b ON b.r BETWEEN a.r + 1 AND a.r + 3")
def pair_sample(spark, sf):
    return pathways.pairs(codes_of(spark, sf), 3, "longest").select("a", "b", (F.size("codes_a") + F.size("codes_b")).alias("size"))


def segment_sequences(spark, sf):
    """doc_id, codes (roots in order) and label of every customer."""
    rows = diagnoses(spark, sf).groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("t", "row_id", "code"))).alias("e"))
    of = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("label"))
    return rows.join(of, "person_id").select(F.col("person_id").alias("doc_id"), F.transform("e", lambda x: C.text_root(x["code"])).alias("codes"), "label")


@register("pathway_derivation")
def derivation(spark, sf):
    """Common subsequences of each customer with the next two of the same segment, with their frequencies over all customers: a back-trace, so no SQL; the tests check it against plain Python."""
    docs = written(segment_sequences(spark, sf), "sequences")
    return pathways.derive(docs, docs, 2, at_least=2, min_df=1, label="label", permutations=False).drop("items")


GRAMS2 = f"{EV_POS}, g AS (SELECT doc_id, doc_id % 4 AS cluster, code || ' ' || lead(code) OVER (PARTITION BY doc_id ORDER BY pos) AS ngram FROM pos), c AS (SELECT cluster, ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1, 2), top AS (SELECT cluster, ngram FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, ngram) <= 3)"


def _grams2(spark, sf):
    docs = codes_of(spark, sf).withColumn("cluster", F.col("doc_id") % 4)
    return patterns.ngram_rows(docs, 2, 2)


@register("members_with_popular", f"WITH {GRAMS2} SELECT cluster, doc_id, count(DISTINCT ngram) AS n_popular FROM g JOIN top USING (cluster, ngram) GROUP BY 1, 2 HAVING count(DISTINCT ngram) >= 2")
def members_with(spark, sf):
    rows = _grams2(spark, sf)
    top = patterns.top_per(rows.groupBy("cluster", "ngram").agg(F.count(F.lit(1)).alias("n")), ["cluster"], "n", "ngram", 3)
    return pathways.members_with(rows, top, "cluster", "doc_id", at_least=2)


@register("cluster_ngram_recall", f"WITH {GRAMS2} SELECT cluster, count(DISTINCT ngram) AS n, (SELECT count(DISTINCT ngram) FROM c) AS n_all, round(count(DISTINCT ngram) / (SELECT count(DISTINCT ngram) FROM c), 9) AS recall FROM c GROUP BY 1")
def ngram_recall(spark, sf):
    rows = _grams2(spark, sf)
    return pathways.recall(rows, rows, "cluster").withColumn("recall", F.round("recall", 9))


@register("lcs_pair_hamming", f"WITH {EV_POS}, s AS (SELECT doc_id, list(code ORDER BY pos) AS c FROM pos GROUP BY 1), q AS (SELECT a.doc_id, a.c AS a, b.c AS b FROM s a JOIN s b ON b.doc_id = a.doc_id + 1) SELECT doc_id, CAST(greatest(len(a), len(b)) - len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) AS INT) AS hamming, CAST(len(list_filter(range(1, len(a) + 1), lambda i: i = 1 OR a[i] <> a[i - 1])) AS INT) AS n_runs FROM q")
def hamming(spark, sf):
    a = codes_of(spark, sf)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("codes").alias("other"))
    return a.join(b, "doc_id").select("doc_id", S.hamming(F.col("codes"), F.col("other")).alias("hamming"), F.size(S.collapse(F.col("codes"))).alias("n_runs"))


# Document pipelines.


@register("codified_symbols", "WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type || ' many words' WHEN 2 THEN '  ' ELSE 'click now' END AS raw FROM events) SELECT event_id, CASE WHEN trim(raw) = '' THEN 'empty' WHEN raw = 'click now' THEN 'C1' WHEN raw = 'view' THEN 'V1' WHEN contains(raw, ' ') THEN 'unknown' ELSE raw END AS code FROM e")
def codified(spark, sf):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, ' many words') WHEN 2 THEN '  ' ELSE 'click now' END")
    mapping = spark.createDataFrame([("click now", "C1"), ("view", "V1"), ("view", "V2")], "source_value string, internal_code string")
    return documents.codified(table(spark, sf, "events").select("event_id", raw.alias("code")), mapping).select("event_id", "code")


@register("codified_visits", f"WITH {DX} SELECT person_id, t, split_part(code, '.', 1) AS code, min(row_id) AS row_id FROM dx GROUP BY 1, 2, 3")
def codified_visits(spark, sf):
    d = diagnoses(spark, sf).withColumn("code", C.text_root(F.col("code")))
    none = spark.createDataFrame([], "source_value string, internal_code string")
    return documents.codified(d, none, ["person_id", "t"], ["row_id"]).select("person_id", "t", "code", "row_id")


PROCESSED = f"{DX}, d AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY t, row_id, code) AS pos FROM dx WHERE code >= '100'), h AS (SELECT person_id, min(pos) AS hit FROM d WHERE code LIKE '5%' GROUP BY 1), k AS (SELECT d.*, c_mktsegment AS label FROM d LEFT JOIN h USING (person_id) JOIN customer ON c_custkey = person_id WHERE hit IS NULL OR pos <= hit)"


def _processed(spark, sf):
    segment = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("label"))
    steps = [{"how": "filter", "p": lambda c: c >= "100"}, {"how": "cut", "p": lambda c: c.startswith("5"), "policy": "prior"}, {"how": "simplify", "p": C.text_root}]
    rows = diagnoses(spark, sf).select("person_id", "t", "row_id", "code")
    return documents.process(rows, ["t", "row_id"], steps, segment, "min", 3, "person_id")


@register("processed_documents", f"WITH {PROCESSED} SELECT person_id, label, string_agg(split_part(code, '.', 1), ',' ORDER BY pos) AS codes FROM k GROUP BY 1, 2 HAVING count(*) >= 3")
def processed(spark, sf):
    return _processed(spark, sf).select("person_id", "label", F.array_join(F.transform("events", lambda e: e["code"]), ",").alias("codes"))


@register("stratified_documents", f"WITH {PROCESSED}, p AS (SELECT person_id, label, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) >= 3) SELECT label, count(*) AS n_docs, sum(n)::BIGINT AS n_codes FROM p GROUP BY 1")
def stratified(spark, sf):
    return _processed(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("events")).alias("n_codes"))


VISITS = f"{DX}, v AS (SELECT person_id, t, count(*)::DOUBLE AS a, count(DISTINCT split_part(code, '.', 1))::DOUBLE AS b, row_number() OVER (PARTITION BY person_id ORDER BY t DESC) AS back FROM dx GROUP BY 1, 2), w AS (SELECT person_id, " + ", ".join(f"coalesce(max({c}) FILTER (WHERE back = {i}), 0) AS {c}{i}" for i in (3, 2, 1) for c in "ab") + " FROM v GROUP BY 1)"


def _visits(spark, sf, flat):
    v = diagnoses(spark, sf).groupBy("person_id", "t").agg(F.array(F.count(F.lit(1)).cast("double"), F.countDistinct(C.text_root(F.col("code"))).cast("double")).alias("vector"))
    return documents.visit_vectors(v, 3, 2, "person_id", flat=flat)


@register("last_visit_vectors", f"WITH {VISITS} SELECT person_id, " + ", ".join(f"{c}{i}" for i in (3, 2, 1) for c in "ab") + " FROM w")
def visit_vectors(spark, sf):
    return _visits(spark, sf, True).select("person_id", *[F.get("vectors", F.lit(2 * (3 - i) + j)).alias(f"{c}{i}") for i in (3, 2, 1) for j, c in enumerate("ab")])


@register("last_visit_matrix", f"WITH {VISITS} SELECT person_id, a3 + a2 + a1 AS a, b3 + b2 + b1 AS b FROM w")
def visit_matrix(spark, sf):
    total = lambda j: F.aggregate("vectors", F.lit(0.0), lambda s, x: s + F.get(x, F.lit(j)))
    return _visits(spark, sf, False).select("person_id", total(0).alias("a"), total(1).alias("b"))


@register("tokens_from_index", f"WITH {TOK}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1), v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS i FROM c QUALIFY i <= 50) SELECT token, n FROM v UNION ALL SELECT 'unknown', sum(n)::BIGINT FROM c WHERE token NOT IN (SELECT token FROM v)")
def from_index(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(C.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    t = written(t, "times")  # texts are split once
    v = documents.vocabulary(t, "token", 50, "times")
    return frames.from_index(frames.apply_vocabulary(t, v).drop("token"), v).groupBy("token").agg(F.sum("times").alias("n"))


@register("incremental_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished(spark, sf):
    return patterns.incremental(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id")


@register("maximal_item_sets", "WITH s AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag || l_linestatus || l_linenumber % 2))) AS x FROM lineitem GROUP BY 1), d AS (SELECT DISTINCT x FROM s) SELECT k FROM s WHERE x IN (SELECT x FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE list_has_all(b.x, a.x) AND len(b.x) > len(a.x)))")
def maximal(spark, sf):
    item = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).cast("string"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(item).alias("x"))
    return patterns.maximal_sets(rows, "k", "x").select("k")


@register("midpoints", f"WITH {DX} SELECT person_id, min(t) + CAST(floor((max(t) - min(t)) / 2) AS INT) AS mid FROM dx GROUP BY 1")
def midpoints(spark, sf):
    return diagnoses(spark, sf).groupBy("person_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("person_id", S.midpoint(F.col("a"), F.col("b")).alias("mid"))


# Training tables, samples and evaluation.


@register("training_table", "SELECT l_orderkey * 10 + l_linenumber AS index, l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1, l_returnflag AS target FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def training_table(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("d", F.nullif(F.col("l_discount"), F.lit(0.0))).withColumn("i", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return labels.training_table(li, ["l_quantity", "d"], "l_returnflag", "i")


@register("prepared_classes", f"WITH r AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'AUTOMOBILE' ELSE c_mktsegment END AS m, c_custkey FROM customer), f AS (SELECT CASE WHEN m IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN m ELSE 'Others' END AS label, c_custkey FROM r) SELECT label, c_custkey FROM f WHERE label <> 'FURNITURE' QUALIFY row_number() OVER (PARTITION BY label ORDER BY {MD5}) <= 15")
def prepared(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), "c_custkey")
    return labels.prepared(c, "label", {"MACHINERY": "AUTOMOBILE"}, ["AUTOMOBILE", "BUILDING", "FURNITURE"], ["FURNITURE"], 15, "c_custkey")


@register("balanced_subset", f"WITH m AS (SELECT floor(min(n) * 0.8) AS k FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) SELECT c_mktsegment, c_custkey FROM customer, m QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) <= k")
def balanced(spark, sf):
    return sampling.balanced(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


@register("stratified_folds", f"SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {MD5}) - 1) % 5 AS INT) AS fold FROM customer")
def folds(spark, sf):
    return sampling.folds(table(spark, sf, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "fold")


@register("key_combinations", "SELECT a.n_regionkey, a.n_nationkey AS c1, b.n_nationkey AS c2, c.n_nationkey AS c3 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON c.n_regionkey = b.n_regionkey AND b.n_nationkey < c.n_nationkey")
def combos(spark, sf):
    return sampling.combinations(table(spark, sf, "nation"), "n_nationkey", 3, "n_regionkey")


CLASSES = ("de", "en", "es", "fr")
HITS = f"{SCORED}, x AS (SELECT l.class, (p.lang = l.class)::INT AS hit, p.score FROM p, (SELECT DISTINCT lang AS class FROM p WHERE lang IS NOT NULL) l WHERE p.lang IS NOT NULL)"


def _hits(spark, sf):
    s = _scored(spark, sf).where("lang is not null")
    return s.withColumn("class", F.explode(F.array(*[F.lit(x) for x in CLASSES]))).withColumn("hit", (F.col("lang") == F.col("class")).cast("int"))


WON = "sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*)"


@register("multiclass_auc", f"WITH {HITS}, n AS (SELECT class, score, sum(hit) AS p, sum(1 - hit) AS q FROM x GROUP BY 1, 2), e AS (SELECT a.class, sum(a.p * b.q * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / (sum(a.p * b.q)) AS auc FROM n a JOIN n b USING (class) GROUP BY 1), m AS (SELECT score, sum(p) AS p, sum(q) AS q FROM n GROUP BY 1), u AS (SELECT sum(a.p * b.q * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / sum(a.p * b.q) AS micro FROM m a, m b) SELECT round(avg(auc), 9) AS macro, round(min(auc), 9) AS lowest, round(max(auc), 9) AS highest, arg_min(class, auc) AS worst, round(any_value(micro), 9) AS micro FROM e, u")
def multiclass(spark, sf):
    x = evaluate.multiclass_auc(_hits(spark, sf), "class", "hit", "score")
    return x.select(*[F.round(c, 9).alias(c) for c in ("macro", "lowest", "highest", "micro")], "worst")


AP = "n AS (SELECT {0} score, sum(hit) AS p, count(*) AS c FROM x GROUP BY ALL), r AS (SELECT *, sum(p) OVER ({1} ORDER BY score DESC) AS tp, sum(c) OVER ({1} ORDER BY score DESC) AS al FROM n)"


@register("average_precision", f"WITH {HITS}, {AP.format('class,', 'PARTITION BY class')} SELECT class, sum(p)::BIGINT AS n_pos, round(sum(p * tp / al) / sum(p), 9) AS average_precision FROM r GROUP BY 1")
def precision(spark, sf):
    return evaluate.average_precision(_hits(spark, sf), ["class"], "hit", "score").withColumn("average_precision", F.round("average_precision", 9))


@register("average_precision_micro", f"WITH {HITS}, {AP.format('', '')} SELECT sum(p)::BIGINT AS n_pos, round(sum(p * tp / al) / sum(p), 9) AS average_precision FROM r")
def precision_micro(spark, sf):
    return evaluate.average_precision(_hits(spark, sf), [], "hit", "score").withColumn("average_precision", F.round("average_precision", 9))


U = "(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || d || ':53'), 1, 8) AS UBIGINT) / 4294967296.0)"


@register("bootstrap_auc", f"WITH {SCORED}, z AS (SELECT d, quality, score, {U} AS u FROM p, range(0, 10) AS t(d)), w AS (SELECT d, quality, score, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT AS w FROM z), n AS (SELECT d, score, sum(w * quality) AS p, sum(w * (1 - quality)) AS q FROM w GROUP BY 1, 2) SELECT CAST(a.d AS INT) AS draw, round(sum(a.p * b.q * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / sum(a.p * b.q), 9) AS auc FROM n a JOIN n b ON a.d = b.d GROUP BY 1")
def bootstrap(spark, sf):
    return evaluate.bootstrap_auc(_scored(spark, sf), "doc_id", "quality", "score", 10).withColumn("auc", F.round("auc", 9))


@register("word_centroid_bag", f"WITH {TOK} SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE ascii(token) % 4 = {c}) AS c{c}" for c in range(4)) + " FROM tok GROUP BY 1")
def centroid_bag(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(C.words(F.col("text"))).alias("token"))
    clusters = t.select("token").distinct().withColumn("cluster", F.ascii("token") % 4)
    return features.bag_of_centroids(t, clusters, [0, 1, 2, 3])


@register("cluster_summary", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x, count(*) AS n FROM x GROUP BY 1, 2) SELECT label, max(n) AS size, round(sum(x) FILTER (WHERE i < 3), 5) AS head, round(sum(x * x), 5) AS square FROM m GROUP BY 1")
def cluster_summary(spark, sf):
    m = features.cluster_means(table(spark, sf, "embeddings"), "label", "embedding")
    return m.select("label", "size", F.round(F.aggregate(F.slice("mean", 1, 3), F.lit(0.0), lambda s, x: s + x), 5).alias("head"), F.round(features.dot(F.col("mean"), F.col("mean")), 5).alias("square"))


@register("cluster_representatives", "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2), d AS (SELECT label, vec_id, round(sum((x - m) * (x - m)), 6) AS distance FROM x JOIN m USING (label, i) GROUP BY 1, 2) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 3")
def representatives(spark, sf):
    e = table(spark, sf, "embeddings")
    return features.nearest_members(e, features.cluster_means(e, "label", "embedding"), "label", "vec_id", "embedding", 3).select("label", "vec_id", "rank")


COS = "1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z))) * sqrt(list_sum(list_transform(b.embedding, lambda z: z::DOUBLE * z))))"


@register("embedding_distances", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0")
def distances(spark, sf):
    """The stated query set, the vectors whose id is divisible by 50, against all."""
    e = table(spark, sf, "embeddings")
    return features.distances(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")


@register("neighbour_agreement", f"WITH d AS (SELECT b.vec_id AS query_id, a.label = b.label AS same, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({COS}, 6), a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, round(avg(same::INT), 9) AS agreement FROM d WHERE rank <= 10 GROUP BY 1")
def agreement(spark, sf):
    e = table(spark, sf, "embeddings")
    near = features.nearest_to(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return evaluate.neighbour_agreement(near, e, "vec_id", "label").withColumn("agreement", F.round("agreement", 9))


@register("standardized", "SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 6) AS z FROM supplier")
def standardized(spark, sf):
    return features.standardize(table(spark, sf, "supplier"), "s_acctbal").select("s_suppkey", F.round("s_acctbal_standard", 6).alias("z"))


@register("average_vectors", "WITH e AS (SELECT label, vec_id, embedding FROM embeddings), x AS (SELECT label, vec_id % 3 + 1 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM e), m AS (SELECT label, i, sum(x * w) / sum(w) AS x FROM x GROUP BY 1, 2) SELECT label AS doc_id, round(sum(x * (i + 1)), 4) AS checked FROM m GROUP BY 1")
def average_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    tokens = e.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("token"), (F.col("vec_id") % 3 + 1).alias("w"))
    v = features.average_vector(tokens, e.select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector")), "token", weight=F.col("w"))
    return v.select("doc_id", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("checked"))


@register("silhouette_by_k")
def silhouettes(spark, sf):
    """Mean silhouette of k-means over whole vectors (MLlib): iterative, so no SQL."""
    e = table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])
    return spark.createDataFrame(list(evaluate.silhouettes(e, e.columns, [2, 4, 6, 8, 10]).items()), "k int, silhouette double")
