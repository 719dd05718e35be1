"""Cohort, sequence and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import predicates as P
from ..functions import sequences as S
from ..operators import cohort, documents, stats
from .registry import register
from .tables import CODED, DX, DX_POS, EV, EV_POS, coded_parts, diagnoses, events, table

ROOTS = ["105", "210", "315"]
IN_ROOTS = "split_part(code, '.', 1) IN ('105', '210', '315')"


@register("prior_codes_before_event", f"WITH {EV}, f AS (SELECT doc_id, min(t) AS f FROM ev WHERE code = 'purchase' GROUP BY 1) SELECT code, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ev JOIN f USING (doc_id) WHERE t < f GROUP BY code")
def prior_codes(spark, sf):
    before = documents.before_first(events(spark, sf), F.col("code") == "purchase")
    return before.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register("cohort_semi_by_codes", f"WITH {DX} SELECT person_id, code, count(*) AS n FROM dx WHERE person_id IN (SELECT person_id FROM dx WHERE code LIKE '105%' OR code LIKE '210%') GROUP BY ALL")
def semi(spark, sf):
    rows = cohort.rows_of_matching(diagnoses(spark, sf), P.starts_with_any(F.col("code"), ["105", "210"]))
    return rows.groupBy("person_id", "code").agg(F.count(F.lit(1)).alias("n"))


@register("cohort_exclude_ids", f"WITH {DX} SELECT person_id, count(*) AS n FROM dx WHERE person_id NOT IN (SELECT person_id FROM dx WHERE code LIKE '105%') GROUP BY 1")
def exclude(spark, sf):
    d = diagnoses(spark, sf)
    ids = d.where(F.col("code").startswith("105")).select("person_id").distinct()
    return cohort.without(d, ids).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))


@register("cohort_all_codes", f"WITH {DX} SELECT person_id, count(DISTINCT split_part(code, '.', 1)) AS n_matched FROM dx WHERE split_part(code, '.', 1) IN ('105', '210') GROUP BY 1 HAVING count(DISTINCT split_part(code, '.', 1)) = 2")
def all_codes(spark, sf):
    return cohort.persons_by_codes(diagnoses(spark, sf), C.text_root(F.col("code")), ROOTS[:2], "and")


@register("cohort_any_code", f"WITH {DX} SELECT person_id, count(DISTINCT split_part(code, '.', 1)) AS n_matched FROM dx WHERE {IN_ROOTS} GROUP BY 1")
def any_code(spark, sf):
    return cohort.persons_by_codes(diagnoses(spark, sf), C.text_root(F.col("code")), ROOTS, "or")


@register("top_codes", f"WITH {DX} SELECT split_part(code, '.', 1) AS code, count(*) AS n FROM dx GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def top(spark, sf):
    return cohort.top_codes(diagnoses(spark, sf), C.text_root(F.col("code")))


@register("persons_per_code", f"WITH {DX} SELECT code, count(DISTINCT person_id) AS n_persons, count(*) AS n FROM dx GROUP BY 1")
def common(spark, sf):
    return cohort.persons_per_code(diagnoses(spark, sf), F.col("code"))


@register("codes_shared_by_persons", f"WITH {DX} SELECT DISTINCT left(code, 1) AS code FROM dx WHERE person_id IN (1, 2, 4) GROUP BY 1 HAVING count(DISTINCT person_id) = 3")
def shared(spark, sf):
    return cohort.codes_of_all(diagnoses(spark, sf), F.substring("code", 1, 1), [1, 2, 4])


@register("stratified_code_share", f"WITH {DX}, p AS (SELECT person_id, max((code LIKE '584%')::INT) AS hit FROM dx GROUP BY 1) SELECT c_mktsegment AS label, count(*) AS n, sum(hit) AS n_hit, round(avg(hit), 9) AS ratio FROM p JOIN customer ON c_custkey = person_id GROUP BY 1")
def share(spark, sf):
    hit = diagnoses(spark, sf).groupBy("person_id").agg(F.max(F.col("code").startswith("584").cast("int")).alias("hit"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("label"))
    return hit.join(c, "person_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("n_hit"), F.round(F.avg("hit"), 9).alias("ratio"))


@register("left_outer_labels", "SELECT d.doc_id, coalesce(CAST(min(l.quality) AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def labelled(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return cohort.fill_labels(d, lab, "doc_id", "label")


@register("range_partition_scan", "SELECT CAST(floor((o_custkey - lo) / ceil((hi - lo + 1) / 10)) AS INT) AS part, count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high FROM orders, (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders) GROUP BY 1")
def ranges(spark, sf):
    """All orders, in ten ranges between the table's smallest and largest customer."""
    orders = table(spark, sf, "orders")
    low, high = orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()  # one row
    inside = cohort.in_ranges(orders, "o_custkey", low or 0, (high or 0) + 1, 10)
    return inside.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))


@register("theta_group_leaders", """WITH s AS (SELECT l_orderkey, l_suppkey % 7 AS entity, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS attrs FROM lineitem GROUP BY 1, 2),
  k AS (SELECT entity, array_to_string(attrs, ',') AS id, attrs FROM s GROUP BY ALL)
  SELECT a.entity, a.id, arg_min(b.id, lpad(CAST(100 - len(b.attrs) AS VARCHAR), 3, '0') || b.id) AS leader FROM k a JOIN k b ON a.entity = b.entity AND list_has_all(b.attrs, a.attrs) GROUP BY 1, 2""")
def leaders(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 7).alias("entity")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("attrs"))
    kinds = rows.select("entity", "attrs").distinct().withColumn("id", F.array_join("attrs", ",")).withColumn("key", F.struct("entity", "id"))
    return cohort.group_by_subset(kinds, "key", "entity", "attrs").select("key.entity", "key.id", F.col("leader.id").alias("leader"))


@register("union_sources_sequence", "WITH u AS (SELECT user_id AS doc_id, CAST(ts AS DATE) AS t, 0 AS so, event_id AS id, event_type AS code FROM events UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), 1, o_orderkey, o_orderpriority FROM orders) SELECT doc_id, count(*) AS n, md5(string_agg(code, ',' ORDER BY t, so, id)) AS sequence_md5 FROM u GROUP BY 1")
def union_sources(spark, sf):
    a = events(spark, sf).select("doc_id", "t", F.col("event_id").alias("id"), "code")
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"))
    d = documents.build(cohort.union_sources(a, b), ["t", "source_order", "id"])
    return d.select("doc_id", F.size("events").cast("long").alias("n"), F.md5(F.array_join(F.transform("events", lambda e: e["code"]), ",")).alias("sequence_md5"))


@register("visits_per_person", f"WITH {DX}, v AS (SELECT person_id, t, count(*) AS k FROM dx GROUP BY 1, 2) SELECT person_id, count(*) AS n_visits, max(k) AS max_codes, min(k) AS min_codes, round(avg(k), 9) AS mean_codes FROM v GROUP BY 1")
def visits(spark, sf):
    v = documents.with_visit(diagnoses(spark, sf), "person_id").groupBy("person_id", "visit").agg(F.count(F.lit(1)).alias("k"))
    return v.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_visits"), F.max("k").alias("max_codes"), F.min("k").alias("min_codes"), F.round(F.avg("k"), 9).alias("mean_codes"))


CUT = "WITH " + EV_POS + ", h AS (SELECT doc_id, pos AS hp, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM pos WHERE code = 'purchase'), n AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY 1) SELECT n.doc_id, n.n, {} AS n_cut FROM n LEFT JOIN h ON n.doc_id = h.doc_id AND k = {}"


def _documents(spark, sf):
    return documents.build(events(spark, sf).select("doc_id", "t", "event_id", "code"), ["t", "event_id"])


def _cut(spark, sf, **how):
    part = S.cut(F.col("events"), lambda x: x["code"] == "purchase", **how)
    return _documents(spark, sf).select("doc_id", F.size("events").cast("long").alias("n"), F.size(part).cast("long").alias("n_cut"))


@register("cut_prior_length", CUT.format("coalesce(hp, n)", 2))
def cut_prior(spark, sf):
    return _cut(spark, sf, policy="prior", nth=2)


@register("cut_posterior_length", CUT.format("coalesce(n - hp, n)", 1))
def cut_posterior(spark, sf):
    return _cut(spark, sf, policy="posterior", inclusive=False)


@register("cut_inverse_length", f"WITH {EV_POS}, f AS (SELECT doc_id, min(pos) AS p FROM pos WHERE code = 'view' GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM ev GROUP BY 1) SELECT doc_id, coalesce(p - 1, n) AS n_cut FROM n LEFT JOIN f USING (doc_id)")
def cut_inverse(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size(S.cut_inverse(F.col("events"), lambda x: x["code"] != "view")).cast("long").alias("n_cut"))


@register("segment_two_halves", f"WITH {EV}, f AS (SELECT doc_id, min(t) AS f FROM ev WHERE code = 'error' GROUP BY 1) SELECT doc_id, coalesce(CAST(t > f AS INT), 0) AS segment, count(*) AS n FROM ev LEFT JOIN f USING (doc_id) GROUP BY ALL")
def halves(spark, sf):
    return documents.segment_halves(events(spark, sf), F.col("code") == "error").groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@register("segment_complete", f"WITH {EV}, h AS (SELECT DISTINCT doc_id, t AS ht FROM ev WHERE code = 'signup'), m AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(*) > 1), s AS (SELECT event_id, ev.doc_id, count(h.ht) AS segment FROM ev JOIN m USING (doc_id) LEFT JOIN h ON h.doc_id = ev.doc_id AND h.ht < ev.t GROUP BY ALL) SELECT doc_id, CAST(segment AS INT) AS segment, count(*) AS n FROM s GROUP BY ALL")
def complete(spark, sf):
    return documents.segment_complete(events(spark, sf), F.col("code") == "signup").groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@register("slice_by_date", f"WITH {EV}, m AS (SELECT min(t) + CAST(floor((max(t) - min(t)) / 2) AS INT) AS mid FROM ev) SELECT doc_id, count(*) FILTER (WHERE t <= mid) AS n_prior, count(*) FILTER (WHERE t > mid) AS n_posterior FROM ev, m GROUP BY 1")
def slice_date(spark, sf):
    e = events(spark, sf)
    mid = e.agg(F.expr("date_add(min(t), cast(floor(datediff(max(t), min(t)) / 2) as int))")).first()[0]  # one row
    n = lambda policy, inclusive: documents.slice_by_time(e, F.lit(mid), policy, inclusive).groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{policy}"))
    both = n("prior", True).join(n("posterior", False), "doc_id", "full")
    return both.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_prior", "n_posterior")])


@register("time_to_first_last", f"WITH {DX}, a AS (SELECT person_id, min(t) AS t0, max(t) AS t1, count(DISTINCT t) AS n_visits FROM dx GROUP BY 1), h AS (SELECT person_id, min(t) AS h0, max(t) AS h1 FROM dx WHERE code LIKE '10%' GROUP BY 1) SELECT person_id, h0 - t0 AS time_to_first, h1 - t0 AS time_to_last, t1 - t0 AS days_elapsed, n_visits FROM a JOIN h USING (person_id)")
def first_last(spark, sf):
    d = diagnoses(spark, sf)
    span = d.groupBy("person_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.countDistinct("t").alias("n_visits"))
    hit = documents.hit_dates(d, F.col("code").startswith("10"), "person_id")
    days = lambda a, b: S.days(F.col(a), F.col(b)).cast("long")
    return span.join(hit, "person_id").select("person_id", days("t0", "first_hit").alias("time_to_first"), days("t0", "last_hit").alias("time_to_last"), days("t0", "t1").alias("days_elapsed"), "n_visits")


@register("latency_precode_target", f"WITH {DX}, f AS (SELECT person_id, min(t) AS f FROM dx WHERE code LIKE '5%' GROUP BY 1), p AS (SELECT person_id, min(t) AS p FROM dx WHERE code LIKE '2%' GROUP BY 1) SELECT person_id, f - p AS latency FROM f JOIN p USING (person_id) WHERE p < f")
def latency(spark, sf):
    d = diagnoses(spark, sf)
    target = documents.hit_dates(d, F.col("code").startswith("5"), "person_id").select("person_id", F.col("first_hit").alias("f"))
    pre = documents.hit_dates(d, F.col("code").startswith("2"), "person_id").select("person_id", F.col("first_hit").alias("p"))
    return target.join(pre, "person_id").where("p < f").select("person_id", S.days(F.col("p"), F.col("f")).cast("long").alias("latency"))


@register("last_n_visits", f"WITH {DX}, v AS (SELECT *, dense_rank() OVER (PARTITION BY person_id ORDER BY t DESC) AS b FROM dx) SELECT person_id, count(*) AS n, count(DISTINCT t) AS n_visits, min(t) AS since FROM v WHERE b <= 3 GROUP BY 1")
def last_visits(spark, sf):
    x = documents.last_visits(diagnoses(spark, sf), 3, "person_id")
    return x.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_visits"), F.min("t").alias("since"))


@register("padded_last_codes", f"WITH {DX_POS}, n AS (SELECT person_id, max(pos) AS n FROM dpos GROUP BY 1) SELECT person_id, repeat('0|', CAST(greatest(30 - n, 0) AS INT)) || string_agg(code, '|' ORDER BY pos) AS codes FROM dpos JOIN n USING (person_id) WHERE pos > n - 30 GROUP BY person_id, n")
def padded(spark, sf):
    d = documents.build(diagnoses(spark, sf).select("person_id", "t", "row_id", "code"), ["t", "row_id"], "person_id")
    d = d.select("person_id", F.transform("events", lambda e: e["code"]).alias("codes"))
    return d.select("person_id", F.array_join(S.pad_left(F.col("codes"), 30, F.lit("0")), "|").alias("codes"))


@register("running_code_counts", f"WITH {EV} SELECT event_id, doc_id, code, count(*) OVER (PARTITION BY doc_id, code ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM ev")
def running(spark, sf):
    return documents.running_counts(events(spark, sf), ["t", "event_id"]).select("event_id", "doc_id", "code", "n_so_far")


@register("lab_stats", f"WITH {EV} SELECT code, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(value) AS n_sample FROM ev GROUP BY 1")
def lab(spark, sf):
    return _rounded(stats.summary(events(spark, sf), ["code"], "value"))


MAD = f"WITH {EV}, m AS (SELECT code, median(value) AS med, count(value) AS nv FROM ev GROUP BY 1), a AS (SELECT code, median(abs(value - med)) AS mad FROM ev JOIN m USING (code) GROUP BY 1), k AS (SELECT ev.* FROM ev JOIN m USING (code) JOIN a USING (code) WHERE value IS NOT NULL AND (nv <= 5 OR coalesce(0.6745 * abs(value - med) / nullif(mad, 0), 0) <= 1.5))"


def _rounded(df):
    return df.select("code", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "min", "max", "n_sample")


@register("lab_stats_mad", MAD + " SELECT code, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, count(value) AS n_sample FROM k GROUP BY 1")
def lab_mad(spark, sf):
    return _rounded(stats.lab_stats(events(spark, sf), ["code"], "value", threshold=1.5))


@register("outliers_double_mad", f"WITH {EV}, m AS (SELECT code, median(value) AS med FROM ev GROUP BY 1), x AS (SELECT ev.*, med, abs(value - med) AS dev FROM ev JOIN m USING (code)), s AS (SELECT code, median(dev) FILTER (WHERE value <= med) AS lm, median(dev) FILTER (WHERE value >= med) AS rm FROM x GROUP BY 1) SELECT event_id, code, value FROM x JOIN s USING (code) WHERE dev > 0 AND 0.6745 * dev / nullif(CASE WHEN value <= med THEN lm ELSE rm END, 0) > 2.5")
def double_mad(spark, sf):
    return stats.double_mad_outliers(events(spark, sf), ["code"], "value", 2.5).select("event_id", "code", "value")


@register("outlier_percentile", f"WITH {EV}, b AS (SELECT code, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM ev GROUP BY 1) SELECT code, count(*) AS n, round(sum(value), 4) AS total FROM ev JOIN b USING (code) WHERE value BETWEEN lo AND hi GROUP BY 1")
def percentile(spark, sf):
    return stats.central(events(spark, sf), ["code"], "value").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


CODES = ["click", "error", "purchase", "signup", "view"]


@register("person_lab_pivot_fill", f"WITH {EV}, g AS (SELECT code, avg(value) AS g FROM ev GROUP BY 1), u AS (SELECT DISTINCT doc_id FROM ev), w AS (SELECT doc_id, code, avg(value) AS a FROM ev GROUP BY 1, 2) SELECT u.doc_id, " + ", ".join(f"round(max(coalesce(a, g)) FILTER (WHERE g.code = '{c}'), 6) AS \"{c}\"" for c in CODES) + " FROM u CROSS JOIN g LEFT JOIN w ON w.doc_id = u.doc_id AND w.code = g.code GROUP BY 1")
def pivot(spark, sf):
    wide = stats.pivot_mean(events(spark, sf), "doc_id", "code", "value", CODES)
    return wide.select("doc_id", *[F.round(c, 6).alias(c) for c in CODES])


@register("cohort_summary", f"WITH {DX}, p AS (SELECT person_id, count(*) AS n, max(t) - min(t) AS span FROM dx GROUP BY 1) SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_length, round(stddev_samp(n), 6) AS std_length, min(n) AS min_length, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, max(n) AS max_length, round(avg(span), 6) AS mean_days, round(avg(span) / 365.0, 6) AS mean_years FROM p")
def summary(spark, sf):
    p = diagnoses(spark, sf).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.max("t"), F.min("t")).alias("span"))
    q = stats.quantiles(p, [], F.col("n"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n_values")
    rest = p.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.stddev_samp("n"), 6).alias("std_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.round(F.avg("span"), 6).alias("mean_days"), F.round(F.avg("span") / 365.0, 6).alias("mean_years"))
    return rest.crossJoin(F.broadcast(q))  # one row each


@register("table_profile", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(DISTINCT quality) AS n_labels FROM labels")
def profile(spark, sf):
    return stats.profile(table(spark, sf, "labels"), "doc_id", "quality")


@register("distinct_value_counts", "SELECT count(DISTINCT c_nationkey) AS c_nationkey, count(DISTINCT c_mktsegment) AS c_mktsegment FROM customer")
def distinct(spark, sf):
    return stats.distinct_values(table(spark, sf, "customer").select("c_nationkey", "c_mktsegment"))


@register("mean_nontrivial_attributes", "SELECT round(avg((l_discount <> 0)::INT + (l_tax <> 0)::INT), 9) AS mean_nontrivial FROM lineitem")
def nontrivial(spark, sf):
    return stats.nontrivial(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]).select(F.round("mean_nontrivial", 9).alias("mean_nontrivial"))



@register("code_strings", f"WITH {CODED}" + r""" SELECT code, CASE WHEN regexp_extract(code, '(?i)^([ve]?\d+)', 1) <> '' THEN regexp_extract(code, '(?i)^([ve]?\d+)', 1) ELSE code END AS root,
  split_part(code, '.', 1) AS text_root, regexp_matches(code, '^(V\d{2}(\.\d{1,2})?|\d{3}(\.\d{1,2})?|E\d{3}(\.\d)?)$') AS icd9, regexp_matches(code, '(?i)^[A-TV-Z][0-9][A-Z0-9](\.\w{1,4}\b)?') AS icd10,
  regexp_matches(upper(code), '^(MULTUM|NDC|MED):\d{2,12}') AS med, regexp_matches(lower(code), '^[ev]') AS supplementary,
  CASE WHEN lower(code) LIKE 'e%' THEN TRY_CAST(regexp_replace(code, '^[evEV]', '') AS DOUBLE) + 5000 WHEN lower(code) LIKE 'v%' THEN TRY_CAST(regexp_replace(code, '^[evEV]', '') AS DOUBLE) + 22000 ELSE TRY_CAST(code AS DOUBLE) END AS number,
  coalesce(regexp_matches(code, '^\d{3}(\.|$)') AND TRY_CAST(code AS DOUBLE) BETWEEN 140 AND 239, false) AS neoplasm FROM c""")
def code_strings(spark, sf):
    x = F.col("code")
    return coded_parts(spark, sf).select("code", C.root_code(x).alias("root"), C.text_root(x).alias("text_root"), C.is_icd9(x).alias("icd9"), C.is_icd10(x).alias("icd10"), C.is_med_code(x).alias("med"), C.is_supplementary(x).alias("supplementary"), C.numerize(x).alias("number"), C.within(x, "140", "239").alias("neoplasm"))


# How each spelling of a drug code is made of its labeler (a), product (b) and package (c), '*' for digits left out, and the eleven digits it stands for (None: no code).
NDC = {"concat('0', a, '-', b, '-', c)": "concat(a, b, c)", "concat(a, '-', substr(b, 2), '-', substr(c, 2))": "concat(a, '0', substr(b, 2), '0', substr(c, 2))", "concat(substr(a, 2), '-', b, '-', c)": "concat('0', substr(a, 2), b, c)", "concat(a, '-', b)": "concat(a, b, '00')", "concat(a, '-', b, '-*', substr(c, 2))": "concat(a, b, '0', substr(c, 2))", "concat(a, b, c)": "concat(a, b, c)", "concat('0', a, b, c)": "concat(a, b, c)", "concat('2', a, b, c)": None, "concat(a, b)": None, "concat(a, 'x-', b, '-', c)": None, "concat(a, '-', b, '-', c, '-1')": None}
PARTS = "SELECT lpad(CAST(p_partkey * 37 % 100000 AS STRING), 5, '0') AS a, lpad(CAST(p_partkey * 53 % 10000 AS STRING), 4, '0') AS b, lpad(CAST(p_partkey % 100 AS STRING), 2, '0') AS c, p_partkey AS k FROM part"
_of = lambda values: f"CASE k % {len(NDC)} " + " ".join(f"WHEN {i} THEN {v or 'NULL'}" for i, v in enumerate(values)) + " END"


@register("ndc_normalize_vectors", f"SELECT k, {_of(NDC)} AS code, {_of(NDC.values())} AS ndc FROM ({PARTS})")
def ndc(spark, sf):
    p = table(spark, sf, "part").select(F.expr("lpad(CAST(p_partkey * 37 % 100000 AS STRING), 5, '0')").alias("a"), F.expr("lpad(CAST(p_partkey * 53 % 10000 AS STRING), 4, '0')").alias("b"), F.expr("lpad(CAST(p_partkey % 100 AS STRING), 2, '0')").alias("c"), F.col("p_partkey").alias("k"))
    return p.select("k", F.expr(_of(NDC)).alias("code")).withColumn("ndc", C.ndc_normalize(F.col("code")))


@register("null_and_number_tests", "WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'x' || CAST(value AS VARCHAR) WHEN 3 THEN '2020-02-30' ELSE '2020-02-28' END AS s FROM events) SELECT sum((lower(trim(s)) IN ('', 'nan', 'null', 'none', 'n/a', 'na'))::INT) AS n_null, sum((TRY_CAST(s AS DATE) IS NOT NULL)::INT) AS n_date, sum((TRY_CAST(s AS DOUBLE) IS NOT NULL)::INT) AS n_number FROM v")
def tests(spark, sf):
    v = F.expr("CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' NaN ' WHEN 2 THEN concat('x', cast(value as string)) WHEN 3 THEN '2020-02-30' ELSE '2020-02-28' END")
    e = table(spark, sf, "events").select(v.alias("s"))
    n = lambda c: F.sum(c.cast("long"))
    return e.agg(n(P.is_null_text(F.col("s"))).alias("n_null"), n(P.is_date(F.col("s"))).alias("n_date"), n(P.is_number(F.col("s"))).alias("n_number"))


@register("document_policies", f"WITH {DX}, p AS (SELECT person_id, count(*) AS n FROM dx WHERE code LIKE '1%' GROUP BY 1) SELECT count(*) AS n_nonempty, sum((n >= 10)::INT) AS n_min, sum((n < 10)::INT) AS n_unknown FROM p")
def policies(spark, sf):
    d = documents.build(diagnoses(spark, sf).select("person_id", "t", "row_id", "code"), ["t", "row_id"], "person_id")
    d = documents.filter_codes(d, lambda c: c.startswith("1"))
    kept = documents.filter_documents(d, "empty")
    marked = documents.filter_documents(kept, "unknown", 10)
    unknown = (F.get(F.col("events"), 0)["code"] == "unknown").cast("long")
    return marked.agg(F.count(F.lit(1)).alias("n_nonempty"), F.sum(1 - unknown).alias("n_min"), F.sum(unknown).alias("n_unknown"))


@register("parse_assemble_round_trip", f"WITH {DX} SELECT person_id, count(*) AS n, count(DISTINCT t) AS n_visits, true AS same FROM dx GROUP BY 1")
def round_trip(spark, sf):
    d = diagnoses(spark, sf).groupBy("person_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "t", "code"))), lambda e: F.struct(e["t"].alias("t"), e["code"].alias("code"))).alias("visit"))
    v = d.groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "visit"))), lambda x: x["visit"]).alias("visits"))
    text = v.withColumn("text", S.assemble(F.col("visits"))).withColumn("back", S.parse(F.col("text")))
    return text.select("person_id", F.size(F.flatten("back")).cast("long").alias("n"), F.size("back").cast("long").alias("n_visits"), (S.assemble(F.col("back")) == F.col("text")).alias("same"))
