"""Documents: each subject's events in order, as one array of structs, and what is cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import Predicate
from ..state import numbered


def build(events: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """One row per document: ``events`` array<struct<t, ..., code>> sorted by ``order`` (t first)."""
    return events.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*order, *([] if "code" in order else ["code"])))).alias("events"))


def with_position(events: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    return events.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def with_visit(events: DataFrame, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """Visit number: 1 for a document's first date, one more with every change of date."""
    return events.withColumn("visit", F.dense_rank().over(Window.partitionBy(doc).orderBy(t)))


def hit_dates(events: DataFrame, condition: Column, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """First and last date at which the condition holds, and the number of such dates."""
    found = events.where(condition).groupBy(doc)
    return found.agg(F.min(t).alias("first_hit"), F.max(t).alias("last_hit"), F.countDistinct(t).alias("n_hit_dates"))


def before_first(events: DataFrame, condition: Column, inclusive: bool = False, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """Rows before (or at) the first hit's date; documents without a hit go."""
    first = hit_dates(events, condition, doc, t).select(doc, "first_hit")
    side = F.col(t) <= F.col("first_hit") if inclusive else F.col(t) < F.col("first_hit")
    return events.join(first, doc).where(side).drop("first_hit")


def segment_halves(events: DataFrame, condition: Column, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """Segment 0 up to the first hit's date, 1 after it; without a hit all is 0."""
    first = hit_dates(events, condition, doc, t).select(doc, "first_hit")
    return events.join(first, doc, "left").withColumn("segment", F.coalesce((F.col(t) > F.col("first_hit")).cast("int"), F.lit(0))).drop("first_hit")


def segment_complete(events: DataFrame, condition: Column, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """Cut after every hit date: the segment is the number of earlier hit dates. Documents with one hit date at most go."""
    dates = events.where(condition).select(doc, F.col(t).alias("_hit")).distinct()
    several = dates.groupBy(doc).agg(F.array_sort(F.collect_list("_hit")).alias("_hits")).where(F.size("_hits") > 1)
    return events.join(several, doc).withColumn("segment", F.size(F.filter("_hits", lambda h: h < F.col(t)))).drop("_hits")


def slice_by_time(events: DataFrame, when: Column, policy: str = "prior", inclusive: bool = True, t: str = "t") -> DataFrame:
    c = F.col(t)
    side = {("prior", True): c <= when, ("prior", False): c < when, ("posterior", True): c >= when, ("posterior", False): c > when}
    return events.where(side[policy, inclusive])


def last_visits(events: DataFrame, n: int, doc: str = "doc_id", t: str = "t") -> DataFrame:
    """Rows of a document's last ``n`` visits."""
    w = Window.partitionBy(doc).orderBy(F.desc(t))
    return events.withColumn("_back", F.dense_rank().over(w)).where(F.col("_back") <= n).drop("_back")


def filter_codes(documents: DataFrame, p: Predicate, column: str = "events") -> DataFrame:
    """Codes and their times filtered together."""
    return documents.withColumn(column, F.filter(column, lambda x: p(x["code"])))


def filter_documents(documents: DataFrame, policy: str = "empty", at_least: int = 10, column: str = "events") -> DataFrame:
    """empty: drop documents without events; min: those of under ``at_least``; unknown: replace these by one unknown event (their label becomes 'unknown')."""
    n = F.size(column)
    if policy.startswith("empty"):
        return documents.where(n >= 1)
    if policy.startswith("min"):
        return documents.where(n >= at_least)
    kind = documents.schema[column].dataType.elementType
    unknown = F.array(F.struct(*[F.lit("9999-01-01" if f.name == "t" else "unknown" if f.name == "code" else None).cast(f.dataType).alias(f.name) for f in kind.fields]))
    short = {column: F.when(n < at_least, unknown).otherwise(F.col(column))}
    if "label" in documents.columns:
        short["label"] = F.when(n < at_least, "unknown").otherwise(F.col("label"))
    return documents.withColumns(short)


def running_counts(events: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """How often each event's code has occurred in its document so far, itself included."""
    w = Window.partitionBy(doc, "code").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n_so_far", F.count(F.lit(1)).over(w))


def vocabulary(tokens: DataFrame, token: str, size: int | None = None, weight: str | None = None) -> DataFrame:
    """token, n and index from 1: the most frequent first, of equal ones by token. With ``size`` only the first so many, found by a distributed top-n. Rows count once, or ``weight`` times."""
    counts = tokens.groupBy(F.col(token).alias("token")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    order = [F.desc("n"), F.col("token")]
    if size:
        return counts.orderBy(*order).limit(size).withColumn("index", F.row_number().over(Window.orderBy(*order)))  # ``size`` rows
    return numbered(counts, order, start=1).withColumn("index", F.col("index").cast("int"))


def unroll(visits: DataFrame, column: str = "visits") -> DataFrame:
    """One row per choice of a code from each visit, the codes joined by a space, over array<array<string>>; an empty visit adds nothing."""
    add = lambda done, visit: F.flatten(F.transform(done, lambda s: F.transform(F.when(F.size(visit) > 0, visit).otherwise(F.array(F.lit(""))), lambda c: F.trim(F.concat_ws(" ", s, c)))))
    return visits.withColumn("sentence", F.explode(F.aggregate(F.col(column), F.array(F.lit("")), add)))


def codified(events: DataFrame, mapping: DataFrame, dedupe: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``events`` with codes mapped: blank is 'empty'; several words are their mapped value or 'unknown'; others their mapped value or themselves.

    ``mapping``: source_value, internal_code (of several the smallest). With ``dedupe`` (document and visit columns) a
    code stays once a visit, the first by ``order``.
    """
    one = mapping.groupBy(F.col("source_value").alias("_raw")).agg(F.min("internal_code").alias("_to"))
    raw = F.trim(F.coalesce("code", F.lit("")))
    found = events.withColumn("_raw", raw).join(one, "_raw", "left")
    code = F.when(F.col("_raw") == "", "empty").otherwise(F.coalesce("_to", F.when(F.col("_raw").rlike(r"\s"), "unknown").otherwise(F.col("_raw"))))
    out = found.withColumn("code", code).drop("_raw", "_to")
    if not dedupe:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*dedupe, "code").orderBy(*(order or ["code"])))).where("_r = 1").drop("_r")


def visit_vectors(vectors: DataFrame, n: int, size: int, doc: str = "doc_id", t: str = "t", flat: bool = True) -> DataFrame:
    """Each document's last ``n`` visit vectors (doc, t, vector of ``size``) in order, padded in front with zeros: one array, or an array of arrays.

    Only n vectors a document reach the aggregation.
    """
    w = Window.partitionBy(doc).orderBy(F.desc(t))
    last = vectors.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n)
    rows = last.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col("vector")))), lambda x: x["vector"]).alias("v"))
    zero = F.array_repeat(F.lit(0.0), size)
    padded = F.concat(F.array_repeat(zero, F.greatest(n - F.size("v"), F.lit(0))), F.col("v"))
    return rows.select(doc, (F.flatten(padded) if flat else padded).alias("vectors"))


TRANSFORMS = ("cut", "simplify", "filter")


def transformed(documents: DataFrame, how: str, p: Predicate, column: str = "events", **options) -> DataFrame:
    """One step by name: cut (at hits of ``p``), simplify (codes to ``p`` of them), filter (codes that meet ``p``)."""
    from ..functions import sequences as S

    if how not in TRANSFORMS:
        raise ValueError(f"{how}: one of {TRANSFORMS}")
    if how == "cut":
        return documents.withColumn(column, S.cut(F.col(column), lambda x: p(x["code"]), **options))
    if how == "simplify":
        return documents.withColumn(column, F.transform(column, lambda x: x.withField("code", p(x["code"]))))
    return filter_codes(documents, p, column)


def process(events: DataFrame, order: list[str], steps: list[dict], labels: DataFrame | None = None, policy: str = "empty", at_least: int = 10, doc: str = "doc_id") -> DataFrame:
    """Events to documents: assembled, transformed step by step (see ``transformed``), labelled ('unknown' without one), filtered by ``filter_documents``.

    doc, events, label. Group by label for the strata.
    """
    out = build(events, order, doc)
    for s in steps:
        out = transformed(out, **s)
    if labels is not None:
        one = labels.groupBy(doc).agg(F.min("label").alias("label"))
        out = out.join(one, doc, "left").withColumn("label", F.coalesce("label", F.lit("unknown")))
    return filter_documents(out, policy, at_least)


CONTENT = {"diag": ("diag", "diagnosis", "condition"), "med": ("med", "drug", "medication"), "lab": ("lab", "measurement"), "regular": ("regular", "all", "mixed", "full")}


def content_type(name: str) -> str:
    """The one name of a content type, from any of its names or a beginning of it."""
    low = name.strip().lower()
    for kind, names in CONTENT.items():
        if any(low.startswith(x) or x.startswith(low) for x in names if low):
            return kind
    raise ValueError(f"unknown content type {name!r}")


def option(names: list[str], default=None, **given):
    """The first of an option's names that is given."""
    return next((given[n] for n in names if given.get(n) is not None), default)


def filled_visits(visits: DataFrame, at_least: int, doc: str = "doc_id", visit: str = "visit", codes: str = "codes", seed: int = 53) -> DataFrame:
    """Visits of fewer codes than ``at_least`` with draws with replacement from their own codes after them, up to that length.

    A draw is a function of document, visit, its number and seed, so a run repeats. Empty visits stay empty.
    """
    n = F.size(codes)
    u = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(doc).cast("string"), F.col(visit).cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    more = F.when((n > 0) & (n < at_least), F.transform(F.sequence(F.lit(1), at_least - n), lambda i: F.get(codes, F.pmod(u(i), n).cast("int")))).otherwise(F.array().cast(visits.schema[codes].dataType))
    return visits.withColumn(codes, F.concat(codes, more))
