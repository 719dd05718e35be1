"""Column functions over sequences: arrays of codes, or of structs with a code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import Predicate


def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def pad_left(a: Column, n: int, value: Column) -> Column:
    """The last ``n``, padded in front."""
    return F.concat(F.array_repeat(value, F.greatest(n - F.size(a), F.lit(0))), last_n(a, n))


def ngrams(a: Column, n: int) -> Column:
    """Overlapping runs of ``n``; shorter arrays have none. ``a`` must be a plain column."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.slice(F.array(a), 1, 0))


def hits(a: Column, p: Predicate) -> Column:
    """1-based positions at which the predicate holds."""
    at = F.transform(a, lambda x, i: F.when(p(x), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def cut(a: Column, p: Predicate, policy: str = "prior", nth: int = 1, inclusive: bool = True) -> Column:
    """The part before or after the n-th hit; without that hit the whole array."""
    if nth < 1:
        raise ValueError("nth counts from 1")
    at = F.get(hits(a, p), nth - 1)
    if policy == "prior":
        part = F.slice(a, 1, at if inclusive else at - 1)
    else:
        start = at if inclusive else at + 1
        part = F.slice(a, start, F.greatest(F.size(a) - start + 1, F.lit(0)))
    return F.when(at.isNull(), a).otherwise(part)


def cut_inverse(a: Column, p: Predicate, policy: str = "prior", inclusive: bool = False) -> Column:
    """Cut where the predicate first fails."""
    return cut(a, lambda x: ~p(x), policy, 1, inclusive)


def is_subsequence(pattern: Column, a: Column) -> Column:
    """Whether the items of ``pattern`` occur in ``a`` in order."""
    step = lambda k, c: F.when(F.get(pattern, k) == c, k + 1).otherwise(k)
    return F.aggregate(a, F.lit(0), step) == F.size(pattern)


def match_positions(pattern: Column, a: Column) -> Column:
    """All greedy matches (arrays of 0-based positions): each starts after the first position of the one before.

    A match's first item is an occurrence of the pattern's first; the rest is found left-most after it.
    """
    head = F.filter(F.transform(a, lambda c, i: F.when(c == F.get(pattern, 0), i)), lambda i: i.isNotNull())

    def follow(i: Column) -> Column:
        rest = F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0)))
        start = F.struct(F.lit(1).alias("k"), F.array(i).alias("at"), (i + 1).alias("pos"))
        step = lambda s, c: F.struct((s["k"] + (F.coalesce(F.get(pattern, s["k"]) == c, F.lit(False))).cast("int")).alias("k"), F.when(F.coalesce(F.get(pattern, s["k"]) == c, F.lit(False)), F.concat(s["at"], F.array(s["pos"]))).otherwise(s["at"]).alias("at"), (s["pos"] + 1).alias("pos"))
        return F.aggregate(rest, start, step)["at"]

    return F.filter(F.transform(head, follow), lambda m: F.size(m) == F.size(pattern))


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i)
    return F.size(F.filter(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), same))


def collapse(a: Column) -> Column:
    """Consecutive repeats once. ``a`` must be a plain column."""
    return F.filter(a, lambda x, i: (i == 0) | ~F.get(a, i - 1).eqNullSafe(x))


def collapse_runs(a: Column) -> Column:
    """``collapse`` for any expression: it is evaluated once."""
    return F.aggregate(a, F.array().cast("array<string>"), lambda out, x: F.when((F.size(out) > 0) & F.get(out, F.size(out) - 1).eqNullSafe(x), out).otherwise(F.concat(out, F.array(x))))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def midpoint(first: Column, last: Column) -> Column:
    return F.date_add(first, F.floor(F.datediff(last, first) / 2).cast("int"))


# Exchange format: "date|code,date|code;date|code$", ';' between visits.
def assemble(visits: Column) -> Column:
    """Text of array<array<struct<t, code>>>."""
    one = lambda v: F.array_join(F.transform(v, lambda x: F.concat_ws("|", F.date_format(x["t"], "yyyy-MM-dd"), x["code"])), ",")
    return F.concat(F.array_join(F.transform(visits, one), ";"), F.lit("$"))


def parse(text: Column) -> Column:
    """array<array<struct<t: date, code>>>; text that doesn't end in '$' is null, tokens without a time go, empty codes are 'unknown'."""
    def token(x: Column) -> Column:
        code = F.substring_index(x, "|", -1)
        return F.struct(F.substring_index(x, "|", 1).try_cast("date").alias("t"), F.when(F.trim(code) == "", "unknown").otherwise(code).alias("code"))

    visits = F.split(F.regexp_replace(text, r"\$$", ""), ";")
    read = F.transform(visits, lambda v: F.transform(F.filter(F.split(v, ","), lambda x: x.contains("|")), token))
    return F.when(text.endswith("$"), read)
