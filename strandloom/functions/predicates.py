"""Predicates as Column builders, and a registry by disease name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]

NULL_WORDS = ("", "nan", "null", "none", "n/a", "na")


def is_null_text(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*NULL_WORDS)


def is_null(c: Column) -> Column:
    return c.isNull() | is_null_text(c.cast("string"))


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def is_date(c: Column) -> Column:
    return c.try_cast("date").isNotNull()


def in_codes(c: Column, codes: list[str], negate: bool = False) -> Column:
    """``negate`` is explicit; null is in neither."""
    found = c.isin(*codes)
    return ~found if negate else found


def starts_with_any(c: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(r) for r in dict.fromkeys(roots)])


def code_constraint(c: Column, codes: list[str]) -> Column:
    """Exact codes; if any is a base form, prefixes for all."""
    if any("." not in x for x in codes):
        return starts_with_any(c, [x.split(".")[0] for x in codes])
    return c.isin(*codes)


def has_code(codes: Column, targets: list[str], at_least: int = 1) -> Column:
    """Whether the array has ``at_least`` different targets; no targets: true, no codes: false."""
    if not targets:
        return F.lit(True)
    hits = F.size(F.array_intersect(codes, F.array(*[F.lit(t) for t in targets])))
    return F.coalesce(hits >= at_least, F.lit(False))


def is_case(codes: Column, targets: list[str] = (), prefix: str = "", logic: str = "any", threshold: int = 1) -> Column:
    """A sequence is a case by a prefix that occurs ``threshold`` times, else by any or all of ``targets``."""
    if prefix:
        return F.size(F.filter(codes, lambda c: c.startswith(prefix))) >= threshold
    wanted = F.array(*[F.lit(t) for t in targets])
    return F.arrays_overlap(codes, wanted) if logic == "any" else F.size(F.array_except(wanted, codes)) == 0


REGISTRY: dict[str, Predicate] = {}


def register(name: str, p: Predicate) -> Predicate:
    """Name a predicate; any Column builder will do, a Python UDF too."""
    REGISTRY[name] = p
    return p


def disease(name: str) -> Predicate:
    """The registered predicate whose name ``name`` starts with."""
    for key, p in REGISTRY.items():
        if name.lower().startswith(key):
            return p
    raise KeyError(name)


register("ckd", lambda c: c.startswith("585"))
register("ptsd", lambda c: c.rlike(r"^(309\.81|F43\.1)"))
register("diab", lambda c: F.substring(c, 1, 3).isin("249", "250", "648"))
