"""Getters by name: a function of a code that gives any number of values, applied to whole columns as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GETTERS: dict[str, Callable[[str], Iterable[str]]] = {}


def getter(name: str):
    """Decorator: add a getter."""

    def put(f):
        GETTERS[name] = f
        return f

    return put


@getter("prefixes")
def prefixes(code: str) -> Iterable[str]:
    """The code's root and its longer forms: 250.13 gives 250, 250.1, 250.13."""
    root, _, rest = code.partition(".")
    yield root
    for n in range(1, len(rest) + 1):
        yield f"{root}.{rest[:n]}"


def table_function(name: str):
    """The getter as a Python table function (code) -> (value)."""
    get = GETTERS[name]

    class Template:
        def eval(self, code: str):
            if code is not None:
                for value in get(code):
                    yield (value,)

    return F.udtf(Template, returnType="value string")


def register(spark: SparkSession, name: str) -> str:
    """Make a getter known to SQL as ``get_<name>``, for LATERAL joins."""
    spark.udtf.register(f"get_{name}", table_function(name))
    return f"get_{name}"


def applied(rows: DataFrame, code: Column, name: str) -> DataFrame:
    """``rows`` joined with what the getter gives for each code: a column value, a row each; rows without any go.

    Distinct codes are looked up once, then joined back, so the getter runs once a code however many rows have it.
    """
    coded = rows.withColumn("_code", code)
    known = coded.select("_code").distinct().lateralJoin(table_function(name)(F.col("_code").outer()))
    return coded.join(known, "_code").drop("_code")
