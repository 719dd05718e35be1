"""Named queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query, and the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
from . import queries_cohort  # noqa: E402,F401
from . import queries_patterns  # noqa: E402,F401
from . import queries_streams  # noqa: E402,F401
from . import queries_frames  # noqa: E402,F401
from . import queries_more  # noqa: E402,F401
from . import queries_learn  # noqa: E402,F401
from . import queries_io  # noqa: E402,F401
