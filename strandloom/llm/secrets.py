"""Secret scans with multipart credential linking.

Base patterns find assignments, access key ids and long hex strings. Linking then looks for the parts that make up a
credential: access identifiers, secrets and endpoints. Scopes are the paragraphs of a text, and an interval join
within the scope pairs parts that lie at most ``REACH`` code points apart. Parts that are too weak to report alone are
reported only when a complementary part is in reach. No linked span overlaps a base span.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more; a shorter run holds no longer match
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

# Weak parts: what they look like, and what must be in reach.
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|account_?(?:id|name)|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}|\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b)""", re.A)
# a "=" before it ends a name (NAME=value); a run that a "=" follows is a name or part of a longer string, but for padding
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Farthest that complementary parts may lie apart, in code points.
REACH = 200
#: Bits a character that an opaque string must have on average, besides a digit and letters of both cases.
ENTROPY = 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches as (kind, start, end), by start and then kind as listed."""
    found = []
    if KEYWORDS.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def opaque(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak identifiers, secrets and endpoints that a complementary part completes.

    A secret (base assignment, base hex, or opaque string) and an access identifier complete each other; an endpoint
    is reported next to a strong or completed secret. Each interval is joined by bisection, not with every other.
    """
    strong_secret = [(s, e) for k, s, e in base if k in ("assign", "hex")]
    strong_id = [(s, e) for k, s, e in base if k == "access"]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))  # the end of any base span up to each

    def free(s: int, e: int) -> bool:
        """Whether no base span overlaps s..e: of those that start before e, the furthest end tells."""
        at = bisect_left(starts, e)
        return not at or furthest[at - 1] <= s

    weak_secret = [m.span() for m in OPAQUE.finditer(text) if free(*m.span()) and opaque(m[0])]
    weak_id = [m.span() for m in IDENTIFIER.finditer(text) if free(*m.span())] if ":" in text or "=" in text else []
    if not (strong_secret or weak_secret):
        return []
    cuts = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    scope = lambda at: bisect_left(cuts, at)

    def near(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of ``spans`` with one of ``others`` in reach and in the same scope, itself aside.

        Of the others of a scope that start up to a span's end plus the reach, the two furthest ends tell: one may be
        the span itself. So a very long span costs no more than a short one.
        """
        by_scope: dict[int, tuple[list[int], list[tuple]]] = {}
        for a, b in sorted(set(others)):
            begin, ends = by_scope.setdefault(scope(a), ([], []))
            far = sorted([*(ends[-1] if ends else ()), (b, a)], reverse=True)[:2]
            begin.append(a)
            ends.append(tuple(far))
        found = []
        for s, e in spans:
            begin, ends = by_scope.get(scope(s), ([], []))
            at = bisect_right(begin, e + REACH)
            if at and any((a, b) != (s, e) and b >= s - REACH for b, a in ends[at - 1]):
                found.append((s, e))
        return found

    secrets, ids = strong_secret + weak_secret, strong_id + weak_id
    out = [("identifier", *x) for x in near(weak_id, secrets)]
    completed = near(weak_secret, ids)
    out += [("secret", *x) for x in completed]
    sure = strong_secret + completed
    if sure:
        out += [("endpoint", *x) for x in near([m.span() for m in ENDPOINT.finditer(text) if free(*m.span())], sure)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, base (spans as text), linked (spans as text), and counts of the base kinds; one row per row of ``docs``.

    Whole texts; null and empty texts have no spans. Offsets are code points, ends exclusive. Base matches of one kind
    don't overlap; those of two kinds may. Other columns are ignored.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b["text"]):
                base = base_spans(text)
                kinds = Counter(x[0] for x in base)
                rows.append((k, kinds["assign"], kinds["access"], kinds["hex"], joined(base), joined(base + linked_spans(text, base))))
            yield pd.DataFrame(rows, columns=[key, "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInPandas(each, f"{key} {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(text: str, mask: str = "[secret]") -> str:
    """``text`` with every reported span replaced."""
    base, out, at = base_spans(text), [], 0
    for _, s, e in sorted(base + linked_spans(text, base), key=lambda x: x[1:]):
        if e > at:
            out += [text[at : max(s, at)], mask] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
