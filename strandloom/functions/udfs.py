"""The few functions that need a back-trace or a table of two dimensions: Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def lcs_items(a: list, b: list) -> list:
    """A longest common subsequence; where two exist the one that skips in ``a`` first.

    The table of lengths of what is left is kept as one integer a row, a bit for each place of ``b`` where it steps.
    """
    n, m = len(a), len(b)
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << (m - 1 - j)  # from the end
    full = (1 << m) - 1
    rows = [full]  # rows[k]: of the last k items of ``a``; a 0 is a step
    for x in reversed(a):
        row = rows[-1]
        same = row & at.get(x, 0)
        rows.append((row + same | row - same) & full)

    def best(i: int, j: int) -> int:
        """Length for a[i:] and b[j:]."""
        low = (1 << (m - j)) - 1
        return m - j - (rows[n - i] & low).bit_count()

    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best(i + 1, j) >= best(i, j + 1):
            i += 1
        else:
            j += 1
    return out


@F.pandas_udf(STRINGS)
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_items(list(x), list(y)) for x, y in zip(a, b)])


def lcs_size(a: list, b: list) -> int:
    """Length of a longest common subsequence: a row of the table is one integer, a bit an item of ``b``."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        same = row & at.get(x, 0)
        row = (row + same | row - same) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_size(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


#: Common subsequences that are grown side by side for a first bound.
BEAM = 200


def lcs_of_all(rows: list[list]) -> list:
    """A longest sequence that is a subsequence of every one of ``rows``, of any number and length.

    Only places where all rows have the same item are looked at. From such a place the next ones are the first
    occurrences of each item in all rows; level by level these are the ends of all common subsequences that take every
    item as early as they can. A place stays only if it may still beat what a narrow search has found: by the length so
    far and the shortest of the common subsequences of what is left of any two rows. Exact: nothing else is cut.
    """
    if not rows or not all(rows):
        return []
    items = sorted(set.intersection(*map(set, rows)), key=str)
    if not items:
        return []
    if len(rows) == 1:
        return list(rows[0])
    if len(items) == 1:
        return items * min(r.count(items[0]) for r in rows)
    k = len(rows)
    where = {x: c for c, x in enumerate(items)}
    rows = [[x for x in r if x in where] for r in rows]  # other items are in no common subsequence: tables are made without them
    # next_[r][i, c]: one past the first place of item c in row r from i on; 0 if there is none
    next_ = []
    for r in rows:
        t = np.zeros((len(r) + 1, len(items)), np.int64)
        for i in range(len(r) - 1, -1, -1):
            t[i] = t[i + 1]
            t[i, where[r[i]]] = i + 1
        next_.append(t)
    left = {(x, y): _lengths_left(rows[x], rows[y]) for x in range(k) for y in range(x + 1, k)}

    def room(p: np.ndarray) -> np.ndarray:
        out = None
        for (x, y), t in left.items():
            v = t[p[:, x], p[:, y]]
            out = v if out is None else np.minimum(out, v)
        return out

    def grown(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next places, without repeats; each with the place it comes from and its item."""
        q = np.stack([t[p[:, r]] for r, t in enumerate(next_)], axis=2).reshape(-1, k)
        own = np.flatnonzero((q > 0).all(axis=1))
        q, first = np.unique(q[own], axis=0, return_index=True)
        return q, own[first] // len(items), own[first] % len(items)

    def search(width: int | None, bound: int) -> list:
        p, steps = np.zeros((1, k), np.int64), []
        while True:
            q, parent, item = grown(p)
            r = room(q) if len(q) else np.empty(0, np.int64)
            keep = np.flatnonzero(len(steps) + 1 + r > bound)
            if width and len(keep) > width:
                keep = keep[np.lexsort((q[keep].sum(axis=1), -r[keep]))[:width]]
            elif not width and len(keep):
                keep = keep[_leading(q[keep])]
            if not len(keep):
                break
            steps.append((parent[keep], item[keep]))
            p = q[keep]
        if len(steps) <= bound:
            return []
        out, at = [], 0
        for parent, item in reversed(steps):
            out.append(items[item[at]])
            at = parent[at]
        return out[::-1]

    found = search(BEAM, -1)
    return search(None, len(found)) or found


def _leading(p: np.ndarray) -> np.ndarray:
    """Rows of ``p`` without those that some leading row doesn't exceed in any column: these can't do better."""
    order = np.argsort(p.sum(axis=1), kind="stable")
    keep = np.ones(len(p), bool)
    for i in order[:64]:
        if keep[i]:
            worse = (p >= p[i]).all(axis=1)
            worse[i] = False
            keep &= ~worse
    return np.flatnonzero(keep)


def _lengths_left(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a[i:] and b[j:], for all i and j."""
    t = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    code = {x: n for n, x in enumerate(dict.fromkeys([*a, *b]))}
    there = np.array([code[y] for y in b])
    for i in range(len(a) - 1, -1, -1):
        hit = np.where(there == code[a[i]], t[i + 1, 1:] + 1, t[i + 1, :-1])
        t[i, :-1] = np.maximum.accumulate(hit[::-1])[::-1]
    return t


@F.pandas_udf(STRINGS)
def lcs_many(sequences: pd.Series) -> pd.Series:
    """Longest common subsequence of several sequences (see ``lcs_of_all``)."""
    return pd.Series([None if s is None else lcs_of_all([list(r) for r in s]) for s in sequences])


def weighted_edits(s, t, delete: float, insert: float, change: float) -> float:
    prev = [j * insert for j in range(len(t) + 1)]
    for i, x in enumerate(s, 1):
        row = [i * delete]
        for j, y in enumerate(t, 1):
            row.append(min(prev[j] + delete, row[j - 1] + insert, prev[j - 1] + (change if x != y else 0)))
        prev = row
    return float(prev[-1])


def edit_distance(delete: float = 1, insert: float = 1, change: float = 1):
    """A function of two string columns; unit costs have the built-in ``levenshtein``."""

    @F.pandas_udf(T.DoubleType())
    def distance(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else weighted_edits(x, y, delete, insert, change) for x, y in zip(s, t)])

    return distance


@F.pandas_udf(STRINGS)
def common_substrings(s: pd.Series, t: pd.Series) -> pd.Series:
    """All longest common substrings, sorted."""

    def longest(a, b):
        best, found, prev = 0, set(), [0] * (len(b) + 1)
        for i, x in enumerate(a):
            row = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    row[j + 1] = prev[j] + 1
                    if row[j + 1] > best:
                        best, found = row[j + 1], set()
                    if row[j + 1] == best:
                        found.add(a[i - best + 1 : i + 1])
            prev = row
        return sorted(found)

    return pd.Series([None if x is None or y is None else longest(x, y) for x, y in zip(s, t)])
