"""Edit distance of long texts in Arrow batches; that of words by a bit-parallel kernel."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.waves import Job, codes, front_distances, groups

#: Texts of a group, longer ones counting more, from which antidiagonals pay.
FEW = 16


def edits(a: Sequence, b: Sequence) -> int:
    """Least insertions, deletions and substitutions between two sequences.

    The column of the dynamic programme is held as two bit vectors (Myers 1999, in
    Hyyro's form for whole sequences), one machine operation for many rows.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    hi = 0
    while hi < min(len(a), len(b)) and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not len(a) or not len(b):
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        same = where.get(x, 0)
        zero = same | down
        diag = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(diag | up)), up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(zero | plus)) & full, plus & zero & full
    return score


def within(a: Sequence, b: Sequence, most: int, least: int = 0) -> int | None:
    """The edit distance if it is at most ``most``, else None.

    The bit vectors of :func:`edits` along the diagonals that a path of that cost can reach
    (Hyyro 2003); a step moves them down by one row, and the work ends as soon as the cost
    cannot fall to ``most`` again.  Where counts of signs alone ask for ``least`` edits
    (:func:`surplus`), each insertion into the longer text costs one more than those, so a
    path of ``most`` has few.
    """
    m, n = len(a), len(b)
    if most < abs(n - m):
        return None
    spare = min((most - abs(n - m)) // 2, most - least)
    if spare < 0:
        return None
    above, below = spare + max(0, n - m), spare + max(0, m - n)
    if 2 * (above + below) >= m:
        d = edits(a, b)
        return d if d <= most else None
    wide = above + below + 1
    full, low = (1 << wide) - 1, 1 << (wide - 1)
    up, down, score = full & ~((1 << above) - 1), 0, below  # bit t is row j - above + t
    where: dict = {}  # of the rows from first on
    for i, x in enumerate(a[:below]):
        where[x] = where.get(x, 0) | 1 << (above + i)
    first = -above
    for j, x in enumerate(b, 1):
        if j - above - 1 - first > wide + 256:
            where = {c: rest for c, bits in where.items() if (rest := bits >> (j - above - 1 - first))}
            first = j - above - 1
        if j + below <= m:
            where[a[j + below - 1]] = where.get(a[j + below - 1], 0) | 1 << (j + below - 1 - first)
        same = where.get(x, 0) >> (j - above - 1 - first) & full
        diag = (((same & up) + up) ^ up) & full | same | down
        plus, minus = down | (full & ~(diag | up)), up & diag
        if j <= m - below:
            score += not diag & low
        else:
            low >>= 1
            score += bool(plus & low) - bool(minus & low)
        if score > most + n - max(j, m - below):
            return None
        up, down = minus | (full & ~(diag >> 1 | plus)), diag >> 1 & plus
    return score if score <= most else None


def surplus(x: np.ndarray, y: np.ndarray) -> int:
    """What two texts' code points, counted without their places, leave to be edited."""
    if not len(x) or not len(y):
        return len(x) + len(y)
    top = min(int(max(x.max(), y.max())), 1023)
    more = np.bincount(np.minimum(x, top), minlength=top + 1) - np.bincount(np.minimum(y, top), minlength=top + 1)
    return max(int(more[more > 0].sum()), int(-more[more < 0].sum()))


def distances(pairs: Sequence[tuple[str, str]]) -> list[int]:
    """Edit distances in code points; equal pairs are measured once."""
    found, jobs = [0] * len(pairs), []  # type: list[int], list[Job]
    first: dict[tuple[str, str], int] = {}
    for i, (a, b) in enumerate(pairs):
        if a == b or first.setdefault((a, b), i) != i:
            continue
        x, y = codes(a), codes(b)
        most = min(len(x), len(y))
        off = np.flatnonzero(x[:most] != y[:most])
        head = int(off[0]) if len(off) else most
        off = np.flatnonzero(x[len(x) - (most - head) :][::-1] != y[len(y) - (most - head) :][::-1])
        tail = int(off[0]) if len(off) else most - head
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        if not len(x) or not len(y):
            found[i] = len(x) + len(y)
            continue
        least = surplus(x, y)
        jobs.append((i, x, y, max(8, (least - abs(len(x) - len(y))) // 2 + 8)))
    while jobs:
        again = []
        for group, lo, hi in groups(jobs, 1 << 62):
            n = len(group[-1][1])
            if len(group) * (1 + n / 4096) < FEW:  # a step of the front costs as much for one text
                for i, x, y, _ in group:
                    found[i] = edits(x.tolist(), y.tolist())
                continue
            for (i, x, y, w), d in zip(group, front_distances(group, lo, hi), strict=True):
                # a path beyond the band has at least so many insertions and deletions
                if d <= 2 * w + abs(len(x) - len(y)) + 1 or w >= max(len(x), len(y)):
                    found[i] = d
                else:
                    again.append((i, x, y, max(2 * w, min(4 * w, (d - abs(len(x) - len(y))) // 2 + 1))))
        jobs = again
    return [d if a == b else found[first[a, b]] for d, (a, b) in zip(found, pairs, strict=True)]


@F.pandas_udf(T.LongType())
def _characters(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a, b, strict=True))
    found = iter(distances([p for p in pairs if None not in p]))
    return pd.Series([None if None in p else next(found) for p in pairs], dtype="Int64")


@F.pandas_udf(T.LongType())
def _words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype="Int64")


def measures(original: Column, corrected: Column, reference: Column, metric: str, fold: bool = False) -> Column:
    """Of three texts, composed here and sent to Python once: ``struct(ref_length, weight,
    orig_weight, edits, orig_edits)`` in code points (``cer``) or words (``wer``)."""

    def ready(t: str | None):
        if t is None:
            return None
        if fold or not t.isascii():
            t = unicodedata.normalize("NFKC", t.casefold() if fold else t)
        return t if metric == "cer" else t.split()

    @F.pandas_udf("struct<ref_length:long,weight:long,orig_weight:long,edits:long,orig_edits:long>")
    def run(o: pd.Series, c: pd.Series, r: pd.Series) -> pd.DataFrame:
        texts = [tuple(map(ready, row)) for row in zip(o, c, r, strict=True)]
        pairs = [(x, ref) for a, b, ref in texts for x in (b, a)]
        known = [p for p in pairs if None not in p]
        done = iter(distances(known) if metric == "cer" else [edits(*p) for p in known])
        found = iter([None if None in p else next(done) for p in pairs])
        rows = [(*(None if x is None else len(x) for x in (ref, b, a)), next(found), next(found)) for a, b, ref in texts]
        return pd.DataFrame(rows, columns=["ref_length", "weight", "orig_weight", "edits", "orig_edits"], dtype="Int64")

    return run(original, corrected, reference)


def char_edits(a: Column, b: Column) -> Column:
    """Edit distance in code points; null if either is null."""
    return _characters(a, b)


def word_edits(a: Column, b: Column) -> Column:
    """Edit distance in white-space-delimited words."""
    return _words(a, b)
