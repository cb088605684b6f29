"""Character edits after blocks of words have been moved (CharacTER, Wang et al. 2016).

Words say which blocks move, characters say whether a move pays.  A longest common
subsequence of the words leaves unmatched ones on both sides; runs of words that stand
in both texts, but not at matching places, are found by an index of word n-grams and
moved in batches, the ones that gain most first, as long as the total falls.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.distance import edits, surplus, within
from vellum.functions.waves import codes

#: Lengths of the n-grams that are looked up, longest first.
GRAMS = (8, 4, 2, 1)
#: Words in which an upper bound of the edits looks for equal ones.
AHEAD = 32


def mates(a: Sequence, b: Sequence) -> list[int]:
    """For each place in ``a`` its place in ``b`` under a longest common subsequence, or -1.

    Rows of the bit-parallel table are kept at intervals of the root of their number and
    worked out again on the way back, so memory grows with the 1.5th power of the length
    in bits.
    """
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mate = [*range(lo), *[-1] * (len(a) - lo - hi), *range(len(b) - hi, len(b))]
    n, m = len(a) - lo - hi, len(b) - lo - hi
    if not n or not m:
        return mate
    where: dict = {}
    for i in range(n):
        where[a[lo + i]] = where.get(a[lo + i], 0) | 1 << i
    full, gap = (1 << n) - 1, max(1, int(m**0.5))

    def after(row: int, j: int) -> int:
        u = row & where.get(b[lo + j], 0)
        return ((row + u) | (row - u)) & full

    kept, row = [], full
    for j in range(m):
        if j % gap == 0:
            kept.append(row)
        row = after(row, j)
    i, j, first, rows = n, m, m, [row]  # rows[k] is the row after first + k words of b
    while i and j:
        if j - 1 < first:
            first = (j - 1) // gap * gap
            rows = [kept[first // gap]]
            for k in range(first, j):
                rows.append(after(rows[-1], k))
        if rows[j - first] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1 - first] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            mate[lo + i] = lo + j
    return mate


def runs(h: Sequence, r: Sequence, mate: list[int], back: list[int]) -> list[tuple[int, int, int, int]]:
    """``(gain, i, j, n)``: common runs away from matching places that do not overlap, best
    first.  The gain is that in words under the given match; n-grams that occur several
    times are paired in order, so the work is linear in the words."""
    found = set()
    for size in GRAMS:
        at: dict[tuple, list[int]] = {}
        for j in range(len(r) - size + 1):
            if back[j] < 0:
                at.setdefault(tuple(r[j : j + size]), []).append(j)
        turn: dict[tuple, int] = {}
        for i in range(len(h) - size + 1):
            if mate[i] >= 0 or (gram := tuple(h[i : i + size])) not in at:
                continue
            k = turn[gram] = turn.get(gram, -1) + 1
            if k >= len(at[gram]):
                continue
            x, j = i, at[gram][k]
            while x and j and h[x - 1] == r[j - 1] and mate[x - 1] != j - 1:
                x, j = x - 1, j - 1
            n = 0
            while x + n < len(h) and j + n < len(r) and h[x + n] == r[j + n] and mate[x + n] != j + n:
                n += 1
            while mate[x] >= 0 and back[j] >= 0:
                x, j, n = x + 1, j + 1, n - 1
            while mate[x + n - 1] >= 0 and back[j + n - 1] >= 0:
                n -= 1
            found.add((x, j, n))
    scored = sorted((-sum((1 if mate[i + k] < 0 else -1) + (1 if back[j + k] < 0 else -1) for k in range(n)), i, j, n) for i, j, n in found)
    out, used_h, used_r = [], bytearray(len(h)), bytearray(len(r))
    for loss, i, j, n in scored:
        if loss < 0 and not any(used_h[i : i + n]) and not any(used_r[j : j + n]):
            used_h[i : i + n] = used_r[j : j + n] = b"\1" * n
            out.append((-loss, i, j, n))
    return out


def moved(h: Sequence, back: list[int], chosen: Sequence[tuple[int, int, int, int]]) -> list:
    """``h`` with each chosen run behind the last word that stays and is matched before it."""
    away = bytearray(len(h))
    for _, i, _, n in chosen:
        away[i : i + n] = b"\1" * n
    coming: dict[int, list] = {}
    anchor, j = -1, 0
    for _, i, to, n in sorted(chosen, key=lambda c: c[2]):
        for j in range(j, to):
            if back[j] >= 0 and not away[back[j]]:
                anchor = back[j]
        coming.setdefault(anchor, []).extend(h[i : i + n])
        j = to
    out = coming.get(-1, [])[:]
    for i, w in enumerate(h):
        if not away[i]:
            out.append(w)
        out += coming.get(i, [])
    return out


def _pair(mate: list[int], n: int) -> tuple[list[int], list[int]]:
    back = [-1] * n
    for i, j in enumerate(mate):
        if j >= 0:
            back[j] = i
    return mate, back


def matches(h: Sequence, r: Sequence) -> list[tuple[list[int], list[int]]]:
    """The match that keeps to the ends of the texts and the one that keeps to their starts:
    of two blocks in turned order either may be the one that stays."""
    turned = mates(h[::-1], r[::-1])
    both = [mates(h, r), [len(r) - 1 - j if j >= 0 else -1 for j in reversed(turned)]]
    return [_pair(m, len(r)) for m in (both if both[0] != both[1] else both[:1])]


def by_words(h: Sequence[str], r: Sequence[str]) -> int:
    """Character edits of two single-spaced texts where some equal words stay as they are:
    the edits of what stands between them, which are never too few.  After a difference the
    nearest equal words go on; without any within :data:`AHEAD` words the rest is edited."""
    total, i, j, m, n = 0, 0, 0, len(h), len(r)
    while i < m or j < n:
        if i < m and j < n and h[i] == r[j]:
            i, j = i + 1, j + 1
            continue
        x, y = m, n
        for d in range(1, 2 * AHEAD):
            found = [(d // 2 + k, d - d // 2 - k) for k in range(-(d // 2), d - d // 2 + 1) if i + d // 2 + k < m and j + d - d // 2 - k < n and h[i + d // 2 + k] == r[j + d - d // 2 - k]]
            if found:
                x, y = min(found, key=lambda f: abs(f[0] - f[1]))
                x, y = i + x, j + y
                break
        first, last = [""] * bool(i or j), [""] * (x < m)
        total += edits(" ".join(first + h[i:x] + last), " ".join(first + r[j:y] + last))
        i, j = x, y
    return total


class Distance:
    """The character edits of two single-spaced texts, known to lie from ``low`` to ``high``
    and found only as far as a question needs.  No order of the words takes fewer than
    ``low``, for the characters are the same in any."""

    def __init__(self, h: list[str], r: list[str], goal: str, low: int):
        self.text, self.goal, self.least, self.low, self.high = " ".join(h), goal, low, low, by_words(h, r)

    def above(self, most: int) -> bool:
        """Whether it is more than ``most``."""
        if self.low <= most < self.high:
            found = within(self.text, self.goal, most, self.least)
            if found is None:
                self.low = most + 1
            else:
                self.low = self.high = found
        return self.low > most

    def exact(self) -> int:
        if self.low < self.high:
            self.low = self.high = within(self.text, self.goal, self.high, self.least)
        return self.low


def character_edits(hypothesis: str, reference: str) -> tuple[float, int, int]:
    """``(cost, moves, moved words)``: character edits of the texts, single-spaced, plus the
    mean word length of each moved block.  A batch that does not pay is halved; of the
    batches that two matches give the cheaper counts.

    Counts of characters bound the edits of any order of the words from below, matched
    words those of one order from above.  Where both agree no table is filled; the edits
    before any move are only compared, not found, if a batch pays.
    """
    h, r = hypothesis.split(), reference.split()
    goal = " ".join(r)
    least = surplus(codes(" ".join(h)), codes(goal))
    left, paid, moves, words = Distance(h, r, goal, least), 0.0, 0, 0
    while left.high > least and left.above(least):  # no move pays where only the least is left
        found = None
        for mate, back in matches(h, r):
            chosen = runs(h, r, mate, back)
            while chosen:
                fee = paid + sum(sum(map(len, h[i : i + n])) / n for _, i, _, n in chosen)
                if fee + least < paid + left.high - 1e-9:
                    new = moved(h, back, chosen)
                    then = Distance(new, r, goal, least)
                    now = fee + then.exact()
                    k = max(0, floor(now - paid) - 1)  # the most edits that are not dearer
                    while not now < paid + (k + 1) - 1e-9:
                        k += 1
                    if left.above(k):
                        if found is None or now < found[0]:
                            found = now, fee, new, chosen, then
                        break
                chosen = chosen[: len(chosen) // 2]
        if found is None:
            break
        _, paid, h, chosen, left = found
        moves, words = moves + len(chosen), words + sum(c[3] for c in chosen)
    return paid + left.exact(), moves, words


def move_edits(hypothesis: Column, reference: Column) -> Column:
    """``struct(cost, moves, words, length)`` of whole texts, ``length`` the hypothesis's in
    characters; null fields if either is null."""

    @F.pandas_udf("struct<cost:double,moves:long,words:long,length:long>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 4 if x is None or y is None else (*character_edits(x, y), len(" ".join(x.split()))) for x, y in zip(a, b, strict=True)]
        types = {"cost": "Float64", "moves": "Int64", "words": "Int64", "length": "Int64"}
        return pd.DataFrame(rows, columns=list(types)).astype(types)

    return run(hypothesis, reference)
